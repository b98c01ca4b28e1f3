"""PII against plain regular expressions."""

import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii

ORDER = ["email", "ip", "card", "phone"]


def brute(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        odd = [int(c) for c in d[-1::-2]]
        even = [sum(divmod(int(c) * 2, 10)) for c in d[-2::-2]]
        if 14 <= len(d) <= 19 and (sum(odd) + sum(even)) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda x: (x[0], ORDER.index(x[2])))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.@-+ 0123459_(é%", max_size=40))
def test_base_spans_equal_regex(text):
    assert [s for s in pii.find_spans(text) if s[2] in ORDER] == brute(text)


def test_cards_phones_random():
    rng = random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice(["4111 1111-1111 1111", "+1 (017) 555-7713", "1.2.3.4", "999.1.1.1", " ", "x", "5",
                                "49927398716", "a.b@c.d.e", "0" * 16]) for _ in range(8))
        assert [s for s in pii.find_spans(t) if s[2] in ORDER] == brute(t)


def test_added_kinds():
    t = 'see https://a.example/x?y=1. account no: 12345678, DE89 3704 0044 0532 0130 00 and token = "04dbebab91ab8568"'
    got = {(k, t[s:e]) for s, e, k in pii.find_spans(t)}
    assert ("url", "https://a.example/x?y=1") in got
    assert ("account", "12345678") in got
    assert ("account", "DE89 3704 0044 0532 0130 00") in got
    assert ("secret", "04dbebab91ab8568") in got


def test_query_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "é a@b.cd", "x"), (3, "é a@b.cd", "x"),
                                (4, "y" * 200000 + " 1.2.3.4", "x")], "doc_id long, text string, spans string")
    rows = sorted(pii.report(df).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == [1, 2, 3, 3, 4]
    assert rows[0].base_sha256 == rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[2].spans == "email:2:8" and rows[2].n_email == 1 and rows[2] == rows[3]
    assert rows[4].n_ip == 1
    assert pii.report(df.limit(0)).count() == 0
    red = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert red[1] is None and red[3] == "é [EMAIL]"


def test_cues_without_end():
    """A value full of cues is read once, accepted or refused."""
    start = time.perf_counter()
    assert pii.find_spans("token=" * 200000) == []
    n = len("token=" * 100000)
    assert pii.find_spans("token=" * 100000 + "a1b2c3d4") == [(6, n + 8, "secret")]
    assert time.perf_counter() - start < 5
    t = "password=nodigitshere token=password: abc12345"
    assert [t[s:e] for s, e, _ in pii.find_spans(t)] == ["abc12345"]
