"""License scan against a plain word scan and a regular expression of the templates."""

import random
import re

from tidemark.llm import licenses as lic

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute_base(text):
    w = words(text)
    return sorted((k, label) for p, label in lic.BASE_PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split())


def as_regex(template):
    out = ""
    for t in re.findall(r"\[\[|\]\]|<<[^>]*>>|[^\s\[\]<>]+", template):
        if t == "[[":
            out += "(?:"
        elif t == "]]":
            out += ")?"
        elif t.startswith("<<"):
            lo, hi = re.findall(r"\d+", t.split(";")[1])
            out += "(?:[^ ]+ ){%s,%s}" % (lo, hi)
        else:
            out += re.escape(t) + " "
    return re.compile("(?<= )" + out)


def variant(rng, template):
    out, skip = [], 0
    for t in re.findall(r"\[\[|\]\]|<<[^>]*>>|[^\s\[\]<>]+", template):
        if t == "[[":
            skip = skip or rng.random() < 0.5
        elif t == "]]":
            skip = 0
        elif t.startswith("<<"):
            lo, hi = map(int, re.findall(r"\d+", t.split(";")[1]))
            out += ["acme"] * rng.randint(lo, hi)
        elif not skip:
            out.append(t)
    return out


def test_templates_equal_regex():
    rng = random.Random(4)
    for _ in range(600):
        w = []
        for _ in range(3):
            v = variant(rng, rng.choice(lic.TEMPLATES)[1])
            if rng.random() < 0.4:
                v[rng.randrange(len(v))] = rng.choice(["x", "the"])
            w += v + ["filler"] * rng.randrange(3)
        text = ", ".join(w).title()
        got = lic.scan_text(text)
        assert got["base"] == brute_base(text)
        hay = " " + " ".join(words(text)) + " "
        want = {label for label, t in lic.TEMPLATES if as_regex(t).search(hay)}
        assert {m[0] for m in got["matches"]} == want, text


def test_query_cases(spark):
    df = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (3, "Released under the MIT License.", 0), (3, "Released under the MIT License.", 0),
         (4, "CC BY-NC 4.0 " * 3 + "x " * 50000 + "Apache License, Version 2.0", 0),
         (5, "This work is licensed under the GNU General Public License, version 3.", 0)], "doc_id long, text string, labels int")
    rows = sorted(lic.scan(df).collect(), key=lambda r: r.doc_id)
    assert [(r.n_words, r.n_base, r.first_word, r.labels, r.score) for r in rows[:2]] == [(0, 0, None, "", 0.0)] * 2
    assert rows[2] == rows[3] and (rows[2].n_base, rows[2].first_word, rows[2].last_word, rows[2].base_labels) == (1, 1, 1, "mit")
    assert (rows[4].n_base, rows[4].first_word, rows[4].last_word) == (4, 0, 50015) and rows[4].base_labels == "apache-2,cc-by-nc"
    assert rows[5].base_labels == "" and rows[5].labels == "gpl" and 0 < rows[5].score <= 1
    assert lic.scan(df.limit(0)).count() == 0
