"""Statistics and thresholds against plain Python."""

import math
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import quality


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    cov = {i + j for i, x in enumerate(win) if win.count(x) > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cov), len(w) < 50 or 100 * len(cov) > 50 * len(w)


def test_statistics(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b", "a b c a b c", "x\nx\n\nx \nx\r", "\x1fé\xa0b\x85c", "# *$%&|<>"]
    texts += ["".join(rng.choice(["a ", "b\n", "é ", "c\t", "# ", "dd\x0b", "\n"]) for _ in range(rng.randrange(120))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    got = {r.doc_id: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
           for r in quality.statistics(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), repr(t)


def test_lower_tail(spark):
    cases = [(k, n) for n in (1, 10, 300, 2000) for k in (0, 1, 3, 9, 40) if k <= n] + [(900, 200000), (1500, 200000)]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("p", quality.lower_tail(F.col("k"), F.col("n"), 0.01))
    for r in df.collect():
        if r.k >= r.n * 0.01:
            assert r.p == 1.0
            continue
        logs = [math.lgamma(r.n + 1) - math.lgamma(j + 1) - math.lgamma(r.n - j + 1) + j * math.log(0.01) + (r.n - j) * math.log(0.99) for j in range(r.k + 1)]
        want = math.exp(max(logs)) * sum(math.exp(x - max(logs)) for x in logs)
        assert want <= r.p * (1 + 1e-6) and r.p <= want * 1.001 + 1e-300


def test_thresholds_and_verdict(spark):
    good = "plain words of a text that goes on for long enough to pass "
    rows, labels = [], []
    for i in range(3000):
        bad = i % 5 == 0
        rows.append((i, " ".join(f"w{i}x{j}" + ("#" if bad else "") for j in range(60)) + good, "en", 0))
        labels.append((i, 0 if bad else 1))
    rows += [(5000, None, "en", 0), (5001, "", None, 0), (5002, rows[1][1], "xx", 0), (5002, rows[1][1], "xx", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge(docs, lab).collect()}
    assert not got[5000].kept and not got[5001].kept and got[5002].kept
    assert all(got[i].kept == (i % 5 != 0) for i in range(3000))
    none = quality.judge(docs, lab.limit(0))
    assert none.where("kept = base_failed").count() == 0 and none.count() == len(rows)
    assert quality.judge(docs.limit(0), lab).count() == 0
