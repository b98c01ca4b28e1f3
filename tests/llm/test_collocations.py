"""Collocations against counting every phrase; quicksort parts are counts; split words and pairs stay whole."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import collocations as co

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, floor=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= floor}
    gone = {(lang, p[i:i + 2]) for (lang, p), a in found.items() if len(p) == 3 for i in (0, 1) if 100 * a >= 50 * f[lang, p[i:i + 2]]}
    rows = []
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            score, _, left, right = min((10 ** 6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            rows.append((lang, " ".join(p), a, left, right, n[lang], score))
    out = []
    for lang in n:
        of = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(lang, k, *r[1:]) for k, r in enumerate(of[:top], 1)]
    return sorted(out)


def corpus(rng, n):
    langs = ["en", "de", None, "x y"]
    docs = []
    for _ in range(n):
        lang = rng.choice(langs)
        words = [rng.choice(["the", "The", "of", "a", "é", "É", "in", "10", "-"] + [f"w{min(int(rng.expovariate(0.05)), 200)}"] * 6) for _ in range(rng.randrange(60))]
        if rng.random() < 0.3:
            words += ["new", "york", "city"] * rng.randrange(3)
        docs.append((lang, "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "? "]) for w in words)))
    return docs


ODD = [("en", None), (None, ""), ("en", " . , \n"), ("en", "one"), ("en", "a b. a b"), ("nul", "\x00 \x1f\x85  x"), ("zz", "same same same " * 40)]


@pytest.mark.parametrize("per_bucket, least", [(1 << 20, 1), (500, 1), (60, 1), (1 << 20, 64)])
def test_equal_to_counting(spark, monkeypatch, per_bucket, least):
    """One bucket; buckets with split words; buckets with split words and pairs."""
    monkeypatch.setattr(co, "PER_BUCKET", per_bucket)
    monkeypatch.setattr(co, "LEAST_BUCKETS", least)
    docs = corpus(random.Random(3), 400) + ODD
    df = spark.createDataFrame([(lang, t, 1, "x") for lang, t in docs], "lang string, text string, n int, word string").repartition(3)
    assert sorted(map(tuple, co.collocations(df).collect())) == brute(docs)
    assert co.collocations(df.limit(0)).count() == 0


def test_top_cuts_each_language(spark):
    docs = corpus(random.Random(4), 300)
    df = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(map(tuple, co.collocations(df, top=3).collect())) == brute(docs, top=3)


@pytest.mark.parametrize("small", [0, 100, 1 << 20])
def test_equal_parts_are_counts(monkeypatch, small):
    monkeypatch.setattr(co, "SMALL_PART", small)
    rng = np.random.default_rng(5)
    words = rng.integers(0, 6, (3, 3000))
    words[1][words[0] == 0] = 0
    words[2][words[1] == 0] = 0                                       # a suffix that is over stays over
    weight = rng.integers(1, 4, 3000)
    want = Counter()
    for a, b, c, w in zip(*words.tolist(), weight.tolist()):
        for p in ((a,), (a, b), (a, b, c)):
            if 0 not in p:
                want[p] += w
    for floor in (1, 60, 10 ** 6):
        got = {tuple(words[:k, at].tolist()): n for at, k, n in co.equal_parts(words, weight, np.arange(3000), 0, floor)}
        assert got == {p: n for p, n in want.items() if n >= floor}


def test_distinct_triples_of_few_and_many_words():
    rng = np.random.default_rng(6)
    for v in (7, 1 << 22):
        a, b, c = rng.integers(max(0, v - 7), v, (3, 500))
        want = Counter(zip(a.tolist(), b.tolist(), c.tolist()))
        x, y, z, n = co._distinct(a, b, c, v)
        assert dict(zip(zip(x.tolist(), y.tolist(), z.tolist()), n.tolist())) == want


def test_slices_cut_between_words(monkeypatch):
    text = "ab cd,ef " * 50 + "x" * 100 + " y"
    whole = [w for part in co.tokens(text) for w in part]
    monkeypatch.setattr(co, "SLICE", 7)
    assert [w for part in co.tokens(text) for w in part] == whole and whole[:4] == [b"ab", b"cd", b".", b"ef"]


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    rows = [(10 ** 13, 10 ** 13 + 1, 10 ** 13 + 7), (999999999, 10 ** 12, 10 ** 14), (10, 10, 10)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", co._score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r.s == 10 ** 6 * r.a * r.a // (r.l * r.r) for r in df.collect())


def test_word_hash_is_sparks(spark):
    from pyspark.sql import functions as F
    words = ["", "a", "é", "word" * 3, "x" * 31, "x" * 32, "y" * 77]
    df = spark.createDataFrame([("en", w) for w in words], "l string, w string").select("w", F.xxhash64("l", "w").alias("h"))
    assert all(r.h % (1 << 64) == co._word_hash("en", r.w.encode()) for r in df.collect())
