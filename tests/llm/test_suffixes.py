"""Removal of repeated byte strings against a plain dictionary of all strings."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffixes
from tidemark.llm.common import BASE, BYTE_VALUES, U64, prefix_hash, span_hash


def brute(docs, length):
    seen = {}
    for _, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]] = seen.get(b[i:i + length], 0) + 1
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(rng, n, scale):
    text = lambda k, a="abcdefghij é": "".join(rng.choice(a) for _ in range(k))
    passages = [text(rng.randrange(scale // 2, scale * 3)) for _ in range(6)]
    docs = []
    for i in range(n):
        t = text(rng.randrange(scale * 4))
        for _ in range(rng.randrange(3)):
            t += rng.choice(passages) + text(rng.randrange(scale))
        if rng.random() < 0.2 and docs:
            t = rng.choice(docs)[1]
            k = rng.randrange(len(t) + 1)
            t = t[:k] + rng.choice(["", "x", "yy"]) + t[k:]
        docs.append((i, t))
    docs += [(n, None), (n + 1, ""), (n + 2, "short"), (n + 3, text(scale) * 3), (n + 4, "a" * scale * 4), (n + 5, "ab" * scale * 2),
             (0, docs[0][1]), (0, docs[0][1]), (n + 6, docs[3][1])]
    return docs


@pytest.mark.parametrize("length", [400, 60, 9])
def test_equal_to_brute_force(spark, length):
    docs = corpus(random.Random(length), 60, length)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, row int").repartition(5)
    assert sorted(map(tuple, suffixes.removal(df, length).collect())) == brute(docs, length)


def test_empty(spark):
    assert suffixes.removal(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_strings_that_collide_in_the_fast_hash(spark):
    """Two texts share no string of 400 bytes, but the polynomial hash of every one that spans the middle is the same."""
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
    blocks = np.stack([g.ravel() for g in np.meshgrid(*[letters] * 4)], axis=1)
    h = sum(BYTE_VALUES[blocks[:, j]] * U64(pow(BASE, j, 1 << 64)) for j in range(4)) & U64((1 << 37) - 1)
    order = np.argsort(h, kind="stable")
    k = np.flatnonzero(h[order][1:] == h[order][:-1])[0]
    a, b = (blocks[order[i]].tobytes() for i in (k, k + 1))
    middle = lambda a, b: b"".join((a, b)[bin(i).count("1") % 2] for i in range(64))
    one, two = middle(a, b), middle(b, a)
    assert one != two and len({int(prefix_hash(np.frombuffer(m, np.uint8))[-1]) for m in (one, two)}) == 1
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n)).encode()
    whole = np.arange(1) * 0
    gram = min((word(16) for _ in range(20000)), key=lambda g: int(span_hash(prefix_hash(np.frombuffer(g, np.uint8)), whole, whole + 16)[0]))
    head, tail = word(184) + gram, word(200)
    docs = [(1, (head + one + tail).decode()), (2, (head + two + tail).decode())]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, suffixes.removal(df, 400).collect()))
    assert got == brute(docs, 400) and [r[2] for r in got] == [0, 0]


def test_passage_of_many_words_is_judged_by_its_bytes(spark):
    """Of two passages of 51 and more words in two texts each, that of 399 bytes stays and that of 400 goes."""
    rng = random.Random(11)
    word = lambda k: "".join(rng.choices("abcdefghij", k=k))
    text = lambda n: " ".join(word(5) for _ in range(n // 6 + 2))[:n]
    short, long = text(399), text(400)
    assert min(len(short.split()), len(long.split())) > 50
    docs = [(k, a + p + b) for k, (a, p, b) in enumerate([("k", short, "l"), ("m" + text(200), short, "n"), ("o", long, "p"), ("q" + text(200), long, "r")])]
    got = sorted(map(tuple, suffixes.removal(spark.createDataFrame(docs, "doc_id long, text string"), 400).collect()))
    assert got == brute(docs, 400) and [r[2] for r in got] == [0, 0, 400, 400]
