"""Components against all-pairs comparison; the filing keys and the R-tree lose no pair."""

import random
import re

import numpy as np

from tidemark.llm import jaccard as jac
from tidemark.llm.common import BASE, BYTE_VALUES, U64, prefix_hash

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(docs, width, percent):
    sets = [(i, grams(t, width)) for i, t in docs]
    up = {i: i for i, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1:]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    return sorted((i, len(a), find(i)) for i, a in sets)


def corpus(rng, n):
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 8, 12, 30, 60, 90, 200, 400]))] for _ in range(n // 6)]
    docs = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(3000)}"
        if rng.random() < 0.1:
            w += w[: rng.randrange(1, len(w))]
        docs.append((i, " ".join(w)))
    return docs


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(2)
    for _ in range(1500):
        n = int(rng.choice([5, 6, 9, 20, 63, 64, 65, 100, 101, 102, 103, 260, 700]))
        a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        out = int(rng.integers(0, len(a) // 10 + 1))
        b = np.unique(np.concatenate([a[out:], rng.integers(0, 2 ** 63, int(rng.integers(0, n // 8 + 2))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        for percent in (80, 85):
            if 100 * both >= percent * (len(a) + len(b) - both) and jac.set_id(a) != jac.set_id(b):
                assert len(np.intersect1d(jac.keys_of(a, percent), jac.keys_of(b, percent)))


def test_tree_finds_all_within_bound():
    rng = np.random.default_rng(3)
    p = rng.poisson(rng.choice([0.2, 2, 3], (700, 1)), (700, jac.DIMS)).astype(np.uint16)
    s = p.sum(axis=1, dtype=np.int64)
    tree = jac.RTree(p, s, 85)
    for i in range(0, 700, 7):
        want = np.flatnonzero(185 * np.minimum(p, p[i]).sum(axis=1) >= 85 * (s + s[i]))
        assert sorted(tree.search(p[i], int(s[i])).tolist()) == want.tolist()


def test_components_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jac, "BLOCK", 16)
    docs = corpus(random.Random(7), 420) + [(1000, None), (1001, ""), (1002, " \n "), (1003, "One"), (1004, "one"), (1005, "É"), (1006, "é"),
                                            (1007, "a b c " * 20000), (1008, "A B C " * 15000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, sid int, key int").repartition(5)
    for width, percent in ((4, 85), (5, 80)):
        got = sorted(map(tuple, jac.components(df, width, percent).collect()))
        assert got == brute(docs, width, percent)
    assert jac.components(df.limit(0)).count() == 0


def test_chains_and_stars(spark):
    """Members that link to others of a key but not to its smallest set."""
    rng = random.Random(9)
    docs, w = [], [f"v{i}" for i in range(160)]
    for i in range(60):
        docs.append((i, " ".join(w)))
        w[rng.randrange(160)] = f"n{i}"
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jac.components(df).collect())) == brute(docs, 4, 85)


def test_counts_over_16_bits_do_not_bound():
    """A set of more shingles than a 16-bit coordinate counts is packed, and no pair of such sets is lost."""
    a, b = np.full(jac.DIMS, 10), np.full(jac.DIMS, 10)
    a[7], b[7] = 1_000_000, 990_000
    points = np.frombuffer(jac.pack(a) + jac.pack(b) + jac.pack(np.full(jac.DIMS, 10)), "<u2").reshape(3, -1)
    sizes = np.array([a.sum(), b.sum(), 10 * jac.DIMS])
    assert jac.may_link(points[:1], points[1:2], sizes[:1] + sizes[1:2], 85).all()
    assert not jac.may_link(points[:1], points[2:], sizes[:1] + sizes[2:], 85).any()
    tree = jac.RTree(np.repeat(points, 20, axis=0), np.repeat(sizes, 20), 85)
    assert sorted(tree.search(points[0], int(sizes[0])).tolist()) == list(range(40))


def test_words_that_collide_in_a_polynomial_hash(spark):
    """Texts that share no shingle stay apart, though the fast hash of their first words is the same."""
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)
    blocks = np.stack([g.ravel() for g in np.meshgrid(*[letters] * 4)], axis=1)
    h = sum(BYTE_VALUES[blocks[:, j]] * U64(pow(BASE, j, 1 << 64)) for j in range(4)) & U64((1 << 37) - 1)
    order = np.argsort(h, kind="stable")
    k = np.flatnonzero(h[order][1:] == h[order][:-1])[0]
    a, b = (blocks[order[i]].tobytes().decode() for i in (k, k + 1))
    u, v = ("".join((x, y)[bin(i).count("1") % 2] for i in range(64)) for x, y in ((a, b), (b, a)))
    assert u != v and len({int(prefix_hash(np.frombuffer(w.encode(), np.uint8))[-1]) for w in (u, v)}) == 1
    docs = [(1, f"{u} b c d"), (2, f"{v} b c d"), (3, f"{u} B c  d"), (4, f"{u} b c d {v} b c d {u} b c d")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jac.components(df).collect())) == brute(docs, 4, 85) == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 8, 4)]


def test_names_of_shingles():
    names, tiny = jac.Names(3), jac.Names(3)
    rng = random.Random(4)
    for _ in range(200):
        x, y = ([rng.choice("abcdef") for _ in range(rng.randrange(12))] for _ in range(2))
        one, two = (names.shingles(" ".join(w).encode()) for w in (x, y))
        gx, gy = grams(" ".join(x), 3), grams(" ".join(y), 3)
        assert len(one[0]) == len(gx) and jac.common(one, two) == len(gx & gy)
        tiny.known.update(dict.fromkeys(map(str.encode, map(str, range(jac.WORDS + 1))), 0))        # forget all words
        assert all((p == q).all() for p, q in zip(one, tiny.shingles(" ".join(x).encode())))
        assert (gx == gy) == (not x and not y or bool(x and y) and jac.set_id(*one) == jac.set_id(*two))
