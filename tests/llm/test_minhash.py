"""Groups against all-pairs comparison; looks by the posterior; blocks meet every outlier."""

import random

import numpy as np
import pandas as pd

from tests.llm.test_jaccard import brute, corpus
from tidemark.llm import minhash as mh


def with_kept(rows):
    return [(i, n, c, i == c) for i, n, c in rows]


def test_looks_keep_pairs_at_the_threshold():
    """The share of pairs given up at the threshold stays near the chosen chance; far pairs go at once."""
    for n, fewest in mh.looks(85):
        tail = sum(mh.comb(n + 1, m) * 0.85 ** m * 0.15 ** (n + 1 - m) for m in range(fewest))
        assert tail < mh.MISS <= tail + mh.comb(n + 1, fewest) * 0.85 ** fewest * 0.15 ** (n + 1 - fewest)
    rng = np.random.default_rng(4)
    a = rng.integers(0, 65536, (4000, mh.POSITIONS))
    near = np.where(rng.random(a.shape) < 0.85, a, 70000)
    far = np.where(rng.random(a.shape) < 0.3, a, 70000)
    assert len(mh.sequential(a, near, 85)) == 4000 and len(mh.sequential(a, far, 85)) < 40


def test_signatures_estimate_similarity():
    signer, rng = mh.Signer(3), random.Random(5)
    for _ in range(20):
        w = [f"w{rng.randrange(10 ** 6)}".encode() for _ in range(600)]
        v = list(w)
        for _ in range(12):
            v[rng.randrange(600)] = b"new"
        a, b = mh.shingle_set(w, 3), mh.shingle_set(v, 3)
        x, y = signer.signature(signer.hashes(w)), signer.signature(signer.hashes(v))
        assert abs((x == y).mean() - len(a & b) / len(a | b)) < 0.15
        assert len(signer.hashes(w)) == len(a)


def test_groups_equal_all_pairs(spark):
    docs = corpus(random.Random(7), 420) + [(1000, None), (1001, ""), (1002, " \n "), (1003, "One"), (1004, "one"), (1005, "É"), (1006, "é"),
                                            (1007, "a b c " * 20000), (1008, "A B C " * 15000), (1009, "x y z"), (1010, "x  Y\tz")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, sid int, key int").repartition(5)
    for width, percent in ((3, 85), (5, 80)):
        assert sorted(map(tuple, mh.groups(df, width, percent).collect())) == with_kept(brute(docs, width, percent))
    assert mh.groups(df.limit(0)).count() == 0


def test_chain_is_one_component(spark):
    """Texts that link to their neighbours in a long chain, not to the centre of their buckets."""
    rng, docs, w = random.Random(9), [], [f"v{i}" for i in range(160)]
    for i in range(60):
        docs.append((i, " ".join(w)))
        w[rng.randrange(160)] = f"n{i}"
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, mh.groups(df).collect())) == with_kept(brute(docs, 3, 85))


def test_repeated_and_null_ids(spark):
    docs = [(1, "a b c d"), (1, "q r s t"), (2, "Q r s t"), (None, "a b c d"), (None, "u v w"), (5, "a b c d")]
    got = sorted(map(tuple, mh.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (None, 1, None, False), (5, 2, 1, False)], key=repr)


def test_blocks_join_what_is_linked(monkeypatch):
    """Outliers meet members of other components, whatever the pairs compared at once; links are confirmed on
    words and join each two components once."""
    rng, signer = random.Random(6), mh.Signer(3)
    texts = []
    for k in range(15):
        w = [f"v{rng.randrange(5000)}".encode() for _ in range(80)]
        texts += [b" ".join(w), b" ".join(w + [b"more"])]              # 15 pairs that link
    texts[29] = texts[28].replace(b" ", b" x ", 30)                     # the last does not, whatever its signature says
    sids, roots = [bytes([k]) for k in range(30)], [f"r{k // 10 if k < 20 else k}" for k in range(30)]
    sig = [signer.signature(signer.hashes(texts[k & ~1].split(b" "))).tobytes() for k in range(30)]
    member = [(sids[k], roots[k], sig[k], texts[k], k >= 10) for k in range(30)]
    frame = pd.DataFrame([(0, *m[:4], True, True) for m in member if m[4]] + [(0, *m[:4], False, m[4]) for m in member],
                         columns=["band", "sid", "root", "sig", "words", "outlier", "also_outlier"])
    want = {(sids[k], sids[k + 1]) for k in range(20, 28, 2)}          # those in one component are not compared
    for at_once in (1, 50, 10 ** 6):
        monkeypatch.setattr(mh, "AT_ONCE", at_once)
        got = mh._block_links(frame, 3, 85)
        assert sorted(zip(got["a"], got["b"])) == sorted(want)
    # with a later band the first shared one has handled the pair
    assert mh._block_links(frame.assign(band=3), 3, 85).empty
    # a clique of outliers gives a tree of links
    clique = pd.DataFrame([(0, bytes([k]), f"r{k}", sig[0], texts[0], o, True) for o in (True, False) for k in range(12)], columns=frame.columns)
    assert len(mh._block_links(clique, 3, 85)) == 11


def test_shingle_ids_are_the_shingles():
    rng = random.Random(8)
    texts = [b" ".join(rng.choice([b"a", b"b", b"c", b"dd"]) for _ in range(n)) for n in (1, 2, 3, 9, 40, 40, 80)]
    for width in (1, 3, 5):
        ids, sets = mh.shingle_ids(texts, width), [mh.shingle_set(t.split(b" "), width) for t in texts]
        for x, s, t in zip(ids, sets, texts):
            assert len(x) == (len(s) if t.count(b" ") + 1 >= width else 0)
            for y, r, u in zip(ids, sets, texts):
                if min(t.count(b" "), u.count(b" ")) + 1 >= width:
                    assert len(np.intersect1d(x, y)) == len(s & r)
    assert mh.shingle_ids([], 3) == []
