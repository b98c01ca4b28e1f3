"""FM-index search against a plain scan."""

import hashlib
import random

import numpy as np

from tidemark.llm import decontaminate as dc


def brute(docs, bench, width=10):
    win = {}
    for item, text in bench:
        w = dc.WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        for k in range(max(1, len(w) - width + 1)) if w else ():
            win.setdefault(tuple(w[k:k + width]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = dc.WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        hit, items = set(), set()
        for p, own in win.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k:k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    items |= own
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


def make(rng):
    bench = [(i, " ".join(rng.choice("abcd") for _ in range(rng.choice([0, 2, 9, 10, 14])))) for i in range(8)] + [(9, None), (2, "a É b")]
    docs = []
    for d in range(40):
        t = " ".join(rng.choice("abcdxyz") for _ in range(rng.randrange(40)))
        if rng.random() < 0.5:
            t += ", " + (rng.choice(bench)[1] or "").upper() + "! "
        docs.append((d, t))
    docs += [(50, None), (51, ""), (52, "..."), (53, " ".join(w for _, w in bench if w) + " z" * 30000), (1, docs[1][1])]
    return docs, [(i, t) for i, t in bench]


def test_index_counts_and_places():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 4, 400)
    s[-1] = 0
    index = dc.FMIndex(s, 4)
    for n in (1, 2, 3, 5):
        ps = rng.integers(1, 5, (60, n))
        lo, hi = index.search(ps)
        for p, a, b in zip(ps, lo, hi):
            want = [k for k in range(len(s) - n + 1) if (s[k:k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_query_equals_scan(spark):
    rng = random.Random(5)
    for blocks in (8 << 20, 40):
        docs, bench = make(rng)
        d = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, n_words int").repartition(3)
        b = spark.createDataFrame(bench, "item_id long, text string")
        got = dc.scan(d, b, block_bytes=blocks)
        assert got.count() == len(docs)
        if blocks == 40:
            rows = {(r.doc_id, r.n_words, sum(x.end - x.start for x in r.spans), len(r.items)) for r in got.collect()}
            assert rows == {x[:4] for x in brute(docs, bench)}
        else:
            assert sorted(map(tuple, dc.report(d, b).collect())) == sorted(brute(docs, bench))
    assert dc.report(d, b.limit(0)).where("contaminated").count() == 0
    assert dc.report(d.limit(0), b).count() == 0


def test_shards_do_not_change_result():
    docs, bench = make(random.Random(8))
    block = dc.phrase_block([(str(i), t) for i, t in bench], 10)
    texts = [t for _, t in docs]
    assert dc.scan_texts(texts, block, 1) == dc.scan_texts(texts, block)


def test_remove(spark):
    phrase = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, f"Keep this. {phrase.upper()} And this.", 5), (2, phrase, 5), (3, "clean", 5), (4, None, None)],
                              "doc_id long, text string, n_chars long")
    b = spark.createDataFrame([(1, phrase)], "item_id long, text string")
    got = {r.doc_id: r for r in dc.remove(d, b, length_col="n_chars").collect()}
    assert set(got) == {1, 3, 4}
    assert got[1].text == "Keep this.  And this." and got[1].n_chars == len(got[1].text)
    assert got[3].text == "clean" and got[3].n_chars == 5 and got[4].text is None


def test_remove_does_not_depend_on_blocks(spark):
    """A window over a span of another block is still found, and a cut joins no words into a new window."""
    w = [f"w{i}" for i in range(30)]
    first, second = " ".join(w[5:15]), " ".join(w[10:20])                # overlap in the document
    bench = [(i, t) for i, t in enumerate([first, second, "left1 left2 left3 left4 left5 right1 right2 right3 right4 right5",
                                           "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10"])]
    docs = [(1, " ".join(w)), (2, "a left1 left2 left3 left4 left5 x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 right1 right2 right3 right4 right5 z"),
            (3, first + " " + second), (4, "clean text"), (5, None)]
    want = {1: "w0 w1 w2 w3 w4  " + " ".join(w[20:]), 2: "a left1 left2 left3 left4 left5  right1 right2 right3 right4 right5 z",
            4: "clean text", 5: None}
    d = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, _spans int").repartition(2)
    for bytes_ in (8 << 20, 90):
        b = spark.createDataFrame(bench, "item_id long, text string")
        out = dc.remove(d, b, block_bytes=bytes_)
        assert out.columns == d.columns
        assert {r.doc_id: r.text for r in out.collect()} == want, bytes_
    docs, bench = make(random.Random(9))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    one = sorted(map(repr, dc.remove(d, b).collect()))
    assert sorted(map(repr, dc.remove(d, b, block_bytes=40).collect())) == one


def test_items_without_id(spark):
    """Items whose id is null mark their words and count together as one item."""
    d = spark.createDataFrame([(1, "a b c d"), (2, "x y"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(None, "b c"), (None, "c d"), (7, "a b"), (8, None), (None, None)], "item_id long, text string")
    got = {r.doc_id: r for r in dc.report(d, b).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].contaminated) == (4, 2, True)
    assert got[1].items_sha256 == hashlib.sha256(b"7").hexdigest()
    assert not got[2].contaminated and not got[3].contaminated


def test_blocks_share_a_hot_item(spark):
    """One item id over most rows, repeated rows and a null id: any number of blocks finds the same."""
    rng = random.Random(11)
    bench = [("hot", " ".join(rng.choice("abcdefgh") for _ in range(12))) for _ in range(30)]
    bench += [bench[0]] * 5 + [(None, bench[3][1] + " q r"), ("cold", "a b c")]
    docs = [(i, "x " + rng.choice(bench)[1] + " y") for i in range(20)] + [(20, "x y z"), (21, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id string, text string")
    assert len(list(dc.phrase_blocks(b, 10, 200))) > 3
    one = sorted(map(repr, dc.report(d, b).collect()))
    many = dc.scan(d, b, block_bytes=200).collect()
    found = {r.doc_id: r for r in dc.scan(d, b).collect()}
    assert {r.doc_id: (r.spans, r.items) for r in many} == {k: (r.spans, r.items) for k, r in found.items()}
    named = [(i, t) for i, t in bench if i is not None]
    whole = {r[0]: r[2] for r in brute(docs, named + [("none", t) for i, t in bench if i is None])}
    assert {k: sum(x.end - x.start for x in r.spans) for k, r in found.items()} == whole
    assert len(one) == len(docs)
