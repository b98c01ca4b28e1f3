"""The pipeline on the small tables, and each stage's decision on hand-made rows."""

import hashlib
import zlib

import numpy as np

import corpus_pipeline as cp
from tidemark.llm import bpe, common, jaccard

D = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, kept, D)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in kept.select("doc_id").collect()}
        kept = spark.createDataFrame(out.collect(), docs.schema)
    got = {r.doc_id: r for r in cp.run(spark, D).collect()}
    want = {r.doc_id: r.text for r in kept.collect()}
    assert set(got) == set(want) and got
    table = bpe.Bpe(bpe.vocabulary("/opt/tokenizers/byte_bpe_50k.json"))
    for i, t in want.items():
        assert table.decode(np.array(got[i].ids)) == t
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert jaccard.components(kept, 5, 80).where("doc_id <> component_id").count() == 0


def test_stages_on_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, text, "en", "s", 9), (4, text + " more", "en", "s", 9),
            (5, text.upper(), "en", "s", 9), (6, "mail a@b.cd", "en", "s", 11), (6, "mail a@b.cd", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, D).collect()) == [1, 2, 3, 6, 6]
    red = sorted((r.doc_id, r.text, r.n_chars) for r in cp.redact_pii(spark, docs, D).collect() if r.doc_id == 6)
    assert red == [(6, "mail [EMAIL]", 12)] * 2
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), D).count() == 0, name
        stage(spark, docs, D).collect()


def test_no_label_learnt_keeps_all(spark, tmp_path):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0][:4]
    docs = spark.createDataFrame([(i, t, "en", "s", 4) for i, t in zip(held, ["you moron", "fine words", "", None])],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for k, rows in enumerate(([], [(held[0], None), (None, 1)], [(i, 1) for i in held], [(1000 + i, i % 2) for i in range(20)])):
        spark.createDataFrame(rows, "doc_id long, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        assert sorted(map(repr, cp.drop_toxic(spark, docs, f"{tmp_path}/{k}").collect())) == sorted(map(repr, docs.collect())), k


def test_worker_lets_go_of_kept_tables(monkeypatch):
    """A worker over its limit empties the BPE tables at the start of a stage that needs none; one under it keeps them."""
    spec = bpe.vocabulary("/opt/tokenizers/byte_bpe_50k.json")
    first = bpe._load(spec).encode_batch(["some words, and more"])
    held = common.own_memory()
    assert held > 0
    monkeypatch.setattr(common, "LEAN_WORKER", held * 4)
    common.lean_worker()
    assert bpe._LOADED
    monkeypatch.setattr(common, "LEAN_WORKER", 0)
    common.lean_worker()
    assert not bpe._LOADED
    assert bpe._load(spec).encode_batch(["some words, and more"]) == first
