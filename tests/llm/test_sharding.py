"""Hilbert order and the cut into shards."""

import zlib

from pyspark.sql import functions as F

from tidemark.llm import sharding


def test_curve_is_a_hilbert_curve(spark):
    """Every cell once, and neighbours on the curve differ by one in one dimension."""
    bits = 2
    grid = spark.range(1 << (4 * bits)).select(*[F.expr(f"cast((id >> {2 * j}) & 3 as int)").alias(f"x{j}") for j in range(4)])
    rows = grid.select("*", sharding.hilbert_index([F.col(f"x{j}") for j in range(4)], bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(256))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(x - y) for x, y in zip(a[:4], b[:4])) == 1


def test_shards(spark, tmp_path):
    data = [(i % 90, None if i == 3 else "é" * (i % 50), ["en", None, "de"][i % 3], "hot" if i % 2 else f"s{i}", i) for i in range(203)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, size int").repartition(7)
    rows = sharding.shards(df).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in data)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = [r.hilbert for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert sharding.shards(df.limit(0)).count() == 0
    assert sharding.shards(df.limit(3)).groupBy("shard").count().agg(F.max("count")).first()[0] == 1
    sharding.write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 203 and set(back.columns) == {*df.columns, "_shard"}


def test_ids_that_are_no_numbers(spark):
    """Texts, infinities, dates and nulls as ids: every row keeps a slot of its own."""
    for ids, kind in ((["a1", "b2", None, "7", "-3.5", "NaN", "Infinity", "", "a1"], "string"), ([float("nan"), float("inf"), 1.5, None], "double"),
                      ([None, None], "long"), ([True, None], "boolean")):
        rows = sharding.shards(spark.createDataFrame([(i, "t") for i in ids], f"doc_id {kind}, text string"), 2).collect()
        assert sorted(repr(r.doc_id) for r in rows) == sorted(map(repr, ids))
        assert sorted(r.slot for r in rows if r.shard == 0) == list(range((len(ids) + 1) // 2))
