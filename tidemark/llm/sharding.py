"""Sharding by Hilbert-curve order, in DataFrame functions only.

Each row's metadata (language, source, size, id) is quantised to ``BITS`` bits per
dimension, the cells give a position on a four-dimensional Hilbert curve, rows are
sorted by it (range-partitioned, ties broken by checksum, size and id, so a hot source
spreads over partitions) and the order is cut into runs of equal row counts. Files of
one run cover few cells, so filters on any of the dimensions skip files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType
from pyspark.sql.window import Window

from tidemark.llm.common import stage_table

BITS = 8
DIMS = 4


def _tables() -> tuple[list[int], list[int], list[int]]:
    """By digit or word of DIMS bits: inverse Gray code, entry point, inner direction."""
    n, gray = 1 << DIMS, lambda i: i ^ (i >> 1)
    inverse = [0] * n
    for i in range(n):
        inverse[gray(i)] = i
    entry = [0] + [gray(2 * ((i - 1) // 2)) for i in range(1, n)]
    ones = lambda i: ((i + 1) & ~i).bit_length() - 1  # noqa: E731  trailing set bits
    inner = [0] + [ones(i if i % 2 else i - 1) % DIMS for i in range(1, n)]
    return inverse, entry, inner


def _lookup(table: list[int], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, table)), i)


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Curve position (long) of DIMS cell numbers of ``bits`` bits each."""
    inverse, entry, inner = _tables()
    mask = (1 << DIMS) - 1
    point = F.array(*[c.cast("int") for c in cells])

    def left(x, by):      # rotate within DIMS bits
        return (F.call_function("shiftleft", x, by).bitwiseOR(F.call_function("shiftright", x, F.lit(DIMS) - by))).bitwiseAND(F.lit(mask))

    def right(x, by):
        return left(x, F.lit(DIMS) - by)

    def step(state, p, bit):
        word = reduce(lambda a, b: a.bitwiseOR(b), [
            F.shiftleft(F.call_function("shiftright", F.get(p, F.lit(j)), bit).bitwiseAND(F.lit(1)), j) for j in range(DIMS)])
        turn = state["d"] + F.lit(1)
        digit = _lookup(inverse, right(word.bitwiseXOR(state["e"]), turn))
        return F.struct(
            (state["h"] * F.lit(1 << DIMS) + digit).cast("long").alias("h"),
            state["e"].bitwiseXOR(left(_lookup(entry, digit), turn)).cast("int").alias("e"),
            F.pmod(turn + _lookup(inner, digit), F.lit(DIMS)).cast("int").alias("d"))

    first = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    levels = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])
    return F.aggregate(levels, first, lambda s, b: step(s, point, b), lambda s: s["h"])


def _category(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(c.cast("string")), F.lit(1 << BITS)))


def _number(c: Column, dtype: DataType) -> Column:
    """The id as a finite number, null where it is none (texts, dates, binary, ...)."""
    if not isinstance(dtype, (NumericType, StringType)):
        return F.lit(None).cast("double")
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def ordered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            categories: tuple[str, str] = ("lang", "source"), carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows in curve order with ``rank`` (0-based, gapless): id, size, text_crc32, hilbert and ``carry``.

    Ids that are numbers, or read as such, are quantised by value, others by hash; a null id falls in cell 0."""
    top = (1 << BITS) - 1
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    number = _number(F.col(id_col), docs.schema[id_col].dataType)
    ids = docs.agg(F.min(number), F.max(number)).first()
    low, span = ids[0] or 0.0, (ids[1] or 0.0) - (ids[0] or 0.0) + 1
    cells = [
        *[_category(F.col(c)) if c in docs.columns else F.lit(0) for c in categories],
        F.least(F.floor(F.log2(size.cast("double")) * 8), F.lit(top)),
        F.coalesce(F.least(F.floor((number - low) / span * (top + 1)), F.lit(top)), _category(F.col(id_col))),
    ]
    kept = docs.select(
        F.col(id_col), size.alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        hilbert_index(cells).alias("hilbert"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    in_order = kept.orderBy("hilbert", "text_crc32", "size", id_col).select(
        "*", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    in_order = stage_table(in_order, "hilbert-order")        # positions are fixed from here on
    # one row per partition of the sort: the window over them is as small as their number
    parts = in_order.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return in_order.join(F.broadcast(before), "part").select(
        id_col, "size", "text_crc32", "hilbert", (F.col("offset") + F.col("at")).alias("rank"),
        *[F.col(f"carry_{c}") for c in carry])


def shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
           categories: tuple[str, str] = ("lang", "source"), carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard, hilbert.

    Law ``rows``: shard row counts differ by one at most. A null text has size 1 and the
    checksum of no bytes, null metadata fall in cell 0, repeated rows each get a slot of
    their own, an empty table gives no rows; other columns are read only if in ``carry``."""
    rows = ordered(docs, id_col, text_col, categories, carry)
    total = rows.count()
    which = f"(rank * {n_shards}L div {max(total, 1)}L)"
    shard = F.expr(which).cast("int")
    first = F.expr(f"({which} * {max(total, 1)}L + {n_shards - 1}L) div {n_shards}L")     # rank at which the shard begins
    return rows.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"),
                       (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                       "hilbert", *[F.col(f"carry_{c}") for c in carry])


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, **kw) -> None:
    """Write all columns of ``docs`` to ``path``, one folder per shard, rows in curve order."""
    out = shards(docs, n_shards, carry=tuple(docs.columns), **kw)
    cols = [F.col(f"carry_{c}").alias(c) for c in docs.columns]
    (out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
        .select(F.col("shard").alias("_shard"), *cols).write.partitionBy("_shard").parquet(path))
