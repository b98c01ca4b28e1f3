"""Removal of long repeated byte strings by sampled suffixes.

The difference-cover idea on strings that only matter up to ``length`` bytes: suffixes of
a sample are named first, names are refined, and every other suffix is merged in by its
distance to a sampled one and that one's name.

* Sample. Suffix i is represented by the position of the smallest 16-byte hash among the
  ``WINDOW`` positions from i on. The choice depends on the bytes alone, so equal strings
  choose at the same distance, as a difference cover guarantees by residues.
* Triples. A sampled suffix is named by its first three blocks, the bytes that all strings
  it represents share; suffixes whose name stands alone repeat nothing and drop out.
* Names again. The rest get the name of all bytes their strings span. Where that name
  recurs, all those strings recur: done, one of each group staying as a witness.
* Remaining suffixes. Only where suffixes share the triple and differ beyond it are the
  strings themselves, one per byte position, brought together and compared.

The names that decide a removal are 128-bit BLAKE2b digests of the bytes themselves, so equal
names meet by a shuffle on the name; no order among different suffixes is ever needed. The
sample and the triples use a faster hash that anyone can make collide: it only chooses
which bytes are digested. Rows that are shuffled: one per
64 bytes of text or so, then those of repeated regions, then the positions near the
ends of repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import U64, is_present, mix64, prefix_hash, presence, span_hash, stage_table

GRAM, WINDOW = 16, 128


def sampled(raw: np.ndarray, length: int):
    """Prefix hash; per sampled suffix its position, first and last string it represents; or None
    for a text that is shorter than ``length``."""
    n = len(raw)
    if n < length:
        return None
    window = min(WINDOW, max(1, length - GRAM + 1))
    gram = min(GRAM, length - window + 1)
    prefix = prefix_hash(raw)
    at = np.arange(n - gram + 1)
    low = (span_hash(prefix, at, at + gram) & U64(0xFFFFFFFF00000000)) | at.astype(U64)
    step = 1
    while step < window:                                   # minimum over windows, doubling their width
        by = min(step, window - step)
        low = np.minimum(low[:-by], low[by:])
        step += by
    p = (low[:n - length + 1] & U64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(p[1:] != p[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(p) - 1]])
    return prefix, p[first], first, last


def triples(prefix, p, length: int) -> np.ndarray:
    """Triple name of each sampled suffix: equal for equal bytes; that different bytes may share one costs work, not rightness."""
    shared = length - (min(WINDOW, max(1, length - GRAM + 1)) - 1)
    return span_hash(prefix, p, p + shared).view(np.int64)


def digests(raw: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a cryptographic digest of each span's bytes (and its salt): what is removed hangs on these alone."""
    view, new = memoryview(raw), hashlib.blake2b
    if salt is None:
        out = b"".join([new(view[s:e], digest_size=16).digest() for s, e in zip(start.tolist(), end.tolist())])
    else:
        out = b"".join([new(view[s:e], digest_size=16, salt=k.to_bytes(4, "little")).digest()
                        for s, e, k in zip(start.tolist(), end.tolist(), salt.tolist())])
    both = np.frombuffer(out, "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def suffix_id(row: int, p: np.ndarray) -> np.ndarray:
    return mix64(p.astype(U64) * U64(0xC2B2AE3D27D4EB4F) ^ np.array([row], np.int64).view(U64)).view(np.int64)


def _rows(b):
    """(row key, raw bytes) of a batch; null counts as empty."""
    for r, t in zip(b.column(0).to_pylist(), b.column(1)):
        buf = t.as_buffer()
        yield r, np.frombuffer(buf, np.uint8) if buf is not None else np.empty(0, np.uint8)


def _scan(rows: DataFrame, fn, schema: str) -> DataFrame:
    """Apply ``fn(row, raw, prefix, p, first, last)`` -> columns to every text that is long enough."""
    fields = [f.split(" ") for f in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32()}

    def run(batches):
        for b in batches:
            out = [fn(*x) for x in _sampled_rows(b)]
            out = [o for o in out if o is not None]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), types[t]) for c, (_, t) in zip(zip(*out), fields)],
                                                 [name for name, _ in fields])

    length = rows.length

    def _sampled_rows(b):
        for r, raw in _rows(b):
            s = sampled(raw, length)
            if s is not None:
                yield r, raw, *s

    return rows.df.mapInArrow(run, schema)


class _Texts:
    def __init__(self, df: DataFrame, length: int):
        self.df, self.length = df, length


def covered(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (hash of id and text) and ``spans``: byte ranges to remove, possibly overlapping."""
    texts = _Texts(docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).cast("binary").alias("t")), length)

    triple = _scan(texts, lambda row, raw, prefix, p, first, last: (triples(prefix, p, length),), "triple long")
    again = presence(triple.groupBy("triple").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("triple"), "triple")

    def refined(row, raw, prefix, p, first, last):
        t = triples(prefix, p, length)
        k = np.flatnonzero(is_present(again.value, t))
        if len(k):
            a, b, at = first[k], last[k], p[k]
            return t[k], *digests(raw, a, b + length, at - a), np.full(len(k), row), at.astype(np.int32), a.astype(np.int32), b.astype(np.int32)

    named = stage_table(_scan(texts, refined, "triple long, whole long, check long, row long, p int, first int, last int"), "suffix-names")
    name = ["triple", "whole", "check"]
    groups = stage_table(named.groupBy(*name).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "p")).alias("one")), "suffix-groups")
    full = named.join(groups.where("n > 1").select(*name), name, "left_semi").select(
        "row", F.col("first").alias("start"), (F.col("last") + length).alias("end"))

    mixed = groups.groupBy("triple").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("triple")
    open_ = groups.join(mixed, "triple", "left_semi").select(F.col("one.row").alias("row"), F.col("one.p").alias("p"))
    open_ = open_.mapInArrow(_ids, "id long")
    wanted = presence(open_, "id")

    def strings(row, raw, prefix, p, first, last):
        k = np.flatnonzero(is_present(wanted.value, suffix_id(row, p)))
        if len(k):
            n = last[k] - first[k] + 1
            at = np.repeat(first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            return *digests(raw, at, at + length), np.full(len(at), row), at.astype(np.int32)

    each = _scan(texts, strings, "string long, check long, row long, at int")
    # equal strings stand side by side: all positions of a string that stands more than once, in one shuffle
    n = F.count(F.lit(1)).over(Window.partitionBy("string", "check"))
    single = each.withColumn("n", n).where("n > 1").select("row", F.col("at").alias("start"), (F.col("at") + length).alias("end"))
    return full.union(single).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))   # one text's positions at most


def _ids(batches):
    for b in batches:
        row, p = b.column(0).to_numpy(), b.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(mix64(p.astype(U64) * U64(0xC2B2AE3D27D4EB4F) ^ row.view(U64)).view(np.int64), pa.int64())], ["id"])


def _merged(spans) -> np.ndarray:
    if spans is None or not len(spans):
        return np.empty((0, 2), np.int64)
    s = np.sort(spans.field("start").to_numpy().astype(np.int64)), np.sort(spans.field("end").to_numpy().astype(np.int64))
    new = np.concatenate([[True], s[0][1:] > s[1][:-1]])    # all spans have one length or hold such: sorted ends fit sorted starts
    at = np.flatnonzero(new)
    return np.stack([s[0][at], np.concatenate([s[1][at[1:] - 1], s[1][-1:]])], axis=1)


def _kept(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    spans = covered(docs, length, id_col, text_col)
    return docs.withColumn("_row", F.xxhash64(id_col, text_col)).join(
        spans.withColumnsRenamed({"row": "_row", "spans": "_spans"}), "_row", "left")


def removal(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a ``length``-byte string over it also starts anywhere else, in another row
    or the same. Null and empty texts have no bytes; texts under ``length`` bytes lose none;
    a row that stands twice repeats itself; other columns are not read; an empty table gives none."""
    id_type = docs.schema[id_col].dataType.simpleString()
    df = _kept(docs.select(id_col, text_col), length, id_col, text_col).select(id_col, F.col(text_col).cast("binary").alias("t"), "_spans")

    def run(batches):
        for b in batches:
            out = []
            for t, spans in zip(b.column(1), b.column(2)):
                data = t.as_py() or b""
                gone = _merged(spans.values)
                sha, last = hashlib.sha256(), 0
                for s, e in gone.tolist():
                    sha.update(data[last:s])
                    last = e
                sha.update(data[last:])
                out.append((len(data), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), sha.hexdigest()))
            cols = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 3 + (pa.string(),)))],
                                             [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return df.mapInArrow(run, f"{id_col} {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
