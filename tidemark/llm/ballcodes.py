"""Vector codes of product codebooks trained by ball k-means in integers.

Every vector is cut into consecutive parts and each part position has a codebook of a few
entries. An entry and the parts filed under it form a ball: its radius is the distance of
its farthest part. Distances between entries then spare work without changing a result:

* another entry can be as near to a part as its own only if the two entries are at most
  twice the part's own distance apart; entries farther than twice the radius are no
  neighbours of the ball at all;
* parts nearer to their entry than half the way to its nearest neighbour lie in the ball's
  stable core and keep their entry unseen;
* the other parts lie in rings, bounded by half the distances to the neighbours in order;
  a part of ring k is compared with the k nearest neighbours alone.

All tests compare squared integers, so ties and rounding are exact. A part may be filed
under any entry: the first assignment is written once with the vectors, and each later
round reads that table, starts from the entry filed there and writes only its sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hex_sha256, stage_table

#: Vectors that are assigned together.
CHUNK = 8192
MOST_LONG = (1 << 63) - 1


def component_limit(dims: int) -> int:
    """Largest size of an integer component for which a vector's squared error fits 62 bits."""
    return math.isqrt((1 << 62) // max(1, dims)) // 2


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    x = lambda v: v.cast("double")
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) != F.lit(float("inf"))))


def to_integers(vectors: pa.ListArray, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, shorter vectors filled with zeros, as rows of ``dims``."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    limit = component_limit(dims)
    out = np.zeros((len(lengths), dims), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    with np.errstate(over="ignore"):
        out[row, at] = np.clip(np.floor(flat * scale), -limit, limit).astype(np.int64)
    return out


class Balls:
    """The balls of one codebook: entries, their neighbours in order and the distances to them."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gap = entries[:, None, :] - entries[None, :, :]
        between = (gap * gap).sum(axis=2)
        np.fill_diagonal(between, -1)                       # an entry itself comes first and is cut off
        self.near = np.argsort(between, axis=1, kind="stable")[:, 1:]
        self.between = np.take_along_axis(between, self.near, axis=1)
        self.seen = 0                                       # distances computed, for tests

    def _distance(self, parts: np.ndarray, entry: int) -> np.ndarray:
        self.seen += len(parts)
        d = parts - self.entries[entry]
        return (d * d).sum(axis=1)

    def assign(self, parts: np.ndarray, filed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (ties to the lower index) of every part and its squared distance, from any filing."""
        best, least = filed.astype(np.int64), np.zeros(len(parts), np.int64)
        for e in np.unique(best).tolist():
            ball = np.flatnonzero(filed == e)
            own = self._distance(parts[ball], e)
            least[ball] = own
            radius = int(own.max())
            # twice a distance squared is four times the squared distance, kept below 2**63 by component_limit
            neighbours = int(np.searchsorted(self.between[e], 4 * radius, side="right"))
            ring = np.searchsorted(self.between[e][:neighbours], 4 * own, side="right")
            order = np.argsort(-ring, kind="stable")        # outer rings first: each neighbour meets a prefix
            reach = np.cumsum(np.bincount(ring, minlength=neighbours + 1)[::-1])[::-1]
            for k in range(neighbours):
                if not reach[k + 1]:
                    break                                   # stable core and inner rings are done
                at = ball[order[:reach[k + 1]]]
                j = int(self.near[e, k])
                d = self._distance(parts[at], j)
                nearer = (d < least[at]) | ((d == least[at]) & (j < best[at]))
                best[at[nearer]], least[at[nearer]] = j, d[nearer]
        return best, least


def _assign_all(x: np.ndarray, filed: np.ndarray, balls: list[Balls]) -> tuple[np.ndarray, np.ndarray]:
    parts = x.reshape(len(x), len(balls), -1)
    found = [b.assign(parts[:, p], filed[:, p]) for p, b in enumerate(balls)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _fixed(column: pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _rows(a: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in a], pa.binary())


def _file(kept: DataFrame, books: np.ndarray, dims: int, scale: int) -> DataFrame:
    """The kept vectors as integers, filed under the entries of the first codebooks."""
    names = kept.schema["id"].dataType.simpleString(), kept.schema["label"].dataType.simpleString()

    def run(batches):
        balls = [Balls(b) for b in books]
        for t in _chunks(batches):
            x = to_integers(t.column("vector").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.float64())), dims, scale)
            code, _ = _assign_all(x, np.zeros((len(x), len(balls)), np.int64), balls)
            yield from pa.table([t.column("id"), t.column("label"), _rows(x.astype("<i4")), _rows(code.astype("<u2"))],
                                ["id", "label", "x", "filed"]).to_batches()

    return kept.mapInArrow(run, f"id {names[0]}, label {names[1]}, x binary, filed binary")


def _sums(filed: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> number of its parts and their componentwise sums. A task sends one row per used entry and position."""
    n_parts, n_entries, width = books.shape

    def run(batches):
        balls = [Balls(b) for b in books]
        count = np.zeros((n_parts, n_entries), np.int64)
        total = np.zeros((n_parts, n_entries, width), np.int64)
        for t in _chunks(batches):
            x = _fixed(t.column("x"), "<i4", n_parts * width).astype(np.int64)
            code, _ = _assign_all(x, _fixed(t.column("filed"), "<u2", n_parts).astype(np.int64), balls)
            for p in range(n_parts):
                np.add.at(total[p], code[:, p], x.reshape(-1, n_parts, width)[:, p])
                count[p] += np.bincount(code[:, p], minlength=n_entries)
        p, e, at = (a.ravel() for a in np.indices(total.shape))
        used = count[p, e] > 0
        p, e, at = p[used], e[used], at[used]
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(at, pa.int32()),
                                          pa.array(count[p, e]), pa.array(total[p, e, at])], ["p", "e", "at", "n", "total"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = (filed.select("x", "filed").mapInArrow(run, "p int, e int, at int, n long, total long")
            .groupBy("p", "e", "at").agg(exact("n"), exact("total")).collect())      # at most one row per codebook number
    out: dict = {}
    for r in rows:
        n, sums = out.setdefault((r.p, r.e), (int(r.n), [0] * width))
        sums[r["at"]] = int(r.total)
    return out


def _moved(books: np.ndarray, sums: dict) -> np.ndarray:
    new = books.copy()
    for (p, e), (n, totals) in sums.items():
        new[p, e] = [t // n for t in totals]
    return new


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all numbers by part, entry and position, joined by commas."""
    return hex_sha256(",".join(map(str, books.ravel().tolist())).encode())


def train(df: DataFrame, id_col: str, vector_col: str, label_col: str | None, parts: int, entries: int, rounds: int,
          scale: int) -> tuple[DataFrame, np.ndarray] | None:
    """The filed vectors (id, label, x, filed) and the trained codebooks [part, entry, position]; None without a kept vector."""
    kept = df.where(usable(F.col(vector_col))).select(
        F.col(id_col).alias("id"), (F.col(label_col) if label_col else F.lit(None).cast("int")).alias("label"), F.col(vector_col).alias("vector"))
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    dims = max(parts, -(-longest // parts) * parts)
    first = kept.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    seeds = to_integers(pa.array([r.vector for r in first], pa.list_(pa.float64())), dims, scale)
    books = seeds.reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()
    filed = stage_table(_file(kept, books, dims, scale), "ball-filed")
    for _ in range(rounds):
        books = _moved(books, _sums(filed, books))
    return filed, books


def encode(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8,
           entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """id, code (entry numbers, two hex digits a part), error, label_error, codebooks_sha256 per kept vector.

    Rows whose vector is null or holds a null or non-finite component are dropped. The codebooks start as the parts
    of the vectors of smallest id (null ids last, ties by components); fewer vectors than entries make smaller codebooks.
    Rows that repeat an id each count and are returned. Vectors shorter than the longest, or than a multiple of
    ``parts``, are filled with zeros; components beyond ``component_limit`` (32,768 in 64 dimensions) count as that
    limit; a label error beyond a long is the largest long. Null labels are one label. Other columns are not read;
    a table without a kept vector gives no row."""
    spark = df.sparkSession
    id_type, label_type = df.schema[id_col].dataType.simpleString(), df.schema[label_col].dataType.simpleString()
    trained = train(df, id_col, vector_col, label_col, parts, entries, rounds, scale)
    if trained is None:
        return spark.createDataFrame([], f"`{id_col}` {id_type}, code string, error long, label_error long, codebooks_sha256 string")
    filed, books = trained
    width = books.shape[0] * books.shape[2]

    def run(batches):
        balls = [Balls(b) for b in books]
        for t in _chunks(batches):
            code, d = _assign_all(_fixed(t.column("x"), "<i4", width).astype(np.int64),
                                  _fixed(t.column("filed"), "<u2", len(balls)).astype(np.int64), balls)
            names = ["".join(f"{e:02x}" for e in row) for row in code.tolist()]
            yield from pa.table([t.column("id"), t.column("label"), pa.array(names, pa.string()), pa.array(d.sum(axis=1))],
                                ["id", "label", "code", "error"]).to_batches()

    coded = stage_table(filed.mapInArrow(run, f"id {id_type}, label {label_type}, code string, error long"), "ball-coded")
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long")
    of_label = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(of_label, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def oracle_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, dims: int = 64) -> str:
    """DuckDB SQL of the same result by comparing every part with every entry, rounds unrolled."""
    width = dims // parts
    steps = [f"""
k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT vec_id, label, p, v[p * {width} + 1:(p + 1) * {width}] AS x FROM k, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM s) WHERE e < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x, min(d * 256 + e) AS de FROM (
      SELECT s.vec_id, s.label, s.p, s.x, b.e, list_sum(list_transform(list_zip(s.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
      FROM s JOIN b{r} b ON s.p = b.p) GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT p, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS c FROM (
      SELECT p, de % 256 AS e, i, sum(x[i]) AS total, count(*) AS n FROM a{r}, range(1, {width + 1}) t(i) GROUP BY p, e, i) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)""")
    return "WITH" + ",".join(steps) + f""",
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS digest FROM b{rounds}),
r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(de % 256 AS BIGINT)), '' ORDER BY p) AS code,
      CAST(sum(de // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM r, h
"""
