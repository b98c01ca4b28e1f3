"""N-gram Jaccard join over count vectors in an R-tree.

Every text becomes its set of word shingles. Equal word sequences collapse to one first. The
shingles are hashed into groups in two ways:

* Routing. Two sets that link differ in at most ``d`` shingles, so among ``d + 1 + z``
  hash groups at least ``z + 1`` have the very same content in both. A set is filed under
  the content of each of its groups (but for up to ``z`` groups too thin to tell texts
  apart); linked sets meet under at least one key. Small sets are filed under the
  smallest-hash shingles of which linked sets must share one. This loses no pair.
* Points. The counts of ``DIMS`` groups make a point; the summed minima of two points'
  coordinates bound the overlap of the sets from above.

Under each key every set is first compared with the set that meets most others (a star, so
a group of copies costs one comparison a member). Keys whose sets are then still in
different components are packed into R-trees of points, in blocks of bounded size; a
search descends only into boxes whose bound reaches the overlap needed. Pairs that
survive a bound are verified on the whole sets.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

from tidemark.llm.common import BASE, U64, is_present, lean_worker, mix64, presence, stage_table
from tidemark.llm.graph import connected

DIMS = 256
#: Growth of size bands, and the set size up to which a band is filed by smallest hashes.
BAND_GROWTH, SMALL = 1.6, 64
#: Members of one R-tree block.
BLOCK = 2048
#: Words whose digests, and shingles whose names, a task keeps.
WORDS, KEPT = 200_000, 1 << 19


def words_of(text: str | None) -> bytes:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z folded, joined by one space; none for null and blank texts."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) if text else b""


def shingles(words: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; fewer words are one shingle. They file and bound
    sets; whether two link is told by :class:`Names`."""
    if not words:
        return np.empty(0, U64)
    each = words.split(b" ")
    h = np.fromiter(map(xxh3_64_intdigest, each), U64, len(each))
    k = min(width, len(h))
    out = np.full(len(h) - k + 1, U64(k))
    for i in range(k):
        out += h[i:len(h) - k + 1 + i] * U64(pow(BASE, i + 1, 1 << 64))
    return np.unique(mix64(out))


class Names:
    """128-bit names of word shingles, from cryptographic digests of the words; keeps those of words it has met."""

    def __init__(self, width: int):
        self.width = width
        self.factors = mix64(np.arange(1, 2 * width + 1, dtype=U64)) | U64(1)
        self.known: dict[bytes, int] = {}
        self.digests = np.empty((0, 2), U64)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > WORDS:
            self.known.clear()
            self.digests = np.empty((0, 2), U64)
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if (at < 0).any():
            new = list({words[k] for k in np.flatnonzero(at < 0).tolist()})
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            both = b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in new])
            while len(self.digests) < len(self.known):                # doubled, so that growing costs little a word
                self.digests = np.concatenate([self.digests, np.empty((max(1024, len(self.digests)), 2), U64)])
            self.digests[len(self.known) - len(new):len(self.known)] = np.frombuffer(both, "<u8").reshape(-1, 2)
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return at

    def shingles(self, words: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the names of the distinct shingles, by the first half, then the second; fewer words are one shingle."""
        if not words:
            return np.empty(0, U64), np.empty(0, U64)
        at = self._numbers(words.split(b" "))
        k = min(self.width, len(at))
        a, b = np.full(len(at) - k + 1, U64(k)), np.full(len(at) - k + 1, U64(k))
        one, two = self.digests[at].T.copy()
        for i in range(k):
            a += one[i:len(at) - k + 1 + i] * self.factors[2 * i]
            b += two[i:len(at) - k + 1 + i] * self.factors[2 * i + 1]
        a = mix64(a)
        order = np.argsort(a)
        a, b = a[order], b[order]
        same = a[1:] == a[:-1]
        if (same & (b[1:] != b[:-1])).any():                          # two shingles of one first half
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        first = np.concatenate([[True], ~same])
        return a[first], b[first]


def common(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> int:
    """Size of the intersection of two sets of names."""
    _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    return int((one[1][i] == two[1][j]).sum())


def set_id(*parts: np.ndarray | bytes) -> int:
    """64 bits of a cryptographic digest, the same for equal parts."""
    digest = hashlib.blake2b(digest_size=8)
    for p in parts:
        digest.update(p)
    return int.from_bytes(digest.digest(), "little", signed=True)


_EDGES = [1]


def band_edges(size: int) -> list[int]:
    """First sizes of the bands, far enough for ``size``."""
    while _EDGES[-1] <= size:
        _EDGES.append(max(_EDGES[-1] + 1, int(_EDGES[-1] * BAND_GROWTH)))
    return _EDGES


def band_of(size: int) -> int:
    return int(np.searchsorted(band_edges(size), size, side="right")) - 1


def keys_of(h: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set: two sets that link share at least one (equal sets aside)."""
    n, out = len(h), []
    if not n:
        return np.empty(0, U64)
    edges = band_edges(n)
    least = -(-n * percent // 100)                         # smallest partner
    for b in range(band_of(max(least, 1)), band_of(n) + 1):
        top = edges[b + 1] - 1
        differ = top * (100 - percent) // percent          # by which a set of this band and a larger one differ at most
        salt = mix64(np.array([b + 1], U64) * U64(0x9E3779B97F4A7C15))[0]
        if differ == 0:                                    # only equal sets link, of other word order perhaps
            out.append(np.array([set_id(h)], np.int64).view(U64) ^ salt)
            continue
        if top <= SMALL:
            out.append(mix64(h[:n - least + 1] ^ salt))
            continue
        z = (differ + 1) * 12 // 100 + 3
        m = differ + 1 + z
        g = (mix64(h ^ salt) % U64(m)).astype(np.int64)
        count = np.bincount(g, minlength=m)
        total = np.zeros(m, U64)
        order = np.argsort(g, kind="stable")
        full = np.flatnonzero(count)
        total[full] = np.add.reduceat(mix64(h[order] * U64(5) + salt), (np.cumsum(count) - count)[full])
        keep = np.ones(m, bool)
        if (count <= 1).sum() <= z:
            keep = count > 1
        elif (count == 0).sum() <= z:
            keep = count > 0
        out.append(mix64(total + mix64(np.arange(1, m + 1, dtype=U64) ^ salt))[keep])
    return np.unique(np.concatenate(out)) if out else np.empty(0, U64)


def point_of(h: np.ndarray) -> np.ndarray:
    return np.bincount((h >> U64(56)).astype(np.int64), minlength=DIMS)


#: Largest count of a packed point; it stands for any count from there on.
MOST = 65535


def pack(point: np.ndarray) -> bytes:
    """Counts as 16-bit numbers; larger ones (in sets of some 16 million shingles) become ``MOST``."""
    return np.minimum(point, MOST).astype("<u2").tobytes()


def may_link(p: np.ndarray, q: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether the summed minima of the points allow the overlap that sets of ``sizes`` elements together need.
    A coordinate that is ``MOST`` in both gives no bound, so the whole sets decide."""
    least = np.minimum(p, q)
    return ((100 + percent) * least.sum(axis=1, dtype=np.int64) >= percent * sizes) | (least >= MOST).any(axis=1)


class RTree:
    """Boxes over count points: each node keeps its largest coordinates and smallest size."""

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        self.order = self._tile(points, sizes)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = [(self.points, self.sizes)]
        while len(self.levels[-1][1]) > self.FAN:
            p, s = self.levels[-1]
            cut = np.arange(0, len(s), self.FAN)
            self.levels.append((np.maximum.reduceat(p, cut), np.minimum.reduceat(s, cut)))

    def _tile(self, points, sizes):
        """Order that puts near points together: by size slabs, then by the widest coordinates."""
        spread = np.argsort(-points.std(axis=0))[:2]
        slab = np.argsort(np.argsort(sizes, kind="stable")) // max(1, int(np.sqrt(len(sizes)) * 4))
        return np.lexsort((points[:, spread[1]], points[:, spread[0]] // 4, slab))

    def search(self, q: np.ndarray, size: int) -> np.ndarray:
        """Members whose bound reaches the overlap needed with a set of point ``q``."""
        at = np.arange(len(self.levels[-1][1]))
        for k in range(len(self.levels) - 1, -1, -1):
            p, s = self.levels[k]
            at = at[at < len(s)]
            at = at[may_link(p[at], q, size + s[at], self.percent)]
            if k:
                at = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
        return self.order[at]


def _filed(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        lean_worker()
        filed = set()                             # texts this task has filed: copies need no second filing
        for b in batches:
            n, sid, keys, points = [], [], [], []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                h = shingles(words, width)
                n.append(len(h))
                s = set_id(words) if words else None
                sid.append(s)
                first = s is not None and s not in filed
                keys.append(keys_of(h, percent).view(np.int64) if first else None)
                points.append(pack(point_of(h)) if first else None)
                filed.add(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.int64()),
                                              pa.array(keys, pa.list_(pa.int64())), pa.array(points, pa.binary())],
                                             [id_col, "n", "sid", "keys", "point"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, n long, sid long, keys array<long>, point binary")


def _sets(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """sid, words of the texts named by the documents in ``needed`` (id_col, sid)."""
    filter_ = presence(needed.select(F.xxhash64(id_col).alias("h")), "h")

    def run(batches):
        lean_worker()
        for b in batches:
            keep = is_present(filter_.value, b.column(1).to_numpy())
            words = [words_of(b.column(2)[k].as_py()) for k in np.flatnonzero(keep).tolist()]
            words = [w for w in words if w]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_id, words), pa.int64()), pa.array(words, pa.binary())], ["sid", "words"])

    sets = docs.select(id_col, F.xxhash64(id_col).alias("_slot"), text_col).mapInArrow(run, "sid long, words binary")
    return sets.join(needed.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])


def _verify(pairs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the 128-bit names of all shingles of their words."""
    side = lambda c: sets.select(F.col("sid").alias(c), F.col("words").alias(f"{c}_words"))

    def run(batches):
        lean_worker()
        names, met, size = Names(width), {}, 0          # sets met lately: a star's centre comes again and again

        def named(sid, words):
            nonlocal size
            if sid not in met:
                if size > KEPT:
                    met.clear()
                    size = 0
                met[sid] = names.shingles(words.as_py())
                size += len(met[sid][0])
            return met[sid]

        for rows in batches:
            out = []
            for a, b, one, two in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), rows.column(3)):
                x, y = named(a, one), named(b, two)
                both = common(x, y)
                out.append(100 * both >= percent * (len(x[0]) + len(y[0]) - both))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1)], ["a", "b"]).filter(pa.array(out, pa.bool_()))

    whole = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_words", "b_words")
    return whole.mapInArrow(run, "a long, b long")


def _bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose points allow the overlap needed."""
    side = lambda c: points.select(F.col("sid").alias(c), F.col("n").alias(f"{c}_n"), F.col("point").alias(f"{c}_p"))

    def run(batches):
        lean_worker()
        for b in batches:
            n = b.column(2).to_numpy() + b.column(4).to_numpy()
            p, q = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, DIMS) for c in (b.column(3), b.column(5)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(may_link(p, q, n, percent)))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "a_p", "b_n", "b_p")
    return both.mapInArrow(run, "a long, b long")


def _tree_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of one key in different components whose bound suffices. ``members``: key, sid, root, n, point."""
    size = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("sid")).alias("sig"),
                                      F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("sig2"))
    one = size.groupBy("m", "sig", "sig2").agg(F.min("key").alias("key"))                  # keys with the same members count once
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    dealt = (members.join(one.select("key", "m"), "key")
             .withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")))

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sid", kind="stable", ignore_index=True)
        sid, root = pdf["sid"].to_numpy(), pdf["root"].to_numpy()
        points = np.frombuffer(b"".join(pdf["point"]), "<u2").reshape(len(sid), DIMS)
        sizes = pdf["n"].to_numpy()
        tree, left, right = RTree(points, sizes, percent), [], []
        for i in range(len(sid)):
            got = tree.search(points[i], int(sizes[i]))
            got = got[(got > i) & (root[got] != root[i])]
            left.append(np.full(len(got), sid[i]))
            right.append(sid[got])
        return pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)})

    return dealt.select("key", "lo", "hi", "sid", "root", "n", "point").groupBy("key", "lo", "hi").applyInPandas(pairs, "a long, b long").distinct()


def components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links).

    Sets link when 100 * intersection >= percent * union. Null, empty and blank texts have no
    shingles and link with nothing, one another included; equal texts always link; rows that
    repeat an id count as one document's rows; other columns are not read; an empty table gives none."""
    filed = stage_table(_filed(docs, width, percent, id_col, text_col), "jaccard-filed")
    per_key = Window.partitionBy("key")
    met = (filed.where("keys is not null").select("sid", F.explode("keys").alias("key"))
           .withColumn("lo", F.min("sid").over(per_key)).withColumn("hi", F.max("sid").over(per_key))
           .withColumn("m", F.count(F.lit(1)).over(per_key)).where("lo <> hi").select("key", "sid", "m"))
    met = stage_table(met, "jaccard-met")
    # the star's centre under a key is the set that meets most others: in a group of copies, the one nearest to all
    degree = met.groupBy("sid").agg(F.sum("m").alias("degree"))
    ranked = met.join(degree, "sid").select("key", "sid", "degree")
    centre = ranked.groupBy("key").agg(F.max(F.struct("degree", "sid"))["sid"].alias("pivot"))
    keyed = stage_table(ranked.select("key", "sid").join(centre, "key"), "jaccard-keyed")
    points = stage_table(filed.where("point is not null").join(keyed.select("sid").distinct(), "sid", "left_semi")
                         .select("sid", "n", "point").dropDuplicates(["sid"]), "jaccard-points")

    def linked(pairs: DataFrame) -> DataFrame:
        """Verify pairs on the whole sets, which only the documents in them send."""
        pairs = stage_table(pairs, "jaccard-pairs")
        in_pairs = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
        needed = stage_table(filed.where("sid is not null").join(in_pairs, "sid", "left_semi")
                             .groupBy("sid").agg(F.min(id_col).alias(id_col)), "jaccard-needed")
        return _verify(pairs, stage_table(_sets(docs, needed, id_col, text_col), "jaccard-sets"), width, percent)

    stars = keyed.where("sid <> pivot").select(F.col("pivot").alias("a"), F.col("sid").alias("b")).distinct()
    roots = connected(linked(_bounded(stars, points, percent)))
    named = keyed.join(roots.withColumnRenamed("v", "sid"), "sid", "left").select(
        "key", "sid", "pivot", F.coalesce("root", "sid").alias("root"))
    mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                     F.max(F.when(F.col("sid") != F.col("pivot"), F.col("sid"))).alias("x"),
                                     F.min(F.when(F.col("sid") != F.col("pivot"), F.col("sid"))).alias("y"))
    # all was compared with the pivot: only keys of three sets or more have pairs left
    left = named.join(mixed.where("lo <> hi and x <> y").select("key"), "key", "left_semi").where("sid <> pivot").select("key", "sid", "root").distinct()
    more = linked(_tree_pairs(left.join(points, "sid"), percent))
    of = roots.withColumnRenamed("root", "r")
    lifted = (more.join(of.withColumnRenamed("v", "a").withColumnRenamed("r", "ra"), "a", "left")
              .join(of.withColumnRenamed("v", "b").withColumnRenamed("r", "rb"), "b", "left")
              .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b"))
    tops = connected(lifted).select(F.col("v").alias("mid"), F.col("root").alias("top"))

    rows = (filed.select(id_col, "n", "sid").join(roots.withColumnRenamed("v", "sid"), "sid", "left")
            .withColumn("mid", F.coalesce("root", "sid")).join(tops, "mid", "left")
            .select(id_col, "n", F.coalesce("top", "mid").alias("group")))
    first = rows.where("group is not null").groupBy("group").agg(F.min(id_col).alias("first"))
    return rows.join(first, "group", "left").select(
        id_col, F.col("n").alias("n_shingles"), F.coalesce("first", id_col).alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
      JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
      GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
