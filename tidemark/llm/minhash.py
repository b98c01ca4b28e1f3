"""MinHash near-duplicates with sequential Bayesian verification.

A text's signature holds the smallest values of its word shingles under ``BANDS * ROWS`` hash
functions, 16 bits each. Texts that agree in all rows of a band are candidates; a pair at the
threshold shares no band with a probability of 7e-9. Candidates are compared a batch of
signature positions at a time: after m agreements in n, the similarity has a Beta posterior,
and a pair whose chance to reach the threshold is under ``MISS`` goes no further. Survivors are
confirmed on their whole shingle sets, word by word. Equal word sequences collapse first.

Within a band's bucket not all pairs are formed. First every text meets the bucket's centre, the
text that shares most buckets with others (a star: one pair a member). What the stars link is one
component. Only texts that stay outside their centre's component (outliers) are then held against
the bucket's other components, in blocks of signatures and words; a pair is taken in the first band
it shares, and confirmed inside its block, which gives out no more links than join its components.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U64, is_present, mix64, presence, stage_table
from tidemark.llm.graph import connected

ROWS, BANDS = 5, 32
POSITIONS = ROWS * BANDS
#: Signature positions compared between two looks at the posterior.
BATCH = 32
#: Chance at which a pair that reaches the threshold may be given up by a look.
MISS = 1e-10
#: Texts and bytes of one side of a block, and pairs compared at once.
BLOCK, BLOCK_BYTES, AT_ONCE = 4096, 1 << 25, 1 << 18
#: Shingles hashed at once, and words whose hashes a task keeps.
SLICE, WORDS = 4096, 200_000


def least_agreement(n: int, percent: int) -> int:
    """Fewest agreements in ``n`` positions at which a pair is kept. From a uniform prior the similarity is
    Beta(m + 1, n - m + 1) after m agreements, and P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
    t, tail = percent / 100, 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        if tail >= MISS:
            return m
    return n


@lru_cache(maxsize=None)
def looks(percent: int) -> tuple[tuple[int, int], ...]:
    """(positions seen, fewest agreements) of each look."""
    return tuple((n, least_agreement(n, percent)) for n in range(BATCH, POSITIONS + 1, BATCH))


def sequential(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Indexes of the pairs of rows (a[i], b[i]) that no look gives up."""
    left, agreed, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, fewest in looks(percent):
        agreed += (a[left, done:n] == b[left, done:n]).sum(axis=1)
        keep = agreed >= fewest
        left, agreed, done = left[keep], agreed[keep], n
    return left


def words_of(text: str | None) -> bytes:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z folded, joined by one space (bytes.split and lower know ASCII alone)."""
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) if text else b""


def name_of(words: bytes) -> bytes:
    """128-bit name of a word sequence."""
    return hashlib.blake2b(words, digest_size=16).digest()


def shingle_set(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    """The distinct ``width``-word shingles themselves; fewer words are one shingle."""
    if not words:
        return set()
    k = min(width, len(words))
    return set(zip(*(words[i:len(words) - k + 1 + i] for i in range(k))))


_FACTORS = mix64(np.arange(1, POSITIONS + 1, dtype=U64)) | U64(1)


class Signer:
    """Signatures by hashes of words; keeps the hashes of words it has met."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        h = np.array([known[w] for w in words], U64)
        k = min(self.width, len(h))
        out = np.zeros(len(h) - k + 1, U64)
        for i in range(k):
            out = mix64(out * U64(3) + h[i:len(h) - k + 1 + i])
        return np.unique(out)

    def signature(self, h: np.ndarray) -> np.ndarray:
        least = np.full(POSITIONS, ~U64(0))
        for at in range(0, len(h), SLICE):
            np.minimum(least, (h[at:at + SLICE, None] * _FACTORS).min(axis=0), out=least)
        return (mix64(least) >> U64(48)).astype("<u2")


def _signed(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), sid (name of the words, null without words); n and signature of each sid at its first row in a task."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        signer, sizes = Signer(width), {}
        for b in batches:
            n, sid, sig = [], [], []
            for t in b.column(1).to_pylist():
                words = words_of(t)
                if not words:
                    n.append(0), sid.append(None), sig.append(None)
                    continue
                name = name_of(words)
                first = name not in sizes
                if first:
                    h = signer.hashes(words.split(b" "))
                    sizes[name] = len(h)
                n.append(sizes[name]), sid.append(name)
                sig.append(signer.signature(h).tobytes() if first else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.binary()), pa.array(sig, pa.binary())],
                                             ["id", "n", "sid", "sig"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, n long, sid binary, sig binary")


def _bands(sig: Column) -> Column:
    """One 64-bit key per band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(sig, b * (2 * ROWS) + 1, F.lit(2 * ROWS))))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(-1, POSITIONS)


def _promising(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sequential verification keeps."""
    side = lambda c: signed.select(F.col("sid").alias(c), F.col("sig").alias(f"{c}_sig"))

    def run(batches):
        for b in batches:
            keep = sequential(_matrix(b.column(2).to_pylist()), _matrix(b.column(3).to_pylist()), percent)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).take(pa.array(keep))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_sig", "b_sig").mapInArrow(run, "a binary, b binary")


def _texts(docs: DataFrame, needed: DataFrame, text_col: str) -> DataFrame:
    """sid, words of the texts named in ``needed``: a bitmap of fixed size spares most others, the join decides."""
    bits = presence(needed.select(F.xxhash64("sid").alias("h")), "h")

    def run(batches):
        sent = set()
        for b in batches:
            named = [(name_of(w), w) for w in map(words_of, b.column(0).to_pylist()) if w]
            digests = np.array([xxhash.xxh64_intdigest(name, 42) for name, _ in named], U64)      # as Spark's xxhash64
            named = [named[k] for k in np.flatnonzero(is_present(bits.value, digests)).tolist()]
            new = dict(x for x in named if x[0] not in sent)
            sent.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(list(new.values()), pa.binary())], ["sid", "words"])

    return docs.select(text_col).mapInArrow(run, "sid binary, words binary").join(needed, "sid", "left_semi").dropDuplicates(["sid"])


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link by their whole shingle sets."""
    side = lambda c: texts.select(F.col("sid").alias(c), F.col("words").alias(f"{c}_words"))

    def run(batches):
        last, one = None, set()
        for b in batches:
            keep = []
            for name, x, y in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if name != last:
                    last, one = name, shingle_set(x.split(b" "), width)
                two = shingle_set(y.split(b" "), width)
                both = len(one & two)
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # joined on a last: its rows come sorted by a, so a centre's set is built once, not once a pair
    return (pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_words", "b_words")
            .mapInArrow(run, "a binary, b binary"))


def shingle_ids(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Distinct shingles of each text as numbers, equal for equal words in any of the texts. A text of fewer than
    ``width`` words has none: its one shingle stands in no other word sequence."""
    if not texts:
        return []
    known: dict[bytes, int] = {}
    words = [np.array([known.setdefault(w, len(known)) for w in t.split(b" ")], np.int64) for t in texts]
    lengths = np.array([max(0, len(w) - width + 1) for w in words])
    ids = np.zeros(lengths.sum(), np.int64)
    for i in range(width):                                       # numbers stay under positions * words: exact
        step = np.concatenate([w[i:i + n] for w, n in zip(words, lengths)])
        ids = np.unique(ids * max(1, len(known)) + step, return_inverse=True)[1]
    return [np.unique(x) for x in np.split(ids, np.cumsum(lengths)[:-1])]


def _screened(out: pd.DataFrame, rest: pd.DataFrame, band: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (outlier, member) of the pairs in different components that no look gives up and that share no
    band before ``band``; ordered by outlier."""
    x, y = _matrix(out["sig"]), _matrix(rest["sig"])
    x_root, y_root = out["root"].to_numpy(), rest["root"].to_numpy()
    x_sid, y_sid = out["sid"].to_numpy(), rest["sid"].to_numpy()
    y_out = rest["also_outlier"].to_numpy()
    a, b, step = [], [], max(1, AT_ONCE // len(y))
    for at in range(0, len(x), step):
        i, j = np.divmod(np.arange(min(step, len(x) - at) * len(y)), len(y))
        i += at
        # two outliers meet in both roles: one of them is enough
        keep = (x_root[i] != y_root[j]) & (~y_out[j] | (x_sid[i] < y_sid[j]))
        i, j = i[keep], j[keep]
        kept = sequential(x[i], y[j], percent)
        i, j = i[kept], j[kept]
        if band:
            same = (x[i, :band * ROWS] == y[j, :band * ROWS]).reshape(-1, band, ROWS).all(axis=2).any(axis=1)
            i, j = i[~same], j[~same]
        a.append(i.astype(np.int32)), b.append(j.astype(np.int32))
    return np.concatenate(a), np.concatenate(b)


def _block_links(pdf: pd.DataFrame, width: int, percent: int) -> pd.DataFrame:
    """Links between a block's outliers and its members of other components, confirmed on their words: as many as
    join what is linked, at most one less than the components."""
    out, rest = pdf[pdf["outlier"]], pdf[~pdf["outlier"]]
    found: list[tuple[bytes, bytes]] = []
    if len(out) and len(rest):
        i, j = _screened(out, rest, int(pdf["band"].iloc[0]), percent)
        one, two = np.unique(i), np.unique(j)
        ids = shingle_ids([out["words"].iloc[k] for k in one.tolist()] + [rest["words"].iloc[k] for k in two.tolist()], width)
        mine, theirs = dict(zip(one.tolist(), ids)), dict(zip(two.tolist(), ids[len(one):]))
        up: dict[bytes, bytes] = {}

        def root(r):
            while r in up:
                r = up[r]
            return r

        x_root, y_root, x_sid, y_sid = out["root"].tolist(), rest["root"].tolist(), out["sid"].tolist(), rest["sid"].tolist()
        has = np.zeros(max((int(x[-1]) for x in ids if len(x)), default=0) + 1, bool)
        for members in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else ():
            k = int(i[members[0]])
            near = [m for m in j[members].tolist() if len(theirs[m]) and root(y_root[m]) != root(x_root[k])]
            if not near or not len(mine[k]):
                continue
            has[mine[k]] = True
            sizes = np.array([len(theirs[m]) for m in near])
            both = np.add.reduceat(has[np.concatenate([theirs[m] for m in near])].astype(np.int64), np.cumsum(sizes) - sizes)
            has[mine[k]] = False
            for m in np.flatnonzero(100 * both >= percent * (len(mine[k]) + sizes - both)).tolist():
                r, s = root(x_root[k]), root(y_root[near[m]])
                if r != s:
                    up[r] = s
                    found.append((x_sid[k], y_sid[near[m]]))
    return pd.DataFrame({"a": pd.Series([x for x, _ in found], dtype=object), "b": pd.Series([y for _, y in found], dtype=object)})


def _outlier_links(keyed: DataFrame, roots: DataFrame, signed: DataFrame, docs: DataFrame, width: int, percent: int, text_col: str) -> DataFrame:
    """Links of each bucket's outliers with its members in other components. ``keyed``: key, band, sid, pivot."""
    named = keyed.join(roots.withColumnRenamed("v", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    of_pivot = roots.select(F.col("v").alias("pivot"), F.col("root").alias("pivot_root"))
    named = stage_table(named.join(of_pivot, "pivot", "left").where("sid <> pivot")     # the centre has met all
                        .select("key", "band", "sid", "root", (F.col("root") != F.coalesce("pivot_root", "pivot")).alias("strays")), "minhash-members")
    mixed = (named.groupBy("key").agg(F.count_if("strays").alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi"))
             .where("k > 0 and lo <> hi").select("key"))
    named = named.join(mixed, "key")
    needed = stage_table(named.select("sid").distinct(), "minhash-mixed")
    texts = _texts(docs, needed, text_col).join(signed.select("sid", "sig"), "sid")
    members = stage_table(named.join(stage_table(texts, "minhash-mixed-texts"), "sid"), "minhash-blocks")
    blocks = lambda rows, size: F.ceil(F.greatest(rows / F.lit(BLOCK), size / F.lit(BLOCK_BYTES))).cast("int")
    size, strays = F.length("words"), F.col("strays")
    dealt = members.groupBy("key").agg(blocks(F.count(F.lit(1)), F.sum(size)).alias("m"),
                                       blocks(F.count_if("strays"), F.coalesce(F.sum(F.when(strays, size)), F.lit(0))).alias("k"))
    members = members.join(dealt, "key")
    slot = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "band", "sid", "root", "sig", "words"]
    out = members.where("strays").select(*columns, F.lit(True).alias("outlier"), F.lit(True).alias("also_outlier"), slot("k").alias("i"), every("m").alias("j"))
    rest = members.select(*columns, F.lit(False).alias("outlier"), strays.alias("also_outlier"), every("k").alias("i"), slot("m").alias("j"))
    return out.unionByName(rest).groupBy("key", "i", "j").applyInPandas(lambda pdf: _block_links(pdf, width, percent), "a binary, b binary")


def groups(docs: DataFrame, width: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links), kept (id = component_id).

    Texts link when 100 * intersection >= percent * union of their shingle sets. Null, empty and blank texts
    have no shingles and link with nothing, one another included; equal texts always link. Rows that repeat an id
    count as one document's rows; null ids keep a null component_id unless a linked row has an id, and are not kept.
    Very long texts are hashed in slices and confirmed whole. Other columns are not read; an empty table gives none."""
    signed_rows = stage_table(_signed(docs, width, id_col, text_col), "minhash-rows")
    signed = stage_table(signed_rows.where("sig is not null").select("sid", "sig").dropDuplicates(["sid"]), "minhash-signed")
    banded = signed.select("sid", F.posexplode(_bands(F.col("sig"))).alias("band", "key"))
    crowd = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = stage_table(banded.join(crowd, "key"), "minhash-met")
    degree = met.groupBy("sid").agg(F.sum("m").alias("degree"))
    ranked = met.join(degree, "sid").select("key", "band", "sid", "degree")
    centre = ranked.groupBy("key").agg(F.max(F.struct("degree", "sid"))["sid"].alias("pivot"))
    keyed = stage_table(ranked.select("key", "band", "sid").join(centre, "key"), "minhash-keyed")

    stars = keyed.where("sid <> pivot").select(F.col("pivot").alias("a"), F.col("sid").alias("b")).distinct()
    pairs = stage_table(_promising(stars, signed, percent), "minhash-pairs")
    needed = stage_table(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct(), "minhash-needed")
    links = stage_table(_confirmed(pairs, stage_table(_texts(docs, needed, text_col), "minhash-texts"), width, percent), "minhash-links")
    more = stage_table(_outlier_links(keyed, connected(links), signed, docs, width, percent, text_col), "minhash-more")
    roots = connected(links.union(more))
    rows = (signed_rows.select("id", "n", "sid").join(roots.withColumnRenamed("v", "sid"), "sid", "left")
            .select("id", "n", F.coalesce("root", "sid").alias("group")))
    first = rows.where("group is not null").groupBy("group").agg(F.min("id").alias("first"))
    return rows.join(first, "group", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("first", "id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


ORACLE_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
      JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
      GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.doc_id),
f AS (SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
      FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM f
"""
