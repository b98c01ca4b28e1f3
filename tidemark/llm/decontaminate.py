"""Benchmark decontamination with an FM-index per training shard.

Each task cuts its documents into shards. A shard's words become a string of word
numbers of the benchmark's vocabulary; words outside it end a run, and runs shorter
than the shortest test phrase cannot hold one and are left out. The suffix array of
that string gives its Burrows-Wheeler transform, kept as a wavelet matrix with block
ranks. All test phrases are searched backwards at once; the rows found are located by
LF steps to sampled suffix positions; the occurrences merge into removal spans.

Nothing is shuffled: a document lies whole in one task, and the phrases travel in
blocks of bounded, measured size (``block_bytes``), one pass per block.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tidemark.llm.common import alnum_words, lean_worker

#: A word before A-Z is folded.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Suffix positions kept: every SAMPLE-th of the shard string, and each start of a run.
SAMPLE = 8
#: Words of one shard string; a larger task input makes more shards.
SHARD_WORDS = 1 << 21


class WaveletMatrix:
    """Rank of any symbol before any position, over packed bits with block counts."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.words, self.counts, self.zeros = [], [], []
        s = symbols.astype(np.uint32)
        for level in range(bits):
            one = ((s >> np.uint32(bits - 1 - level)) & np.uint32(1)).astype(bool)
            packed = np.packbits(one, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(self.n - one.sum()))
            s = np.concatenate([s[~one], s[one]])

    def ones(self, level: int, i: np.ndarray) -> np.ndarray:
        block, off = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << off) - np.uint64(1)
        return self.counts[level][block] + np.bitwise_count(self.words[level][block] & mask)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c[k] occurs before position i[k]."""
        at, start = i.astype(np.int64), np.zeros(len(i), np.int64)
        for level in range(self.bits):
            bit = ((c >> (self.bits - 1 - level)) & 1).astype(bool)
            one_at, one_start = self.ones(level, at), self.ones(level, start)
            at = np.where(bit, self.zeros[level] + one_at, at - one_at)
            start = np.where(bit, self.zeros[level] + one_start, start - one_start)
        return at - start

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each position, and its rank before the position."""
        at, start = i.astype(np.int64), np.zeros(len(i), np.int64)
        c = np.zeros(len(i), np.int64)
        for level in range(self.bits):
            word = self.words[level][at >> 6] >> (at & 63).astype(np.uint64)
            bit = (word & np.uint64(1)).astype(bool)
            one_at, one_start = self.ones(level, at), self.ones(level, start)
            at = np.where(bit, self.zeros[level] + one_at, at - one_at)
            start = np.where(bit, self.zeros[level] + one_start, start - one_start)
            c = c * 2 + bit
        return c, at - start


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of ``s`` where every 0 ends its suffix and differs from other zeros."""
    n = len(s)
    zero = s == 0
    n_zero = int(zero.sum())
    rank = np.where(zero, np.cumsum(zero) - 1, s.astype(np.int64) + n_zero)
    h, order = 1, np.argsort(rank, kind="stable")
    while True:
        ahead = np.full(n, 0, np.int64)
        ahead[:-h] = rank[h:] + 1
        ahead[zero] = 0
        top = int(rank.max()) + 2
        key = rank * top + ahead
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        if new.max() == n - 1:
            return order
        rank, h = new, h * 2


class FMIndex:
    """FM-index of a string of numbers; 0 separates runs and never matches."""

    def __init__(self, s: np.ndarray, sigma: int, sample: int = SAMPLE):
        sa = suffix_array(s)
        bwt = np.where(sa > 0, s[sa - 1], 0)
        self.tree = WaveletMatrix(bwt, max(1, int(sigma).bit_length()))
        counts = np.bincount(s, minlength=sigma + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])      # rows before each symbol
        keep = (sa % sample == 0) | (bwt == 0)
        self.mark = WaveletMatrix(keep.astype(np.uint32), 1)
        self.at = sa[keep]
        self.n = len(s)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range [lo, hi) of each phrase (rows of one length, symbols over 0)."""
        m, length = phrases.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for k in range(length - 1, -1, -1):
            c = phrases[live, k].astype(np.int64)
            a, b = self.first[c] + self.tree.rank(c, lo[live]), self.first[c] + self.tree.rank(c, hi[live])
            lo[live], hi[live] = a, b
            live = live[a < b]
            if not len(live):
                break
        dead = np.ones(m, bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row."""
        out, row, steps = np.zeros(len(rows), np.int64), rows.astype(np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            r = row[live]
            marked = self.mark.ones(0, r + 1) > self.mark.ones(0, r)
            hit = live[marked]
            out[hit] = self.at[self.mark.ones(0, row[hit])] + steps
            live = live[~marked]
            c, rank = self.tree.access(row[live])
            row[live] = self.first[c] + rank
            steps += 1
        return out


def phrase_block(items: list[tuple[str, str | None]], width: int) -> dict:
    """Vocabulary and distinct phrases of some items: by length, phrase rows and the items of each."""
    vocab: dict[bytes, int] = {}
    owners: dict[tuple, set] = {}
    for item, text in items:
        words = [vocab.setdefault(w, len(vocab) + 1) for w in alnum_words(text)]
        if words:
            for k in range(max(1, len(words) - width + 1)):
                owners.setdefault(tuple(words[k:k + width]), set()).add(item)
    by_len: dict[int, list] = {}
    for p in owners:
        by_len.setdefault(len(p), []).append(p)
    return {"vocab": vocab, "min": min(by_len, default=0),
            "phrases": {n: (np.array(ps, np.int64), [list(owners[p]) for p in ps]) for n, ps in by_len.items()}}


def phrase_blocks(benchmark: DataFrame, width: int, block_bytes: int):
    """The benchmark in blocks of about ``block_bytes`` of text, one at a time, by a hash of item and text, so an
    item of many rows spreads over the blocks; equal rows are read once. A block holds the whole of a row's text."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield phrase_block([(r.item, r.text) for r in part.toLocalIterator()], width)


def _merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for s, e in zip(starts[order].tolist(), ends[order].tolist()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _both(old: list[dict], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans of the blocks before and those of this one, merged."""
    both = [(x["start"], x["end"]) for x in old] + spans
    return _merge(*np.array(both, np.int64).reshape(-1, 2).T)


def _runs(ids: np.ndarray, least: int):
    """Starts and ends of the runs of non-zero numbers that have ``least`` of them at least."""
    edge = np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = b - a >= least
    return a[keep], b[keep]


def _search_shard(pieces, block):
    """pieces: (document, first word, word numbers). Yields document, start, end, item names."""
    if not pieces:
        return
    lens = np.array([len(p[2]) for p in pieces])
    begin = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    s = np.zeros(int((lens + 1).sum()), np.int64)
    for at, p in zip(begin.tolist(), pieces):
        s[at:at + len(p[2])] = p[2]
    index = FMIndex(s, len(block["vocab"]))
    for length, (phrases, owners) in block["phrases"].items():
        lo, hi = index.search(phrases)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            continue
        n = (hi - lo)[found]
        which = np.repeat(found, n)
        rows = np.repeat(lo[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pos = index.locate(rows)
        piece = np.searchsorted(begin, pos, side="right") - 1
        for w, p, at in zip(which.tolist(), piece.tolist(), pos.tolist()):
            doc, first, _ = pieces[p]
            start = first + at - int(begin[p])
            yield doc, start, start + length, owners[w]


def scan_texts(texts: list[str | None], block: dict, shard_words: int = SHARD_WORDS):
    """Per text: number of words, merged hit spans in words, names of the items found."""
    get, least = block["vocab"].get, max(1, block["min"])
    n_words, spans, items = [], {}, {}
    pieces, size = [], 0

    def flush():
        for doc, s, e, owners in _search_shard(pieces, block):
            spans.setdefault(doc, []).append((s, e))
            items.setdefault(doc, set()).update(owners)

    for k, t in enumerate(texts):
        words = alnum_words(t)
        n_words.append(len(words))
        if not block["phrases"] or len(words) < least:
            continue
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        for a, b in zip(*_runs(ids, least)):
            pieces.append((k, int(a), ids[a:b]))
            size += int(b - a) + 1
        if size >= shard_words:
            flush()
            pieces, size = [], 0
    flush()
    merged = {d: _merge(*(np.array(x) for x in zip(*v))) for d, v in spans.items()}
    return [(n, merged.get(k, []), items.get(k, set())) for k, n in enumerate(n_words)]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPANS_TYPE = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
_RESULT = pa.struct([("n_words", pa.int64()),
                     ("spans", _SPANS),
                     ("items", pa.list_(pa.string()))])


def _packed(rows):
    return pa.array([{"n_words": n, "spans": [{"start": s, "end": e} for s, e in sp], "items": sorted(it, key=lambda x: (x is None, x))}
                     for n, sp, it in rows], _RESULT)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text",
         block_bytes: int = 8 << 20, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_words``, ``spans`` (merged hit ranges in words,
    end exclusive) and ``items`` (names of the items found, sorted).

    A phrase is ``width`` consecutive words of an item; an item with fewer words is one
    phrase; items whose text is null, or has no word, give none; items without an id count
    together as one item, null in ``items``. Null and empty texts have no
    words and no hits; repeated rows each give a row; an empty benchmark finds nothing;
    only the two named columns are read, so other columns cannot clash."""
    blocks = phrase_blocks(benchmark, width, block_bytes)
    sc = docs.sparkSession.sparkContext
    id_type = docs.schema[id_col].dataType.simpleString()
    found = "_found struct<n_words:long,spans:array<struct<start:long,end:long>>,items:array<string>>"
    df = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    block, again = next(blocks), False
    while block is not None:                # the driver holds one block and the next, whatever the benchmark's size
        share, block = sc.broadcast(block), next(blocks, None)
        df = df.mapInArrow(_pass(share, again, block is None and not keep_text), f"_id {id_type}, _text string, {found}")
        again = True
    out = [F.col("_id").alias(id_col), "_found.n_words", "_found.spans", "_found.items"]
    return df.select(*out, *([F.col("_text").alias(text_col)] if keep_text else []))


def _pass(block, again: bool, last: bool):
    def run(batches):
        for b in batches:
            rows = scan_texts(b.column(1).to_pylist(), block.value)
            if again:                       # add to what the blocks before have found
                rows = [(n, _both(old["spans"], sp), it | set(old["items"]))
                        for (n, sp, it), old in zip(rows, b.column(2).to_pylist())]
            text = pa.nulls(b.num_rows, pa.string()) if last else b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), text, _packed(rows)], ["_id", "_text", "_found"])

    return run


def cut_spans(text: str | None, spans) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if not text or not spans:
        return text
    at = [m.span() for m in WORD.finditer(text)]
    parts, last = [], 0
    for s, e in spans:
        parts.append(text[last:at[s][0]])
        last = at[e - 1][1]
    return "".join(parts) + text[last:]


def remove(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text",
           length_col: str | None = None, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with the removal spans cut out of the texts (same columns). A document that
    had words and keeps none of them goes; all others stay, clean ones unchanged.

    Every block searches the uncut texts, as in :func:`scan`; the merged spans of all blocks
    are cut at once after the last, so the result does not depend on ``block_bytes``."""
    names, sc = docs.columns, docs.sparkSession.sparkContext
    extra = "_spans"
    while extra in names:
        extra += "_"
    carried = StructType([*docs.schema.fields, StructField(extra, _SPANS_TYPE)])
    df, again = docs, False
    blocks = phrase_blocks(benchmark, width, block_bytes)
    block = next(blocks)
    while block is not None:
        share, block = sc.broadcast(block), next(blocks, None)
        df = df.mapInArrow(_cut_pass(share, names.index(text_col), names.index(length_col) if length_col else None,
                                     extra, again, block is None), docs.schema if block is None else carried)
        again = True
    return df


def _cut_pass(block, at: int, length_at: int | None, extra: str, again: bool, last: bool):
    def run(batches):
        lean_worker()
        for b in batches:
            texts = b.column(at).to_pylist()
            spans = [sp for _, sp, _ in scan_texts(texts, block.value)]
            if again:                       # add what the blocks before have found, and drop their column
                spans = [_both(old, sp) for old, sp in zip(b.column(b.num_columns - 1).to_pylist(), spans)]
                b = b.select(b.schema.names[:-1])
            if not last:
                found = pa.array([[{"start": s, "end": e} for s, e in sp] for sp in spans], _SPANS)
                yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, extra])
                continue
            hit = [bool(sp) for sp in spans]
            if not any(hit):
                yield b
                continue
            new = [cut_spans(t, sp) for t, sp in zip(texts, spans)]
            keep = pa.array([not h or WORD.search(t) is not None for h, t in zip(hit, new)])
            cols = list(b.columns)
            cols[at] = pa.array(new, b.schema.field(at).type)
            if length_at is not None:
                old = b.column(length_at).to_pylist()
                cols[length_at] = pa.array([len(t) if h else o for t, h, o in zip(new, hit, old)],
                                           b.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(keep)

    return run


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id") -> DataFrame:
    """Digest per document: n_words, n_hit, n_items, items_sha256, contaminated. Cases as in :func:`scan`."""
    df = scan(docs, benchmark, width, id_col)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return df.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(F.array_sort("items"), ","), "UTF-8"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS p
       FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS p
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n)),
m AS (SELECT r, k, dw.n, item FROM dw JOIN bw ON dw.p = bw.p AND dw.n = bw.n),
hit AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS i FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
