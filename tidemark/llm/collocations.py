"""Phrase collocations by multikey three-way quicksort of suffix pointers.

A pointer is a word position; its suffix is the next ``MOST_WORDS`` words of its piece. Two passes
read the corpus:

* The first counts words, and the pairs that are common within a run of the corpus, so that every
  pair with a large share of all positions is known (a pair above a share reaches it in some run,
  and what the other runs leave out is under that share).
* The second routes the pointers: by leading word, by the two leading words where that word alone
  would fill a bucket, by all words where the pair would. Equal pointers of a run are sent once,
  with their number as weight; a suffix ends before a word too rare for any phrase.

Each bucket sorts its pointers by quicksort on one word at a time: those with less, the same and a
greater word than a pivot's. The same-part at depth k is a phrase of k words and its weight the
phrase's count; it goes on with the next word. A part that is lighter than the floor holds no
frequent phrase and is abandoned; the buckets own all pointers of what they abandon.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import U64, is_present, mix64, presence, stage_table

MOST_WORDS = 3
#: Positions of a run (held by a task at once) and words it keeps numbers for.
RUN, WORDS = 1 << 21, 1 << 20
#: Positions meant for a bucket; fewest and most buckets. Words and pairs that would fill a bucket are
#: at most three times the buckets, so the table of them that tasks hold is bounded.
PER_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 1 << 22, 64, 1 << 16
#: Pointers of a part that is sorted at once.
SMALL_PART = 1 << 12
#: Bytes of a text taken at once.
SLICE = 1 << 20
END = 0


def _folding() -> bytes:
    """A-Z to a-z, tabs to spaces, and the marks that end a piece to a full stop."""
    t = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        t[c] = c + 32
    t[9] = 32
    for c in b".,;:!?\n\x0b\x0c\r":
        t[c] = ord(".")
    return bytes(t)


FOLDING = _folding()


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text in slices, with ``b"."`` (which no word holds) where a piece ends."""
    data = text.encode("utf-8", "surrogatepass").translate(FOLDING) if text else b""
    at = 0
    while at < len(data):
        to = at + SLICE
        if to < len(data):
            to = data.rfind(b" ", at, to) + 1 or data.find(b" ", to) + 1 or len(data)
        yield [w for w in data[at:to].replace(b".", b" . ").split(b" ") if w]
        at = to


class Numbers(dict):
    """Numbers of words, given out as new words are asked for; ``words`` has the word of each number."""

    def __init__(self, lang: str, words: list[tuple[str, bytes]]):
        super().__init__({b".": END})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self.words)
        self.words.append((self.lang, word))
        return k


class Run:
    """Positions of one run as numbers of their words (a number stands for a word of one language)."""

    def __init__(self):
        self.of: dict[str, Numbers] = {}
        self.words: list[tuple[str, bytes]] = [("", b"")]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: str | None) -> None:
        if lang not in self.of:
            self.of[lang] = Numbers(lang, self.words)
        number = self.of[lang].__getitem__
        for words in tokens(text):
            self.parts.append(np.fromiter(map(number, words), np.int32, len(words)))
            self.size += len(words)
        self.parts.append(np.zeros(1, np.int32))

    def full(self) -> bool:
        return self.size >= RUN or len(self.words) > WORDS

    def take(self) -> np.ndarray:
        """The numbers of all positions; the run starts anew, and forgets its words when there are many."""
        at = np.concatenate([*self.parts, np.zeros(MOST_WORDS, np.int32)])
        self.parts, self.size = [], 0
        return at

    def forget(self) -> None:
        if len(self.words) > WORDS // 2:
            self.of, self.words = {}, [("", b"")]


def _runs(batches) -> Iterator[tuple[Run, np.ndarray]]:
    run = Run()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            run.add(lang, text)
            if run.full():
                yield run, run.take()
                run.forget()
    if run.size:
        yield run, run.take()


def _strings(words: list[tuple[str, bytes]], at: np.ndarray) -> list[str]:
    return [words[k][1].decode("utf-8", "surrogatepass") for k in at.tolist()]


def _common(texts: DataFrame) -> DataFrame:
    """lang, word, second, n: counts of all words (second null), and of pairs common within a run."""

    def run(batches):
        for r, at in _runs(batches):
            count = np.bincount(at, minlength=len(r.words))
            used = np.flatnonzero(count[1:]) + 1
            first, second = at[:-1], at[1:]
            whole = (first != END) & (second != END)
            pair, times = np.unique(first[whole].astype(np.int64) * len(r.words) + second[whole], return_counts=True)
            pair, times = pair[times * MOST_BUCKETS * 2 >= len(at)], times[times * MOST_BUCKETS * 2 >= len(at)]
            a, b = np.divmod(pair, len(r.words))
            lang = [r.words[k][0] for k in used.tolist()] + [r.words[k][0] for k in a.tolist()]
            yield pa.RecordBatch.from_arrays([
                pa.array(lang, pa.string()), pa.array(_strings(r.words, used) + _strings(r.words, a), pa.string()),
                pa.array([None] * len(used) + _strings(r.words, b), pa.string()), pa.array(np.concatenate([count[used], times]), pa.int64())],
                ["lang", "word", "second", "n"])

    return texts.mapInArrow(run, "lang string, word string, second string, n long").groupBy("lang", "word", "second").agg(F.sum("n").alias("n"))


def _word_hash(lang: str, word: bytes) -> int:
    """As Spark's xxhash64(lang, word)."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42))


class Routes:
    """Which words and pairs (as bytes) are split over buckets."""

    def __init__(self, rows, buckets: int):
        code = lambda w: w.encode("utf-8", "surrogatepass")
        self.buckets = buckets
        self.words = {(r.lang, code(r.word)) for r in rows if r.second is None}
        self.pairs = {(r.lang, code(r.word), code(r.second)) for r in rows if r.second is not None}

    def split(self, number: dict[tuple[str, bytes], int], v: int) -> tuple[np.ndarray, np.ndarray]:
        """Of ``v`` words with these numbers: which are split; the split pairs as first * v + second."""
        hot = np.zeros(v, bool)
        hot[[number[w] for w in self.words if w in number]] = True
        pairs = [number[lang, a] * v + number[lang, b] for lang, a, b in self.pairs if (lang, a) in number and (lang, b) in number]
        return hot, np.array(pairs, np.int64)


def _pointers(texts: DataFrame, frequent, routes) -> DataFrame:
    """Weighted pointers of each run by bucket: the words they use and, per pointer, numbers of its words and its weight."""

    def run(batches):
        split = routes.value
        hashes, n_known, last = np.zeros(1, U64), 0, None
        for r, at in _runs(batches):
            if last is not r.of:                                     # new numbers
                hashes, n_known, last = np.zeros(1, U64), 1, r.of
            hashes = np.concatenate([hashes, np.array([_word_hash(*w) for w in r.words[n_known:]], U64)])
            n_known, v = len(r.words), len(r.words)
            often = is_present(frequent.value, hashes)
            often[END] = False
            at = np.where(often[at], at, END)
            w1 = at[:-MOST_WORDS]
            start = np.flatnonzero(w1 != END)
            b = at[start + 1]
            c = np.where(b != END, at[start + 2], END)
            a, b, c, weight = _distinct(w1[start].astype(np.int64), b.astype(np.int64), c.astype(np.int64), v)
            # by leading word; by two where that word is split; by all three where the pair is
            hot, hot_pairs = split.split({w: k for k, w in enumerate(r.words)}, v)
            two = hot[a]
            three = two & np.isin(a * v + b, hot_pairs)
            h = hashes[a]
            h = np.where(two, mix64(h * U64(3) + hashes[b]), h)
            h = np.where(three, mix64(h * U64(3) + hashes[c]), h)
            bucket = (mix64(h) % U64(split.buckets)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16), kind="stable")     # MOST_BUCKETS fit 16 bits
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for piece in np.split(order, cuts) if len(order) else ():
                yield _packed(int(bucket[piece[0]]), r, np.stack([a[piece], b[piece], c[piece]]), weight[piece])

    return texts.mapInArrow(run, "bucket int, langs array<string>, lang_of binary, words binary, size long, code binary, weight binary, m int, v int")


def _distinct(a: np.ndarray, b: np.ndarray, c: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct triples of numbers under ``v``, in order, and how often each stands."""
    pairs = None
    ab = a * v + b
    if v >= 1 << 21:                                                 # a triple would not fit 63 bits
        pairs, ab = np.unique(ab, return_inverse=True)
    code, weight = np.unique(ab * v + c, return_counts=True)
    ab, c = np.divmod(code, v)
    a, b = np.divmod(pairs[ab] if pairs is not None else ab, v)
    return a, b, c, weight


def _small(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True)


def _packed(bucket: int, r: Run, pointers: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """One row: the words that the pointers use and, per pointer, numbers of its words and its weight."""
    mark = np.zeros(len(r.words), bool)
    mark[pointers] = True
    mark[END] = True
    used = np.flatnonzero(mark)
    number = np.zeros(len(r.words), "<u2" if len(used) <= 1 << 16 else "<u4")
    number[used] = np.arange(len(used))
    names = [r.words[k] for k in used[1:].tolist()]
    langs = sorted({x[0] for x in names})
    place = {x: k for k, x in enumerate(langs)}
    words = b".".join([x[1] for x in names])                        # no word holds a full stop
    return pa.RecordBatch.from_arrays([
        pa.array([bucket], pa.int32()), pa.array([langs], pa.list_(pa.string())), pa.array([_small(np.array([place[x[0]] for x in names], "<u4"))], pa.binary()),
        pa.array([pa.compress(words, "zstd", asbytes=True)], pa.binary()), pa.array([len(words)], pa.int64()),
        pa.array([_small(number[pointers])], pa.binary()), pa.array([_small(weight.astype("<i4"))], pa.binary()),
        pa.array([pointers.shape[1]], pa.int32()), pa.array([len(names)], pa.int32())],
        ["bucket", "langs", "lang_of", "words", "size", "code", "weight", "m", "v"])


def _unpacked(row) -> tuple[list[tuple[str, bytes]], np.ndarray, np.ndarray]:
    """Words of a packed row, the numbers of its pointers' words (one row per depth) and their weights."""
    m, v = int(row.m), int(row.v)
    take = lambda x, kind, n: np.frombuffer(pa.decompress(x, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)
    names = pa.decompress(row.words, int(row.size), "zstd", asbytes=True).split(b".") if v else []
    of = take(row.lang_of, "<u4", v).tolist() if v else []
    code = take(row.code, "<u2" if v < 1 << 16 else "<u4", MOST_WORDS * m)
    return [(row.langs[k], w) for k, w in zip(of, names)], code.reshape(MOST_WORDS, m), take(row.weight, "<i4", m)


def _sorted_counts(words: np.ndarray, weight: np.ndarray, at: np.ndarray, depth: int, floor: int) -> list[tuple[int, int, int]]:
    """The equal parts of a small part, by one sort of what is left of its suffixes."""
    keys = words[depth:, at]
    order = np.lexsort(keys[::-1])
    at, keys = at[order], keys[:, order]
    new, out = np.zeros(len(at), bool), []
    new[0] = True
    for k in range(len(keys)):
        new[1:] |= keys[k, 1:] != keys[k, :-1]
        first = np.flatnonzero(new)
        total = np.add.reduceat(weight[at], first)
        full = (total >= floor) & (keys[k, first] != END)
        out += zip(at[first[full]].tolist(), [depth + k + 1] * int(full.sum()), total[full].tolist())
    return out


def equal_parts(words: np.ndarray, weight: np.ndarray, at: np.ndarray, depth: int, floor: int) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of the pointers ``at`` from word ``depth`` on: (a pointer, words, weight) of every
    equal part that weighs ``floor`` or more. ``words``: one row per depth, END where a suffix is over."""
    stack = [(at, depth)]
    while stack:
        at, d = stack.pop()
        if not len(at) or weight[at].sum() < floor:
            continue                                                  # no phrase in it can reach the floor
        if len(at) <= SMALL_PART:
            yield from _sorted_counts(words, weight, at, d, floor)
            continue
        key = words[d][at]
        pivot = sorted((key[0], key[len(key) // 2], key[-1]))[1]
        same = key == pivot
        less = key < pivot
        stack.append((at[less], d))
        stack.append((at[~(less | same)], d))
        if pivot != END:
            equal = at[same]
            total = int(weight[equal].sum())
            if total >= floor:
                yield int(equal[0]), d + 1, total
                if d + 1 < len(words):
                    stack.append((equal, d + 1))


def _bucket_counts(pdf: pd.DataFrame, split: Routes, floor: int) -> pd.DataFrame:
    """lang, w1, w2, w3, n of the phrases of two words or more in a bucket: whole counts of those it owns, its share of
    pairs that are split over buckets."""
    number: dict[tuple[str, bytes], int] = {("", b""): END}
    parts, weights = [], []
    for row in pdf.itertuples():
        names, code, weight = _unpacked(row)
        parts.append(np.array([END] + [number.setdefault(x, len(number)) for x in names], np.int32)[code])
        weights.append(weight)
    words, weight = np.concatenate(parts, axis=1), np.concatenate(weights).astype(np.int64)
    names, v = list(number), len(number)
    hot, hot_pairs = split.split(number, v)
    pair = words[0].astype(np.int64) * v + words[1]
    three = hot[words[0]] & np.isin(pair, hot_pairs)
    two = hot[words[0]] & ~three
    found = [x for x in equal_parts(words, weight, np.flatnonzero(~hot[words[0]]), 0, floor) if x[1] > 1]
    # of a split word the bucket owns pairs, of a split pair triples: sort those below the words they share
    for rows, depth in ((two, 1), (three, 2)):
        at = np.flatnonzero(rows)
        shared = words[0][at].astype(np.int64) if depth == 1 else pair[at]
        at = at[np.argsort(shared, kind="stable")]
        shared.sort()
        for group in np.split(at, np.flatnonzero(np.diff(shared)) + 1) if len(at) else ():
            if depth == 2:
                found.append((int(group[0]), 2, int(weight[group].sum())))
            found += equal_parts(words, weight, group, depth, floor)
    word = lambda k: names[k][1].decode("utf-8", "surrogatepass")
    out = [(names[words[0][at]][0], *(word(words[d][at]) if d < k else None for d in range(MOST_WORDS)), n) for at, k, n in found]
    return pd.DataFrame(out, columns=["lang", "w1", "w2", "w3", "n"])


def phrase_counts(docs: DataFrame, floor: int = 10, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, n), their totals (lang, n) and the phrases of 2 and 3 words that occur ``floor`` times or
    more (lang, w1, w2, w3, n; w3 null in pairs)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    common = stage_table(_common(texts), "phrase-words")
    words = common.where("second is null").select("lang", "word", "n")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    positions = sum(r.n for r in totals.agg(F.sum("n").alias("n")).collect() if r.n)
    buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, -(-positions // PER_BUCKET)))
    # at most `buckets` words, and twice as many pairs, can hold such a share of all positions
    large = common.where(F.when(F.col("second").isNull(), F.col("n")).otherwise(2 * F.col("n")) * buckets >= F.lit(positions)).collect()
    routes = spark.sparkContext.broadcast(Routes(large, buckets))
    frequent = presence(words.where(F.col("n") >= floor).select(F.xxhash64("lang", "word").alias("h")), "h")
    pointers = _pointers(texts, frequent, routes)
    counted = pointers.groupBy("bucket").applyInPandas(lambda pdf: _bucket_counts(pdf, routes.value, floor), "lang string, w1 string, w2 string, w3 string, n long")
    phrases = stage_table(counted.groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n")).where(F.col("n") >= floor), "phrase-counts")
    return words, totals, phrases


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in 38 decimal digits: exact up to counts of 10**15."""
    d = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (d(a) * d(a)), d(left) * d(right))


def collocations(docs: DataFrame, top: int = 2000, floor: int = 10, percent: int = 50, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to 3 words.

    A phrase occurs ``floor`` times or more; its lowest-scoring cut (ties to the shortest first part) gives l, r and
    score; pairs inside a triple that has ``percent`` of their count are dropped. Null texts are empty, null languages
    are ``und``; empty texts count nothing; a text of any length is read in slices; repeated rows count as often as
    they stand; other columns are not read; an empty table gives no row. Order: score and a descending, then phrase by bytes."""
    words, totals, phrases = phrase_counts(docs, floor, lang_col, text_col)
    word = lambda c, n: words.where(F.col("n") >= floor).select("lang", F.col("word").alias(c), F.col("n").alias(n))
    pairs = phrases.where("w3 is null").drop("w3")
    pair = lambda x, y, n: pairs.select("lang", F.col("w1").alias(x), F.col("w2").alias(y), F.col("n").alias(n))
    triples = phrases.where("w3 is not null")
    inside = (triples.select("lang", "w1", "w2", "n").union(triples.select("lang", "w2", "w3", "n"))
              .groupBy("lang", "w1", "w2").agg(F.max("n").alias("longer")))
    kept = pairs.join(inside, ["lang", "w1", "w2"], "left").where(F.coalesce(100 * F.col("longer") < percent * F.col("n"), F.lit(True)))
    a = F.col("n")
    of_pairs = (kept.join(word("w1", "f1"), ["lang", "w1"]).join(word("w2", "f2"), ["lang", "w2"])
                .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), a.alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"),
                        _score(a, F.col("f1"), F.col("f2")).alias("score")))
    cut = lambda k, x, y: F.struct(_score(a, F.col(x), F.col(y)).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r"))
    of_triples = (triples.join(word("w1", "f1"), ["lang", "w1"]).join(pair("w2", "w3", "f23"), ["lang", "w2", "w3"])
                  .join(pair("w1", "w2", "f12"), ["lang", "w1", "w2"]).join(word("w3", "f3"), ["lang", "w3"])
                  .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), a.alias("a"), F.least(cut(1, "f1", "f23"), cut(2, "f12", "f3")).alias("cut"))
                  .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = of_pairs.unionByName(of_triples).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM t),
w AS (SELECT lang, id, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM p),
s AS MATERIALIZED (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, 1 AS k, w1, NULL AS w2, NULL AS w3, count(*) AS f FROM s GROUP BY lang, w1
      UNION ALL SELECT lang, 2, w1, w2, NULL, count(*) FROM s WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
      UNION ALL SELECT lang, 3, w1, w2, w3, count(*) FROM s WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3),
f AS MATERIALIZED (SELECT lang, concat_ws(' ', w1, w2, w3) AS phrase, k, list_filter([w1, w2, w3], lambda x: x IS NOT NULL) AS ws, f FROM g WHERE k = 1 OR f >= 10),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND f >= 10),
longer AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, f FROM c WHERE k = 3),
gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN longer x ON c.lang = x.lang AND c.phrase = x.phrase WHERE 100 * x.f >= 50 * c.f),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, j, x.f AS l, y.f AS r,
      CAST((1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
      JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ')
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:], ' ')),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
