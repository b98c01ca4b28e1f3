"""Byte-level BPE by speculation and verification.

A text is cut by the vocabulary's split pattern. Each new piece is first covered by
greedy longest matches from the vocabulary. A sequence of tokens is the exact encoding
if and only if every adjacent pair is compatible, that is, if encoding the two tokens'
bytes together gives the two tokens again; all pairs of a batch are tested at once
against a sorted table of tested pairs. Pieces with an incompatible pair, and only
those, are merged exactly. Results are kept per piece for the life of the worker, up to
a documented number of pieces; beyond it they are computed again, never skipped.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import KEPT_IN_WORKER, release_memory

#: Pieces remembered per Python worker; more start a new memory.
CACHE_PIECES = 400_000

#: White space by Unicode, as the split pattern means it (Python's own class has four more characters).
_WS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Letters and numbers of the regex module's Unicode (2026.9.29) that the tokenizers library (0.23.3) does not know: to it they are neither.
_LATER = "".join(f"{chr(a)}-{chr(b)}" for a, b in (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F)))
#: The split pattern of the vocabulary.
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{_LATER}]]+| ?[\p{{N}}--[{_LATER}]]+| ?[[^{_WS}\p{{L}}\p{{N}}]||[{_LATER}]]+"
                       rf"|[{_WS}]+(?![^{_WS}])|[{_WS}]+", regex.V1)
#: The same for texts whose characters are all in the first blocks (Latin), with the classes spelled out.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_LWS = "\t-\r \x85\xa0"
_SPLIT_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_LWS}{_LETTER}{_NUMBER}]+|[{_LWS}]+(?![^{_LWS}])|[{_LWS}]+")
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 bytes stand for
    themselves, the others for the characters from U+0100 on in order."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in keep}
    rest = [b for b in range(256) if b not in out]
    return out | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """Vocabulary of a byte-level BPE tokenizer file."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        back = {c: b for b, c in byte_letters().items()}
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        to_bytes = lambda s: bytes(back[c] for c in s)
        self.ids = {to_bytes(s): i for s, i in j["model"]["vocab"].items() if s not in self.special}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(j["model"]["merges"]):
            a, b = (to_bytes(x) for x in (m if isinstance(m, list) else m.split(" ")))
            self.rank.setdefault((self.ids[a], self.ids[b]), (r, self.ids[a + b]))
        self.longest = max(map(len, self.ids))
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.size = max(self.bytes) + 1
        self.pieces: dict[str, bytes] = {}
        self.good = np.empty(0, np.int64)       # sorted codes of compatible pairs
        self.bad = np.empty(0, np.int64)        # and of the others
        self.stands: dict[int, bool] = {}       # whether a token's bytes encode to the token
        self._special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def exact(self, data: bytes) -> list[int]:
        """Merge by rank, lowest first, leftmost first: a heap over a linked list, so n log n."""
        toks = [self.single[b] for b in data]
        n = len(toks)
        if n < 2:
            return toks
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, heap = self.rank, []
        for i in range(n - 1):
            r = rank.get((toks[i], toks[i + 1]))
            if r:
                heap.append((r[0], i, toks[i], toks[i + 1], r[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            k = nxt[i]
            if toks[i] != a or k >= n or toks[k] != b:
                continue                                # one of the two has merged since
            toks[i], toks[k] = made, -1
            nxt[i] = nxt[k]
            if nxt[k] < n:
                prv[nxt[k]] = i
                r = rank.get((made, toks[nxt[k]]))
                if r:
                    heapq.heappush(heap, (r[0], i, made, toks[nxt[k]], r[1]))
            if prv[i] >= 0:
                r = rank.get((toks[prv[i]], made))
                if r:
                    heapq.heappush(heap, (r[0], prv[i], toks[prv[i]], made, r[1]))
        return [t for t in toks if t >= 0]

    def propose(self, data: bytes) -> list[int]:
        """Greedy longest matches."""
        out, at, n, ids = [], 0, len(data), self.ids
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                t = ids.get(data[at:end])
                if t is not None:
                    out.append(t)
                    at = end
                    break
        return out

    def _compatible(self, pairs: np.ndarray) -> np.ndarray:
        """For each pair code (first * size + second), whether the pair stays as it is."""
        codes, inverse = np.unique(pairs, return_inverse=True)
        known = np.isin(codes, self.good) | np.isin(codes, self.bad)
        new_good, new_bad = [], []
        for code in codes[~known].tolist():
            a, b = divmod(code, self.size)
            (new_good if self.exact(self.bytes[a] + self.bytes[b]) == [a, b] else new_bad).append(code)
        self.good = np.union1d(self.good, np.array(new_good, np.int64))
        self.bad = np.union1d(self.bad, np.array(new_bad, np.int64))
        return np.isin(codes, self.good)[inverse]

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces: propose, verify all adjacent pairs at once, merge the failing exactly."""
        raw = [p.encode() for p in pieces]
        proposed = [self.propose(b) for b in raw]
        flat = np.array([t for p in proposed for t in p], np.int64)
        size = np.array([len(p) for p in proposed])
        owner = np.repeat(np.arange(len(pieces)), size)
        fails = np.zeros(len(pieces), bool)
        inner = owner[1:] == owner[:-1]
        if inner.any():
            pairs = (flat[:-1] * self.size + flat[1:])[inner]
            fails[owner[1:][inner][~self._compatible(pairs)]] = True
        for k in np.flatnonzero(size == 1).tolist():       # a token alone: does it stand?
            t = proposed[k][0]
            if t not in self.stands:
                self.stands[t] = self.exact(raw[k]) == [t]
            fails[k] |= not self.stands[t]
        for k, p in enumerate(pieces):
            ids = self.exact(raw[k]) if fails[k] else proposed[k]
            self.pieces[p] = np.array(ids, "<u4").tobytes()

    def split(self, text: str) -> list[str]:
        return (_SPLIT if _BEYOND_LATIN.search(text) else _SPLIT_LATIN).findall(text)

    def segments(self, text: str):
        """Parts of a text between special tokens (str), and the special tokens' ids (int)."""
        if self._special_re is None or not (m := self._special_re.search(text)):
            return [text]
        out, at = [], 0
        while m:
            out += [text[at:m.start()], self.special[m[0]]]
            at = m.end()
            m = self._special_re.search(text, at)
        return [*out, text[at:]]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; None counts as empty."""
        split = [[x if isinstance(x, int) else self.split(x) for x in self.segments(t)] if t else [] for t in texts]
        new = {p for s in split for x in s if not isinstance(x, int) for p in x if p not in self.pieces}
        if len(self.pieces) + len(new) > CACHE_PIECES and self.pieces:
            self.pieces = {}
            new = {p for s in split for x in s if not isinstance(x, int) for p in x}
        if new:
            self.learn(sorted(new))
        get = self.pieces.__getitem__
        return [b"".join(x.to_bytes(4, "little") if isinstance(x, int) else b"".join(map(get, x)) for x in s) for s in split]

    def decode(self, ids: np.ndarray) -> str:
        """Bytes of the tokens, read as UTF-8; what isn't UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}
KEPT_IN_WORKER.append(_LOADED)


def _load(spec: str) -> Bpe:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:       # once per Python worker
        _LOADED[key] = Bpe(spec)
    return _LOADED[key]


def _slices(texts: list[str | None], most: int = 4 << 20):
    """Runs of texts of about ``most`` characters: bounds what is held at once."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def vocabulary(path: str) -> str:
    """Text of a tokenizer file, read by the driver: about 1.5 MB, a fixed size."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", digest: bool | str = False) -> DataFrame:
    """One row per row of ``docs``: the id and ``ids`` (token ids) with ``decoded`` (the ids'
    text), or with ``digest`` their number and SHA-256; ``digest="decoded"`` keeps the ids and
    gives the SHA-256 of their text alone, so no decoded text leaves the worker.

    Null and empty texts have no tokens; special tokens in a text are recognised; repeated
    rows each give a row; an empty table gives none; other columns are not read. ``spec`` is
    the text of the tokenizer file and travels to the tasks as a broadcast."""
    share = docs.sparkSession.sparkContext.broadcast(spec)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        if digest == "decoded":
            release_memory()                                        # what earlier stages left in this worker
        bpe = _load(share.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _slices(texts):
                coded = bpe.encode_batch(texts[lo:hi])
                arrays = [np.frombuffer(c, "<u4") for c in coded]
                plain = [bpe.decode(a) for a in arrays]
                head = [b.column(0).slice(lo, hi - lo), pa.array([len(a) for a in arrays], pa.int64())]
                sha = lambda x: hashlib.sha256(x).hexdigest()
                if digest == "decoded":
                    yield pa.RecordBatch.from_arrays(
                        [*head, pa.array([sha(p.encode()) for p in plain], pa.string()), pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32()))],
                        [id_col, "n_tokens", "decoded_sha256", "ids"])
                elif digest:
                    yield pa.RecordBatch.from_arrays(
                        [*head, pa.array(map(sha, coded), pa.string()), pa.array([sha(p.encode()) for p in plain], pa.string())],
                        [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [*head, pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32())), pa.array(plain, pa.string())],
                        [id_col, "n_tokens", "ids", "decoded"])

    tail = {True: "ids_sha256 string, decoded_sha256 string", False: "ids array<int>, decoded string", "decoded": "decoded_sha256 string, ids array<int>"}[digest]
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, n_tokens long, {tail}")


def decode(coded: DataFrame, spec: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``coded``: the id and ``text``; null ids give null."""
    share = coded.sparkSession.sparkContext.broadcast(spec)
    id_type = coded.schema[id_col].dataType.simpleString()

    def run(batches):
        bpe = _load(share.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([None if x is None else bpe.decode(np.array(x, np.int64)) for x in b.column(1).to_pylist()], pa.string())],
                [id_col, "text"])

    return coded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {id_type}, text string")
