"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir

U64 = np.uint64
#: Odd base of the polynomial hashes (arithmetic modulo 2**64) and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: White space of the word rules: space and \t \n \v \f \r.
ASCII_SPACE = "\x20\x09-\x0D"


#: Rows and bytes of one Arrow batch: texts are long, so a Python worker holds few at once.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


#: The same where several stages share their Python workers.
LEAN_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def lean_batches(spark: SparkSession) -> None:
    for k, v in LEAN_BATCH.items():
        spark.conf.set(k, v)


def release_memory() -> None:
    """Give unused memory of this Python worker back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        with contextlib.suppress(OSError, AttributeError):             # no such call in other C libraries
            ctypes.CDLL(None).malloc_trim(0)


#: Tables that functions keep in a Python worker from task to task; :func:`lean_worker` empties them.
KEPT_IN_WORKER: list[dict] = []
#: Bytes of its own memory from which a worker lets go of what earlier stages left in it.
LEAN_WORKER = 128 << 20


def own_memory() -> int:
    """Bytes of this process that no file backs; 0 where the system does not tell."""
    with contextlib.suppress(OSError), open("/proc/self/status") as f:
        for line in f:
            if line.startswith("RssAnon:"):
                return int(line.split()[1]) << 10
    return 0


def lean_worker() -> None:
    """At the start of a task that needs no kept table: Spark hands its workers from stage to stage, and a
    worker that holds more than ``LEAN_WORKER`` empties such tables and gives unused memory back."""
    if own_memory() > LEAN_WORKER:
        for kept in KEPT_IN_WORKER:
            kept.clear()
        release_memory()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for k, v in ARROW_BATCH.items():
        spark.conf.set(k, v)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage at files
    every executor sees, so a lost executor costs no recomputation of what is above."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would fold other alphabets too)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hex_sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(31)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xC2B2AE3D27D4EB4F)
    x ^= x >> U64(29)
    return x


def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=U64) * U64(BASE))


BYTE_VALUES = _byte_values()


class Powers:
    """Powers of BASE and of its inverse, grown as longer texts come."""

    def __init__(self):
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    @staticmethod
    def _grow(a: np.ndarray, base: int, n: int) -> np.ndarray:
        while len(a) < n:
            step = U64(pow(base, len(a), 1 << 64))
            a = np.concatenate([a, a * step])
        return a

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = self._grow(self.up, BASE, n)
            self.down = self._grow(self.down, BASE_INV, n)
        return self.up, self.down


_POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of value(byte j) * BASE**j for j < i, modulo 2**64."""
    up, _ = _POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span [start, end), equal for equal bytes anywhere."""
    _, down = _POWERS.get(len(prefix))
    h = (prefix[end] - prefix[start]) * down[start]
    return mix64(h ^ ((end - start).astype(U64) * U64(0xA24BAED4963EE407)))


def word_spans(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z folded, joined by one space, as bytes;
    starts and ends of the words in them. bytes.split and bytes.lower work on ASCII
    alone, which is exactly this rule. None and blank texts have no words."""
    if not text:
        return b"", np.empty(0, np.int64), np.empty(0, np.int64)
    data = b" ".join(text.encode("utf-8", "surrogatepass").lower().split())
    if not data:
        return b"", np.empty(0, np.int64), np.empty(0, np.int64)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1]).astype(np.int64)
    ends = np.concatenate([gaps, [len(data)]]).astype(np.int64)
    return data, starts, ends


def _alnum_table() -> bytes:
    """Bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after folding A-Z; others become a space."""
    t = bytearray(range(256))
    for c in range(128):
        ch = chr(c)
        t[c] = ord(ch.lower()) if ch.isalnum() else 32
    return bytes(t)


ALNUM_FOLD = _alnum_table()


def alnum_words(text: str | None) -> list[bytes]:
    """Words of letters, digits and all non-ASCII characters, A-Z folded."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_FOLD).split()


#: Bits of a presence filter: fixed, so its broadcast (16 MB) does not grow with the data.
PRESENCE_BITS = 27


def presence(df: DataFrame, col: str):
    """Broadcast bitmap of the low bits of the (uniform) hashes in ``col``. It may report a hash
    that is absent, never miss one that is there: use it only to spare work."""
    slot = F.col(col).bitwiseAND(F.lit((1 << PRESENCE_BITS) - 1)) + 1            # Spark counts bits from 1
    pieces = (df.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).toLocalIterator())
    bits = bytearray((1 << PRESENCE_BITS) // 8)
    for r in pieces:
        bits[(r.k - 1) * 4096:r.k * 4096] = bytes(r.bits)
    return df.sparkSession.sparkContext.broadcast(bytes(bits))


def is_present(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (64-bit, either sign) a presence bitmap may hold."""
    slot = hashes.view(U64) & U64((1 << PRESENCE_BITS) - 1)
    return (np.frombuffer(bits, np.uint8)[slot >> U64(3)] >> (slot & U64(7)).astype(np.uint8)) & 1 == 1
