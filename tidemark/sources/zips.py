"""S2 as a data source: the lines of ZIP archives, one input partition per member.

The central directory at an archive's end tells its members, so planning reads only that. A task
opens the archive, seeks to its member and inflates it as a stream: memory holds one batch of
lines, whatever the archive's size. Archives are opened through Arrow's file systems (local
paths and file, hdfs, viewfs, s3 and gs addresses).
"""

from __future__ import annotations

import fnmatch
import io
import zipfile
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, member string, line string"
#: Lines and characters of one batch.
BATCH_LINES, BATCH_CHARS = 20_000, 4 << 20


def codec_of(encoding: str) -> str:
    """Python's codec; a byte-order mark of UTF-8 is skipped."""
    return "utf-8-sig" if encoding.lower().replace("_", "-") in ("utf-8", "utf8") else encoding


def _file_system(path: str) -> tuple[afs.FileSystem, str]:
    if path.startswith("file:"):
        return afs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return afs.FileSystem.from_uri(path)
    return afs.LocalFileSystem(), path


def reachable(path: str) -> bool:
    """Whether Arrow has a file system for an address."""
    try:
        _file_system(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def archives(path: str, glob: str) -> list[tuple[str, int]]:
    """(address, size) of the archives at or under ``path``, in order; files and folders that Spark hides are not."""
    files, at = _file_system(path)
    info = files.get_file_info(at.rstrip("/"))
    if info.type == afs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == afs.FileType.File:
        return [(path, info.size)]
    base, found = at.rstrip("/"), []
    for f in files.get_file_info(afs.FileSelector(base, recursive=True)):
        below = f.path[len(base):].strip("/").split("/")
        if f.type == afs.FileType.File and fnmatch.fnmatchcase(f.base_name, glob) and not any(p.startswith((".", "_")) for p in below):
            found.append((path.rstrip("/") + "/" + "/".join(below), f.size))
    return sorted(found)


def _open(path: str):
    files, at = _file_system(path)
    return files.open_input_file(at)


@dataclass
class Member(InputPartition):
    path: str
    member: str
    place: int


class ZipReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.glob = options["path"], options.get("glob", "*.zip")
        self.codec, self.header = codec_of(options.get("encoding", "UTF-8")), options.get("header", "true") == "true"

    def partitions(self):
        """One per member; the k-th of the directory, as names may repeat."""
        out = []
        for path, _ in archives(self.path, self.glob):
            with _open(path) as f, zipfile.ZipFile(f) as z:
                out += [Member(path, m.filename, k) for k, m in enumerate(z.infolist()) if not m.is_dir()]
        return out

    def read(self, part):
        if part is None:                                   # no member at all
            return
        with _open(part.path) as f, zipfile.ZipFile(f) as z, z.open(z.infolist()[part.place]) as raw:
            lines, chars = [], 0
            for k, line in enumerate(io.TextIOWrapper(raw, encoding=self.codec, newline="")):
                line = line.rstrip("\r\n")
                if not line or (self.header and k == 0):
                    continue
                lines.append(line)
                chars += len(line)
                if len(lines) >= BATCH_LINES or chars >= BATCH_CHARS:
                    yield self._batch(part, lines)
                    lines, chars = [], 0
            if lines:
                yield self._batch(part, lines)

    @staticmethod
    def _batch(part, lines):
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([part.path] * n, pa.string()), pa.array([part.member] * n, pa.string()),
                                           pa.array(lines, pa.string())], ["path", "member", "line"])


class ZipLines(DataSource):
    """``spark.read.format("zip_lines")``: options encoding, header (first line of each member left out), glob."""

    @classmethod
    def name(cls):
        return "zip_lines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ZipReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipLines)
