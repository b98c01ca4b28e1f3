"""Generations of the stored tables (S6): a reader sees what the last manifest names.

A load writes new folders only (``<table>/<partition>/gen=<name>``) and, last of all, one manifest
that names the generation of every partition of every table. Until that file is there, readers see
the state before as a whole; from then on, the new one as a whole. Folders that neither of the last
two manifests names are what dead or replaced loads left; the next load sweeps them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

FOLDER = "_manifest"
#: Spark's folder name for a null partition value.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def fs_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if it is missing."""
    fs, p = fs_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove_path(spark: SparkSession, path: str) -> None:
    fs, p = fs_path(spark, path)
    fs.delete(p, True)


@dataclass(frozen=True)
class Manifest:
    """``parts``: table -> partition folder ("" for a table without) -> name of its generation."""
    number: int = 0
    parts: dict[str, dict[str, str]] = field(default_factory=dict)

    def paths(self, root: str, table: str) -> list[str]:
        return [f"{root}/{table}/" + (f"{part}/" if part else "") + f"gen={g}" for part, g in sorted(self.parts.get(table, {}).items())]

    def values(self, table: str) -> list[str]:
        """Values of the partition column, nulls left out, in order."""
        named = (part.split("=", 1)[1] for part in self.parts.get(table, {}) if part)
        return sorted(v for v in named if v != NULL_PARTITION)


def _read(spark: SparkSession, root: str, name: str) -> Manifest:
    fs, p = fs_path(spark, f"{root}/{FOLDER}/{name}")
    stream = fs.open(p)
    try:
        got = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Manifest(got["number"], got["parts"])


def _committed(spark: SparkSession, root: str) -> list[str]:
    return [n for n in names_in(spark, f"{root}/{FOLDER}") if n.endswith(".json") and not n.startswith((".", "_"))]


def latest(spark: SparkSession, root: str) -> Manifest | None:
    """The manifest in force; None before the first load."""
    names = _committed(spark, root)
    return _read(spark, root, names[-1]) if names else None


def commit(spark: SparkSession, root: str, manifest: Manifest) -> None:
    """Put a manifest in force: written under another name, then renamed. One load runs at a time; a second one
    that began from the same state fails here and changes nothing."""
    fs, target = fs_path(spark, f"{root}/{FOLDER}/{manifest.number:012d}.json")
    _, draft = fs_path(spark, f"{root}/{FOLDER}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps({"number": manifest.number, "parts": manifest.parts}).encode()))
    finally:
        out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"another load has put manifest {manifest.number} in force")


def sweep(spark: SparkSession, root: str, tables) -> None:
    """Remove what neither of the last two manifests names: generations, incoming files, older manifests."""
    names = _committed(spark, root)
    kept = [_read(spark, root, n) for n in names[-2:]]
    for n in names_in(spark, f"{root}/{FOLDER}"):
        if n not in names[-2:]:
            remove_path(spark, f"{root}/{FOLDER}/{n}")
    for n in names_in(spark, f"{root}/_incoming"):
        remove_path(spark, f"{root}/_incoming/{n}")
    for table in tables:
        used = {p for m in kept for p in m.paths(root, table)}
        for n in names_in(spark, f"{root}/{table}"):
            below = [n] if n.startswith("gen=") else [f"{n}/{g}" for g in names_in(spark, f"{root}/{table}/{n}") if g.startswith("gen=")]
            for path in (f"{root}/{table}/{b}" for b in below):
                if path not in used:
                    remove_path(spark, path)
