"""The ZIP data source: a task per member, streamed; what is hidden or no archive is left out."""

import tracemalloc
import zipfile

import pytest

from tidemark.sources import zips
from tidemark.sources.files import read_zip_lines


def _zip(path, members):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)


def test_a_task_per_member(spark, tmp_path):
    _zip(tmp_path / "a.zip", [("one.csv", "h\na1\na2\n"), ("sub/", ""), ("sub/two.csv", "h\nb1\r\n\r\nb2"), ("none.csv", "")])
    _zip(tmp_path / "deep" / "b.zip", [("three.csv", "h\nc1\n")])
    _zip(tmp_path / "_tmp" / "c.zip", [("x.csv", "h\nno\n")])
    (tmp_path / "d.txt").write_text("no")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        df = read_zip_lines(spark, path)
        assert df.rdd.getNumPartitions() == 4
        assert sorted((r.member, r.line) for r in df.collect()) == [("one.csv", "a1"), ("one.csv", "a2"), ("sub/two.csv", "b1"), ("sub/two.csv", "b2"), ("three.csv", "c1")]
    assert read_zip_lines(spark, str(tmp_path / "a.zip"), header=False).count() == 6


def test_equal_member_names_and_encodings(spark, tmp_path):
    with pytest.warns(UserWarning):
        _zip(tmp_path / "a.zip", [("m.csv", "h\n하나\n".encode("cp949")), ("m.csv", "h\n둘\n".encode("cp949"))])
    assert sorted(r.line for r in read_zip_lines(spark, str(tmp_path), "MS949").collect()) == ["둘", "하나"]


def test_addresses():
    assert zips.reachable("/any/where") and zips.reachable("file:/any") and not zips.reachable("nowhere://x/y")


def test_no_archive(spark, tmp_path):
    assert read_zip_lines(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="missing"):
        read_zip_lines(spark, str(tmp_path / "missing")).count()


def test_memory_does_not_follow_the_archive(tmp_path):
    """A member of 60 MB is read in batches of 4 MB at most."""
    _zip(tmp_path / "big.zip", [("big.csv", b"header\n" + b"0123456789,0123456789,0123456789\n" * 1_800_000)])
    reader = zips.ZipReader({"path": str(tmp_path)})
    (part,) = reader.partitions()
    tracemalloc.start()
    rows = sum(len(b) for b in reader.read(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1_800_000 and peak < 16 << 20
