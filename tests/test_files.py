"""Listings of files of any size."""

import hashlib

import pytest

from geoquarry.sources import files


def test_small_and_large_files_in_one_listing(spark, tmp_path):
    root = tmp_path / "up.load (1)"
    root.mkdir()
    want = {}
    for name, size in (("a b.bin", 10), ("empty.bin", 0), ("c%d.bin", 5000), ("d+e.bin", 5001)):
        data = bytes(i * 7 % 251 for i in range(size))
        (root / name).write_bytes(data)
        want[name] = (size, hashlib.sha256(data).hexdigest())
    rows = files.list_files(spark, str(tmp_path / "*" / "*.bin"), whole=100).collect()
    assert len(rows) == 4
    assert sorted((r["bytes"], r["sha256"]) for r in rows) == sorted(want.values())
    cut = files.list_files(spark, str(tmp_path / "*" / "empty.bin"), root="up.load (1)").first()["path"]
    assert cut == "empty.bin"


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    path, size = tmp_path / "big.tif", (2 << 30) + 12345
    with path.open("wb") as f:
        f.truncate(size)
    row = files.list_files(spark, str(path)).first()
    digest, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        digest.update(zeros)
    digest.update(bytes(size & ((1 << 20) - 1)))
    assert (row["bytes"], row["sha256"]) == (size, digest.hexdigest())


def test_a_changed_file_fails(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"12345")
    listed = spark.createDataFrame([(f"file:{tmp_path}/x.bin", 4)], "path string, bytes long")
    with pytest.raises(Exception, match="has 5 bytes, 4 were listed"):
        files.digests(listed).collect()
