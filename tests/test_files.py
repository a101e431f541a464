"""Inventories of file trees: streamed digests, and digests that stand in for files that did not change."""

import hashlib
import os

import pytest

from assayer.operators import integrity
from assayer.sources import files


def rows(df):
    return {r.path: (r.sha256, r.bytes, r.state) for r in df.collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_inventory_and_cache(spark, tmp_path):
    root = tmp_path / "a tree+1"
    (root / "deep").mkdir(parents=True)
    for name, data in (("one.txt", b"one"), ("empty", b""), ("deep/two #%.bin", b"\0two"), ("same", b"aaaa"), ("moved", b"bbbb")):
        (root / name).write_bytes(data)
    first = files.inventory_tree(spark, str(root), "t")
    assert rows(first) == {"one.txt": (sha(b"one"), 3, "verified"), "empty": (sha(b""), 0, "verified"), "deep/two #%.bin": (sha(b"\0two"), 4, "verified"), "same": (sha(b"aaaa"), 4, "verified"), "moved": (sha(b"bbbb"), 4, "verified")}

    cache = spark.createDataFrame(first.collect(), first.schema)
    stamp = os.stat(root / "same")
    with open(root / "same", "r+b") as f:  # the same inode, size and time: trusted without a look at the bytes
        f.write(b"cccc")
    os.utime(root / "same", ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    stamp = os.stat(root / "moved")
    (root / "other").write_bytes(b"dddd")
    os.utime(root / "other", ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    os.replace(root / "other", root / "moved")  # another inode of the same size and time
    (root / "one.txt").write_bytes(b"ONE!")
    (root / "new").write_bytes(b"n")
    second = rows(files.inventory_tree(spark, str(root), "t", cache))
    assert second["same"] == (sha(b"aaaa"), 4, "verified_cached") and second["empty"][2] == "verified_cached"
    assert second["moved"] == (sha(b"dddd"), 4, "verified") and second["one.txt"] == (sha(b"ONE!"), 4, "verified") and second["new"] == (sha(b"n"), 1, "verified")


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    size = (1 << 31) + 5
    with open(tmp_path / "large", "wb") as f:
        f.truncate(size)  # a hole takes no disk
    whole = hashlib.sha256()
    for _ in range(1 << 9):
        whole.update(bytes(1 << 22))
    whole.update(bytes(5))
    assert rows(files.inventory_tree(spark, str(tmp_path), "t")) == {"large": (whole.hexdigest(), size, "verified")}


def test_a_stream_is_read_in_pieces():
    asked = []

    class Stream:
        left = 3 * files.CHUNK + 1

        def read(self, n):
            asked.append(n)
            got = min(n, self.left)
            self.left -= got
            return bytes(got)

    assert files.stream_digest(Stream()) == sha(bytes(3 * files.CHUNK + 1)) and set(asked) == {files.CHUNK}


def test_a_file_that_goes_is_missing(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"x")
    listed = files.list_tree(spark, str(tmp_path))
    listed = spark.createDataFrame(listed.collect(), listed.schema)
    os.remove(tmp_path / "x")
    assert files.hash_files(listed).first().sha256 is None


def test_unlike_digests_of_one_stamp_are_not_trusted(spark):
    inventory = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", None, 5)], "path string, bytes long, mtime long")
    cache = spark.createDataFrame([("a", 1, 5, "x"), ("a", 1, 5, "y"), ("b", 1, 5, "z"), ("b", 1, 5, "z"), ("c", None, 5, "w")], "path string, bytes long, mtime long, sha256 string")
    assert {(r.path, r.sha256, r.state) for r in integrity.cached_digest_join(inventory, cache).collect()} == {("a", None, "to_hash"), ("b", "z", "verified_cached"), ("c", None, "to_hash")}


def test_unknown_schemes_are_refused():
    with pytest.raises(KeyError):
        files._opened("ftp://host/file")
