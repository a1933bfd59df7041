"""Archives, binary sinks, merged gzip files and staged digests, against Python's own libraries."""

import gzip
import hashlib
import os
import random
import tempfile
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from samplewright.operators import filetree
from samplewright.sinks import binary
from samplewright.sources import archives, files


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


class Counted:
    """An open file that counts what is read."""

    total = 0

    def __init__(self, file):
        self.file = file

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def seek(self, at):
        self.file.seek(at)

    def read(self, n):
        data = self.file.read(n)
        Counted.total += len(data)
        return data


def listed(root):
    reader = archives.ArchiveReader(root)
    return [row for part in reader.partitions() for batch in reader.read(part) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]


def test_a_sparse_archive_past_two_gigabytes(monkeypatch):
    root = folder()
    with open(f"{root}/big.zip", "wb") as f:
        f.truncate((2 << 30) + (300 << 20))
    with zipfile.ZipFile(f"{root}/big.zip", "a", zipfile.ZIP_DEFLATED) as z:
        for i in range(2000):
            z.writestr(f"d/{i}.txt", "x" * i)
    real = archives.open_file
    monkeypatch.setattr(archives, "open_file", lambda system, path: Counted(real(system, path)))
    Counted.total = 0
    got = listed(root)
    assert [r[2:] for r in got] == [(f"d/{i}.txt", f"{i}.txt", i) for i in range(2000)]
    assert Counted.total < 1 << 20


def test_archives_like_zipfile(spark, monkeypatch):
    root = folder()
    os.makedirs(f"{root}/a/b")
    want = set()
    for name, members in {"one.zip": ["x.txt", "d/", "d/ü 漢.txt", "d/.hidden"], "a/b/two.zip": [f"m{i}" for i in range(500)], "a/empty.zip": []}.items():
        with zipfile.ZipFile(f"{root}/{name}", "w") as z:
            for m in members:
                z.writestr(m, "" if m.endswith("/") else m * 3)
            z.comment = b"PK a comment" * 50
            want |= {(name, os.path.basename(name), i.filename, i.filename.rsplit("/", 1)[-1], i.file_size) for i in z.infolist() if not i.is_dir()}
    with open(f"{root}/a/other.txt", "w") as f:
        f.write("not an archive")
    assert {tuple(r) for r in archives.list_archives(spark, root).collect()} == want
    monkeypatch.setattr(archives, "BATCH", 7)
    monkeypatch.setattr(archives, "BLOCK", 100)
    monkeypatch.setattr(archives, "PER_PARTITION", 1)
    assert set(listed(root)) == want
    reader = archives.ArchiveReader(root)
    assert max(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 7
    with open(f"{root}/bad.zip", "wb") as f:
        f.write(b"no zip at all")
    with pytest.raises(archives.NotAnArchive):
        listed(root)


def test_wide_archives(tmp_path):
    path = tmp_path / "wide.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(70_000):
            z.writestr(zipfile.ZipInfo(f"{i}"), b"")
    with open(path, "rb") as f:
        assert [n for n, _ in archives.entries(f, path.stat().st_size)] == [str(i) for i in range(70_000)]


def test_folders_come_in_pages(spark, monkeypatch):
    root = folder()
    os.makedirs(f"{root}/flat/deep")
    for i in range(25):
        with open(f"{root}/flat/f{i}", "w") as f:
            f.write("x" * i)
    system, _ = files.file_system(root)
    pages = list(files.folder_pages(system, f"{root}/flat", 10))
    assert [len(p) for p in pages] == [10, 10, 6] and sum(r[1] for p in pages for r in p) == 1
    got = {(r["path"], r["length"]) for r in files.list_files(spark, root).collect()}
    assert got == {(f"flat/f{i}", i) for i in range(25)}
    assert {r["path"] for r in files.list_files(spark, f"file://{root}", "f?").collect()} == {f"flat/f{i}" for i in range(10)}


def test_merged_bytes_are_the_sources(spark):
    rnd = random.Random(2)
    src, out = folder(), folder()
    data = {f"s/{i}": rnd.choice([b"", b"\n", b"a\r\n\n", b"no end", bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, 5000)))]) for i in range(30)}
    binary.write_files(spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "path string, content binary").repartition(4), src)
    assert {k: open(f"{src}/{k}", "rb").read() for k in data} == data
    plan = [(f"o{i % 3}/x.gz", i, f"s/{i}", len(data[f"s/{i}"])) for i in range(30)]
    rnd.shuffle(plan)
    sources = spark.createDataFrame(plan, "output string, source_no int, path string, size bigint")
    got = {r["output"]: r for r in binary.merge_sources(sources, src, out, part=100).collect()}
    for o in range(3):
        want = b"".join(data[f"s/{i}"] for i in range(30) if i % 3 == o)
        packed = open(f"{out}/o{o}/x.gz", "rb").read()
        row = got[f"o{o}/x.gz"]
        assert gzip.decompress(packed) == want and (row["n_sources"], row["src_bytes"], row["gzip_bytes"]) == (10, len(want), len(packed))
    left = [f for d, _, fs in os.walk(out) for f in fs] + [d for _, ds, _ in os.walk(out) for d in ds if "parts" in d or "gone" in d]
    assert sorted(left) == ["x.gz"] * 3
    digests = {r["path"]: r["md5"] for r in files.unpacked_digests(spark, out, spark.createDataFrame([(o,) for o in got], "path string")).collect()}
    assert digests["o1/x.gz"] == hashlib.md5(b"".join(data[f"s/{i}"] for i in range(1, 30, 3))).hexdigest()


def test_a_source_that_got_shorter_fails_and_leaves_nothing(spark):
    src, out = folder(), folder()
    with open(f"{src}/a", "wb") as f:
        f.write(b"abc")
    sources = spark.createDataFrame([("o", 0, "a", 10)], "output string, source_no int, path string, size bigint")
    with pytest.raises(Exception, match="shorter than planned"):
        binary.merge_sources(sources, src, out)
    assert [f for d, _, fs in os.walk(out) for f in fs] == []


def test_staged_digests_read_little(spark):
    root = folder()
    big = bytes(random.Random(1).randrange(256) for _ in range(5000))
    middle = big[:2500] + b"?" + big[2501:]
    data = {"alone": b"x" * 777, "big1": big, "big2": big, "inside": middle, "start": b"#" + big[1:], "small1": b"abc", "small2": b"abc", "small3": b"abd", "e1": b"", "e2": b""}
    for name, content in data.items():
        with open(f"{root}/{name}", "wb") as f:
            f.write(content)
    listing = files.list_files(spark, root).select("path", "length")
    got = {r["path"]: (r["md5"], r["bytes_read"]) for r in files.staged_digests(spark, root, listing, edge=100).collect()}
    md5 = {k: hashlib.md5(v).hexdigest() for k, v in data.items()}
    assert got == {"alone": (None, 0), "start": (None, 200), "small3": (None, 3), "inside": (md5["inside"], 5200), "big1": (md5["big1"], 5200),
                   "big2": (md5["big2"], 5200), "small1": (md5["small1"], 3), "small2": (md5["small2"], 3), "e1": (md5["e1"], 0), "e2": (md5["e2"], 0)}
    rows = spark.createDataFrame([(p, len(data[p]), m) for p, (m, _) in got.items() if m], "path string, length bigint, md5 string")
    found = {(r["path"], r["n_copies"]) for r in filetree.content_duplicates(rows).select("path", "n_copies").collect()}
    assert found == {(p, 2) for p in ("big1", "big2", "small1", "small2", "e1", "e2")}
    gone = listing.union(spark.createDataFrame([("lost", 3)], "path string, length bigint"))
    assert files.staged_digests(spark, root, gone).where(F.col("path") == "lost").first()["bytes_read"] is None


def test_digests_leave_in_the_batches_that_paths_came_in(spark, monkeypatch):
    """One batch of paths gives one batch of digests, in order, null for a file that is not there."""
    root = folder()
    for i in range(5):
        with open(f"{root}/{i}", "wb") as f:
            f.write(b"x" * i)
    taken = []

    class Wanted:
        def select(self, *_):
            return self

        def mapInArrow(self, read, _):
            taken.extend(read([pa.record_batch([["0", "3", "none", "4"]], ["path"]), pa.record_batch([["1"]], ["path"])]))

    monkeypatch.setattr(files, "_dealt", lambda wanted: wanted)
    files.file_digests(spark, root, Wanted())
    md5 = lambda n: hashlib.md5(b"x" * n).hexdigest()
    assert [list(zip(*b.to_pydict().values(), strict=True)) for b in taken] == [
        [("0", md5(0)), ("3", md5(3)), ("none", None), ("4", md5(4))], [("1", md5(1))]]
