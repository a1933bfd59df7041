"""Small sources are packed in runs, files leave the batch they came in, and archives are made in shares that do not grow."""

import gzip
import os
import random
import tempfile

import pyarrow as pa

from samplewright.plans import files as plans
from samplewright.plans import registry
from samplewright.sinks import binary


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_small_sources_share_members_and_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(binary, "RUN", 8)
    rnd = random.Random(5)
    src, out = folder(), folder()
    data = [bytes(rnd.randrange(256) for _ in range(rnd.choice([0, 3, 50, 100, 101, 799, 800, 801, 2500]))) for _ in range(90)]
    for i, content in enumerate(data):
        with open(f"{src}/{i}", "wb") as f:
            f.write(content)
    plan = [(f"o{i % 2}", i // 2, f"{i}", len(data[i])) for i in range(60)]  # each number follows the last one
    plan += [("gaps", i * 3, f"{i}", len(data[i])) for i in range(60, 90)]
    rnd.shuffle(plan)
    sources = spark.createDataFrame(plan, "output string, source_no int, path string, size bigint")
    binary.merge_sources(sources, src, out, part=800)
    for name, want in (("o0", data[0:60:2]), ("o1", data[1:60:2]), ("gaps", data[60:])):
        assert gzip.decompress(open(f"{out}/{name}", "rb").read()) == b"".join(want)


def test_a_run_of_small_sources_is_one_member(tmp_path):
    for i in range(20):
        (tmp_path / f"{i}").write_bytes(b"x" * i)
    row = lambda n, run, output="o": {"output": output, "source_no": n, "part_no": 0, "path": f"{n}", "start": 0, "length": n, "run": run}
    rows = [row(1, 0), row(2, 0), row(3, 0), row(5, 0), row(6, None), row(7, 0), row(8, 1), row(9, 1), row(10, 1, "p")]
    made = binary._MemberWriter(str(tmp_path / "out"), str(tmp_path)).write(iter(rows)).files
    size = {final: len(gzip.decompress((tmp_path / "out" / name).read_bytes())) for name, final in made}
    key = lambda o, n: f"{o}{binary._PARTS}/{n:010d}-{0:010d}"
    assert size == {key("o", 1): 6, key("o", 5): 5, key("o", 6): 6, key("o", 7): 7, key("o", 8): 17, key("p", 10): 10}


def test_files_are_written_from_their_batches(tmp_path):
    batch = pa.record_batch([pa.array(["a", "b/c"]), pa.array([b"abc", b""], pa.binary())], ["path", "content"])
    writer = binary._FileWriter(str(tmp_path))
    writer.commit([writer.write(iter([batch]))])
    assert (tmp_path / "a").read_bytes() == b"abc" and (tmp_path / "b" / "c").read_bytes() == b""
    assert os.listdir(tmp_path / "_temporary") == []


def test_archives_a_task_do_not_grow_with_the_documents(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id AS doc_id", "nullif(cast(id AS string), '7') AS text", "'en' AS lang", "'s' AS source", "1L AS n_chars")
    monkeypatch.setattr(registry, "table", lambda *_: docs)
    monkeypatch.setattr(plans, "_DOCS_A_TASK", 100)
    made = plans.archive_files(spark, "")
    tasks = made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(tasks) == 30 and max(tasks) <= 12
