"""Work kept to the key ranges that changed: snapshots with digests, and loads into a table of ranges."""

import os
import random

import pytest
from pyspark.sql import functions as F

from samplewright.operators import diff, load, loadtable, ranged, snapshots

KIND = "row_n bigint, sampletype string, uid string, Notes string, Parent string"
COLS = ("Notes", "Parent")


def rows(n, note=lambda i: f"note {i % 7}"):
    return [(i, f"T{i % 3}", f"U-{i:05d}", note(i), None if i % 5 else f"P{i}") for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, KIND).repartition(4)


def files_under(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def spoil(path, ranges):
    """Make every file but those of some ranges unreadable."""
    for name in files_under(path):
        if int(name.split("range=")[1].split("/")[0]) not in ranges:
            with open(name, "wb") as f:
                f.write(b"not parquet")


def test_range_bounds_cut_evenly(spark):
    df = frame(spark, rows(1000))
    bounds = ranged.range_bounds(df, "uid", 10)
    assert bounds == sorted(bounds) and len(bounds) == 9
    placed = df.select("uid", ranged.range_of("uid", bounds).alias("r")).collect()
    assert all(r["r"] == sum(b <= r["uid"] for b in bounds) for r in placed)
    sizes = [sum(1 for r in placed if r["r"] == i) for i in range(10)]
    assert min(sizes) > 40
    assert ranged.range_bounds(df.limit(0), "uid", 10) == [] and ranged.range_bounds(df, "uid", 1) == []


def test_only_changed_ranges_are_read(spark):
    old = rows(2000)
    new = [r if not 500 <= r[0] < 505 else (r[0], r[1], r[2], " changed", r[4]) for r in old if r[0] != 507] + [(9, "T1", "U-00507x", "added", None)]
    random.Random(1).shuffle(new)
    new = [(i + 100, *r[1:]) for i, r in enumerate(new)]  # row numbers say nothing
    first = snapshots.Snapshot.build(frame(spark, old), columns=COLS, ranges=100)
    second = snapshots.Snapshot.build(frame(spark, new), columns=COLS, like=first)
    changed = first.changed(second)
    assert 1 <= len(changed) <= 2 and len(first.bounds) == 99
    for snapshot in (first, second):
        spoil(f"{snapshot.path}/rows", changed)
    got = first.field_diff(second)
    want = diff.field_diff(frame(spark, old), frame(spark, new), columns=COLS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 5
    assert {tuple(r) for r in first.key_changes(second).collect()} == {("T0", "U-00507", "left_only"), ("T1", "U-00507x", "right_only")}


def test_equal_and_odd_snapshots(spark):
    data = [*rows(50), (60, "T1", "U-00004", "later wins", "x"), (61, "T1", "", "blank", None), (62, None, "U-9", "no type", None), (63, "T1", None, "", None)]
    first = snapshots.Snapshot.build(frame(spark, data), columns=COLS, ranges=5)
    again = snapshots.Snapshot.build(frame(spark, data).repartition(9), columns=COLS, like=first)
    assert first.changed(again) == [] and first.field_diff(again).count() == 0
    assert {r["side"] for r in first.key_diff(again).collect()} == {"common"}
    more = [*data, (70, "T2", "U-00003x", "new", None)]
    third = snapshots.Snapshot.build(frame(spark, more), columns=COLS, like=first)
    assert sorted(map(str, first.key_diff(third).collect())) == sorted(map(str, diff.key_diff(frame(spark, data), frame(spark, more)).collect()))
    empty = snapshots.Snapshot.build(frame(spark, []), columns=COLS, like=first)
    assert {r["side"] for r in first.key_diff(empty).collect()} == {"left_only"}
    with pytest.raises(ValueError):
        first.changed(snapshots.Snapshot.build(frame(spark, rows(500)), columns=COLS, ranges=7))


STORE = "uid string, sampletype string, name string"


def stored_and_sent(n=600):
    old = [(f"U-{i:05d}", "T", f"old {i}") for i in range(0, n, 2)]
    new = [(f"U-{i:05d}", "X" if i == 10 else "T", f"new {i}") for i in range(0, 40)] + [(f"U-{n - 1:05d}", "T", "late"), ("V-1", "T", "last"), ("", "T", "no uid")]
    return old, new + [("U-00003", "T", "a repeat"), ("U-00003", "T", "new 3")]


def after(table):
    return sorted((r["uid"] or "", r["sampletype"], r["name"]) for r in table.rows.collect())


@pytest.mark.parametrize("update", [True, False])
def test_load_like_a_full_merge(spark, update):
    old, new = stored_and_sent()
    stored, sent = spark.createDataFrame([*old, (None, "T", "kept")], STORE), spark.createDataFrame(new, STORE)
    table = loadtable.LoadTable.create(stored, ranges=20)
    got = {r["uid"]: r["outcome"] for r in table.load(sent, "a", update).collect()}
    want = load.merge_load(stored, sent, update).collect()
    assert got == {r["uid"]: r["outcome"] for r in want if r["outcome"] != "kept"}
    assert after(table) == sorted((r["uid"] or "", r["sampletype"], r["name"]) for r in want)
    assert set(got.values()) == ({"inserted", "updated", "conflict"} if update else {"inserted", "skipped", "conflict"})


def test_untouched_ranges_keep_their_files(spark):
    old, new = stored_and_sent()
    table = loadtable.LoadTable.create(spark.createDataFrame(old, STORE), ranges=20)
    sent = spark.createDataFrame(new, STORE)
    touched = {r["range"] for r in table.plan(sent, True, ["sampletype"], None).collect()}
    spoil(f"{table.path}/rows", touched)
    before = files_under(f"{table.path}/rows")
    table.load(spark.createDataFrame(new, STORE), "a", True)
    now = files_under(f"{table.path}/rows")
    gone = {f.split("range=")[1].split("/")[0] for f in before if f not in now}
    kept = {f for f in before if now.get(f) == before[f]}
    # Two ranges hold the updated uids; the last one gets new rows beside its old file.
    assert len(touched) <= 4 and len(gone) <= 2 and len(kept) >= len(before) - 2
    assert len(now) > len(before)


def test_a_load_that_was_cut_off_is_finished_once(spark, monkeypatch):
    old, new = stored_and_sent()
    stored, sent = spark.createDataFrame(old, STORE), spark.createDataFrame(new, STORE)
    whole = loadtable.LoadTable.create(stored, ranges=20)
    whole.load(sent, "a", True)
    for broken in ("_refresh", "_write", "_note"):
        table = loadtable.LoadTable.create(stored, ranges=20)
        real, calls = getattr(loadtable.LoadTable, broken), []

        def once(self, *args, real=real, calls=calls, broken=broken):
            calls.append(args)
            if len(calls) == (1 if broken == "_refresh" else 2):
                raise OSError("cut off")
            return real(self, *args)

        monkeypatch.setattr(loadtable.LoadTable, broken, once)
        with pytest.raises(OSError):
            table.load(sent, "a", True)
        monkeypatch.undo()
        again = loadtable.LoadTable(spark, table.path)
        assert {r["uid"]: r["outcome"] for r in again.load(sent, "a", True).collect()}["U-00001"] == "inserted"
        assert after(again) == after(whole)
        assert again.load(sent, "a", True).count() > 0 and after(again) == after(whole)
        assert {r["outcome"] for r in again.load(sent, "b").collect()} == {"skipped", "conflict"} and after(again) == after(whole)


def test_filters_miss_nothing(spark):
    held = spark.range(20_000).select(F.pmod("id", F.lit(3)).cast("int").alias("range"), F.concat(F.lit("u"), "id").alias("uid"))
    blooms = loadtable.bloom_rows(held)
    assert blooms.count() <= 3 * 3
    assert loadtable.may_hold(held, blooms).where("not _maybe").count() == 0
    other = spark.range(20_000).select(F.pmod("id", F.lit(4)).cast("int").alias("range"), F.concat(F.lit("x"), "id").alias("uid"))
    found = loadtable.may_hold(other, blooms).groupBy("range").agg(F.avg(F.col("_maybe").cast("int")).alias("p")).collect()
    assert all(r["p"] < 0.1 for r in found) and {r["range"]: r["p"] for r in found}[3] == 0
