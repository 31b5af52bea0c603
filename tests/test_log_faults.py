"""Logs that go wrong: quoted renames, unreadable dates, mismatches, many files, replaced inputs, odd zones."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from halflife.functions import scalars as S
from halflife.operators import ingest as I
from halflife.operators.sequence import time_slices
from halflife.session import release_staged, source_key, stage
from halflife.sources import patch_log
from halflife.sources.lifecycle import format_time
from halflife.sources.patch_log import read_patch_log


def log_of(spark, text):
    d = tempfile.mkdtemp(prefix="halflife-log-", dir="/tmp")
    with open(os.path.join(d, "log.txt"), "w") as f:
        f.write(text)
    return read_patch_log(spark, d)


def commit(sha, who, date, body):
    return f"commit {sha}\nAuthor: X <{who}@example.org>\nDate:   {date}\n\n    m\n\n{body}"


SHOWN = r'"a/d\303\251 \"x\"\t/f.py" "b/d\303\251 \"x\"\t/f.py"'
NAME = 'dé "x"\t/f.py'
NEW = r'"b/n\303\251w.py"'


def test_quoted_rename_keeps_its_file(spark):
    old = SHOWN.split(" \"b/")[0]
    text = "\n".join(
        [
            commit("1" * 40, "ann", "Mon Sep 10 09:00:00 2018 +0200", f"diff --git {SHOWN}\nnew file mode 100644\n--- /dev/null\n+++ {SHOWN[len(old) + 1:]}\n@@ -0,0 +1,2 @@\n+one\n+two\n"),
            commit("2" * 40, "bob", "Tue Sep 11 09:00:00 2018 +0200", f"diff --git {old} {NEW}\nsimilarity index 100%\nrename from {old.replace('a/', '', 1)}\nrename to {NEW.replace('b/', '', 1)}\n"),
            commit("3" * 40, "cat", "Wed Sep 12 09:00:00 2018 +0200", f"diff --git {NEW.replace('b/', 'a/', 1)} {NEW}\n--- {NEW.replace('b/', 'a/', 1)}\n+++ {NEW}\n@@ -1,2 +1 @@\n one\n-two\n"),
        ]
    )
    diffs = I.parse_log(log_of(spark, text))
    assert {r[0] for r in diffs.select("old_path").collect()} == {NAME, "néw.py"}
    _, files = I.file_identity(diffs)
    assert [r["path"] for r in files.collect()] == ["néw.py"]
    lines = I.line_lifecycle(log_of(spark, text)).collect()
    assert sorted((r["path"], r["remover"]) for r in lines if r["remover"]) == [("néw.py", "cat@example.org")] and len(lines) == 2


def test_unreadable_dates_are_counted_and_filled(spark):
    add = "diff --git a/{0} b/{0}\nnew file mode 100644\n--- /dev/null\n+++ b/{0}\n@@ -0,0 +1 @@\n+x\n"
    text = "\n".join(
        [
            commit("1" * 40, "ann", "Mon Sep 10 09:00:00 2018 +0200", add.format("a.py")),
            commit("2" * 40, "bob", "2018-09-11 10:30:00 +0200", add.format("b.py")),
            commit("3" * 40, "cat", "yesterday", "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1 +1 @@\n-x\n+y\n"),
        ]
    )
    rows = {(r["path"], r["creator"][:3]): r for r in I.line_lifecycle(log_of(spark, text), with_file_columns=True).collect()}
    assert rows["b.py", "bob"]["created"] == dt.datetime(2018, 9, 11, 10, 30)
    gone = rows["a.py", "ann"]
    assert gone["is_removed"] and gone["removed"] == dt.datetime(2018, 9, 11, 10, 30)  # the last date before
    assert not rows["a.py", "cat"]["is_removed"]
    errors = I.ingest_errors(I.parse_log(log_of(spark, text))).collect()
    assert [(r["kind"], r["path"], r["n"]) for r in errors] == [("date", "a.py", 1)]


def test_mismatches_are_counted_by_file(spark):
    text = "\n".join(
        [
            commit("1" * 40, "ann", "Mon Sep 10 09:00:00 2018 +0200", "diff --git a/a.py b/a.py\nnew file mode 100644\n--- /dev/null\n+++ b/a.py\n@@ -0,0 +1 @@\n+x\n"),
            commit("2" * 40, "bob", "Tue Sep 11 09:00:00 2018 +0200", "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -5,3 +5,1 @@\n ctx\n-p\n-q\n"),
        ]
    )
    rows = I.line_lifecycle(log_of(spark, text), with_file_columns=True).collect()
    assert [(r["path"], r["replay_errors"]) for r in rows] == [("a.py", 3)]


def test_part_files_are_ordered_by_their_numbers():
    names = ["part-100000-x.txt", "part-99999-x.txt", "part-00002-x.txt"]
    assert sorted(names, key=patch_log._natural) == names[::-1]


def test_long_rename_chains(spark):
    links = [(i, i - 1 if i else None) for i in range(40)] + [(100, None), (101, 100)]
    df = spark.createDataFrame(links, "seg long, parent long")
    assert {r["seg"]: r["root"] for r in I._resolve_roots(df).collect()} == {**{i: 0 for i in range(1, 40)}, 101: 100}


def test_staged_tables_follow_their_files(spark):
    d = tempfile.mkdtemp(prefix="halflife-src-", dir="/tmp") + "/t.parquet"
    spark.range(10).write.parquet(d)
    read = lambda: stage(spark.read.parquet(d), "follow", key=source_key(spark, d)).count()
    assert read() == 10
    spark.range(1000).write.mode("overwrite").parquet(d)
    assert read() == 1000
    assert release_staged(spark, "follow") == 2


def test_zone_does_not_move_times(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:30:00' a, TIMESTAMP_NTZ '2024-03-10 03:30:00.25' b, TIMESTAMP_NTZ '2024-03-11 02:30:00' c")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = df.select(S.minutes_between("b", "a"), S.days_between("c", "a"), format_time("a"), format_time("b"), patch_log.log_date(F.col("a"))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(r) == (60, 1, "2024-03-10 02:30:00", "2024-03-10 03:30:00.250000", "Sun Mar 10 02:30:00 2024")


def test_a_burst_is_cut_into_slices(spark):
    burst = spark.range(5000).selectExpr("TIMESTAMP_NTZ '2020-01-01 10:00:00' + make_dt_interval(0, 0, 0, id * 0.5) ts")
    quiet = spark.range(50).selectExpr("TIMESTAMP_NTZ '2010-01-01 00:00:00' + make_dt_interval(CAST(id * 60 AS INT)) ts")
    rows = time_slices(burst.unionByName(quiet), "ts", 500).orderBy("ts").collect()
    slices = [r["__hl_slice"] for r in rows]
    assert slices == sorted(slices) and max(slices.count(s) for s in set(slices)) <= 1000
