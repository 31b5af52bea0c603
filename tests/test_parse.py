"""Log records read as a stream against the expressions that define the parse."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from halflife.operators import ingest as I
from halflife.operators import parse as P
from halflife.sources.parts_log import render_parts_log
from halflife.sources.patch_log import read_log_records, stage_patch_log
from test_cluster import ROWS
from test_ingest import EDGE_LOG, FIXTURE_LOG, _written

HEADS = [
    "Author: Ann <Ann@Example.org>\nDate:   Mon Sep 10 09:00:00 2018 +0200", "Author: José Ñ <jose@x.org>\nDate:   Tue Feb 29 09:00:00 2016 +0000",
    "Author: José Ñ\nDate:   Tue Feb 30 09:00:00 2016 +0000", "Author:  No Mail \nDate:   2018-09-11 10:30:00 +0200", "Date:   Mon Sep 10 23:59:60 2018 +0200",
    "Author: <a@b>\r\nDate:   Mon Sep 10 09:00:00 2018 +0200\r", "Author: x <a@b.c> y\nDate: Mon Sep 10 9:00:00 12018 +0200", "Author: \nDate:   never", "no lines at all",
    "Author: K\u2028 <k@k.k>\nDate:   Mon Xyz 10 09:00:00 2018", "Author: A <a@b.c>\nDate:\tMon\tSep\t1\t1:2:3\t99",
]
HEADERS = [
    "a/x.py b/x.py\nnew file mode 100644\n--- /dev/null\n+++ b/x.py", "a/x.py b/x.py\ndeleted file mode 100644", "a/a b b/a b\n", "a/one b/two", "x y",
    '"a/d\\303\\251 \\"x\\"\\t/f.py" "b/d\\303\\251 \\"x\\"\\t/f.py"', '"a/\\777.py" b/y', '"a/\\101.py" "b/\\q\\\\.py"', "a/x b/y\nrename from x\nrename to y\n--- a/x\n+++ b/y",
    'a/x b/y\nrename from "a/\\303\\251"\nrename to \t', "a/x b/x\n--- a/x\t\n+++ b/x\r", "a/é b/é\n--- a/é\n+++ b/é", "a/x b/x\n--- \n+++ /dev/null", 'a/" b/"\n--- "\n+++ ""', "", "\n\n",
    "a/x b/x\n--- a/\n+++ b/", "--- a/q\n+++ q",
]
HUNKS = [
    "", "\n@@ -0,0 +1,2 @@\n+a\n+b", "\n@@ -1 +1 @@ f()\n-a\n+b\n\\ No newline at end of file\n\n\n", "\n@@ -5,3 +4,0 @@\n c\n-x\n\n-y\n@@ -9 +8 @@\n\tt\n \n+++ z\n--- z\n",
    "\n@@ -1 +99999999999 @@\n+a", "\n@@ -1 +2147483647,1 @@\n+a", "\n@@ broken\n@@ -x\n+a", "\n@@ -1 +1 @@\n+a\r\n\r\n-b\r\n", "\n@@ -1 +1 @@\n+é\n\u2028x\n é", "\n@@ -1 +0,0 @@", "\n@@ -1 +1 @@\n\n\n+x\n",
]


def _records(spark, n=1):
    """Every header, path header and hunk text; places as the reader gives them."""
    diffs = [h + k for h in HEADERS for k in HUNKS]
    rows = []
    for i, diff in enumerate(diffs):
        bucket = i * n // len(diffs)
        rows.append((0, bucket, i, 0, None, diff))
        if i % 3 == 0:
            rows.append((0, bucket, i, 1, f"{i:040x}\n{HEADS[i // 3 % len(HEADS)]}\n\n    m\n", None))
    df = spark.createDataFrame(rows, "file long, block long, row long, piece int, head string, diff string")
    return df.select(F.struct("file", "block", "row").alias("seq"), F.struct("file", "block").alias("seq_bucket"), "piece", "head", "diff").coalesce(1).sortWithinPartitions("seq", "piece")


COLS = ["seq", "seq_bucket", "dpos", "author", "committed", "old_path", "new_path", "is_create", "is_delete", "is_rename", "kind", "hunk_ops"]


def _seen(diffs):
    return sorted(str(tuple(r)) for r in diffs.select(COLS).withColumn("committed", F.col("committed").cast("string")).collect())


@pytest.mark.parametrize("buckets", [1, 40])
def test_a_stream_reads_what_the_expressions_read(spark, buckets):
    records = _records(spark, buckets)
    want = _seen(I._of_commits(I._sorted_records(records)))
    assert len(want) == len(HEADERS) * len(HUNKS) - 1  # the first stands before any commit
    assert _seen(I.carried_diffs(records)) == want
    assert _seen(I.carried_diffs(records.repartition(7, "seq"))) == want  # out of order: sorted


def test_plain_texts_are_read_in_the_stream(spark):
    """Ordinary logs are read where they lie: nothing is exchanged, no text is left for the expressions."""
    records = read_log_records(spark, _written(FIXTURE_LOG, EDGE_LOG))
    parsed = I._parsed_records(records)
    assert "Exchange hash" not in parsed._jdf.queryExecution().toString()
    rows = records.select("seq.file", "seq.block", "seq.row", "piece", "head", "diff").mapInArrow(P.parse_records, P.SCHEMA)
    assert rows.where("diff is not null or odd_head is not null").count() == 0 and rows.where("mark is null").count() == 10


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    for name in ("part", "orders"):
        duckdb.execute(f"COPY ({ROWS[name]}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    many = ROWS["lineitem"].replace("range(120)", "range(4000)")
    duckdb.execute(f"COPY ({many}) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    return str(folder)


def test_the_parts_log_is_written_packed_and_in_order(spark, tables):
    """a log of text took 15 times the room of the rows it was made from."""
    log = render_parts_log(spark, tables).select("text")
    text = [r["text"] for r in log.collect()]
    records = stage_patch_log(lambda: render_parts_log(spark, tables), ("packed",), ordered=True, spark=spark)
    files = {f.removeprefix("file://") for f in records.inputFiles()}
    assert sum(os.path.getsize(f) for f in files) < sum(map(len, text)) / 4
    heads = [r["head"] for r in records.where("head is not null").orderBy("seq", "piece").collect()]
    assert [h[:40] for h in heads] == [t[:40] for t in text]


def test_patch_hunks_parts_equals_its_oracle(spark, tables):
    con = duckdb.connect()
    for name in ("part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    for name in ("patch_hunks_parts", "replay_errors"):
        df = E.queries()[name](spark, tables)
        names = ", ".join(df.columns)
        want = con.execute(f"SELECT {names} FROM ({E.oracle_sql()[name]})").fetchall()
        assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want))
