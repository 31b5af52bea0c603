"""Lifecycle text round trip (S3/S4), DROPMALFORMED, report and roster sinks."""

import os
import tempfile

from pyspark.sql import functions as F

from fixtures import lifecycle
from halflife.operators import ingest as I
from halflife.sources.lifecycle import read_lifecycle_text, to_lifecycle_text, type_lifecycle, write_lifecycle_text
from halflife.sources.reports import write_author_roster, write_report


def _key(r):
    return tuple("" if v is None else str(v) for v in r)


def test_lifecycle_text_round_trip(spark):
    lc = lifecycle(spark)
    d = tempfile.mkdtemp(prefix="halflife-io-", dir="/tmp")
    write_lifecycle_text(to_lifecycle_text(lc), f"{d}/lc")
    back = type_lifecycle(read_lifecycle_text(spark, f"{d}/lc"))
    assert sorted(map(_key, back.collect())) == sorted(map(_key, lc.collect()))


def test_dropmalformed_is_row_wise(spark):
    d = tempfile.mkdtemp(prefix="halflife-io-", dir="/tmp")
    with open(os.path.join(d, "line_decay.csv"), "w") as fh:
        fh.write("Path, Creator, Remover, Created, Removed, Lifespan\n")
        fh.write("a.java,ann,None,2018-09-10 09:00:00,None,3\n")
        fh.write("b,c.java,ann,None,2018-09-10 09:00:00,None,3\n")  # unquoted comma: 7 tokens
        fh.write("d.java,bob,ann,2018-09-10 09:00:00,2018-09-11 09:00:00,1\n")
    raw = read_lifecycle_text(spark, d)
    assert raw.count() == 2
    assert sorted(r.lifespan for r in raw.select("lifespan").collect()) == ["1", "3"]
    typed = type_lifecycle(raw)
    assert sorted((r.path, r.remover) for r in typed.collect()) == [("a.java", None), ("d.java", "ann")]


def test_report_sink_single_file(spark):
    d = tempfile.mkdtemp(prefix="halflife-io-", dir="/tmp")
    df = spark.range(100).select((F.col("id") % 7).alias("w"), F.col("id").alias("n"))
    write_report(df, f"{d}/r", order_by=["w", "n"], single_file=True)
    parts = [p for p in os.listdir(f"{d}/r") if p.startswith("part-")]
    assert len(parts) == 1
    back = spark.read.csv(f"{d}/r", header=True, inferSchema=True).collect()
    assert [(r.w, r.n) for r in back] == sorted((i % 7, i) for i in range(100))


def test_roster_sink_reads_back_as_alias_map(spark):
    d = tempfile.mkdtemp(prefix="halflife-io-", dir="/tmp")
    with open(os.path.join(d, "log.txt"), "w") as fh:
        fh.write("commit 1\nAuthor: A <a@x.org>\nDate:   Mon Sep 10 09:00:00 2018 +0200\n\n    m\n\n"
                 "commit 2\nAuthor: B B <B@x.org>\nDate:   Mon Sep 10 10:00:00 2018 +0200\n\n    m\n")
    from halflife.sources.patch_log import read_patch_log

    roster = I.author_roster(I.commits(read_patch_log(spark, d)))
    write_author_roster(roster, f"{d}/authors")
    alias = I.read_alias_map(spark, f"{d}/authors")
    assert sorted(tuple(r) for r in alias.collect()) == [("a@x.org", "a@x.org"), ("b@x.org", "b@x.org")]
