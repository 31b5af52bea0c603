"""Patch logs (``git log --patch --reverse``) as records or commit rows, and a renderer
that writes the events table as such a log (FIXTURES §3.4).

Rows carry ``seq`` (log order) and ``seq_bucket`` (a coarser key,
non-decreasing in ``seq``); see :mod:`halflife.operators.ingest`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halflife.functions.scalars import time_text
from halflife.operators.sequence import scan_in_buckets, shift_in_buckets, time_slices
from halflife.session import ensure_checkpoint_dir, remember_staged, shuffles_cleaned, staged_path
from halflife.sources.bindings import events_slots

# The codec of staged logs (``.zstd``): of Parquet, so wherever Spark runs it is there; its files are one split each.
ZSTD = "org.apache.parquet.hadoop.codec.ZstandardCodec"
# Commits in a file of a staged log, at most: a packed file is read by one task and is one ordering bucket.
COMMITS_A_FILE = 100_000
COMMIT_SEP = "\ncommit "
DIFF_SEP = "\ndiff --git "
# Fixed value: the e-mail domain of authors in the rendered events log.
EVENTS_EMAIL_DOMAIN = "example.org"


def read_patch_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per commit, split on ``\\ncommit `` by the text source: seq, seq_bucket, text.

    Order key: (file number, split start, row id in split), all numbers; a log is one
    file, or files whose names are in log order, numbers in a name compared as
    numbers (part-99999 before part-100000).  The split is the bucket, so ordering
    work downstream is bounded by the split size.
    """
    rows = _numbered(spark, path, COMMIT_SEP)
    # A file's last record also holds the blank line that ends the others as part of the separator.
    text = F.regexp_replace(F.regexp_replace(F.col("value"), r"^commit ", ""), r"\n+$", "\n")
    return rows.select("seq", "seq_bucket", text.alias("text"))


def read_log_records(spark: SparkSession, path: str) -> DataFrame:
    """The log cut at every commit and every file diff: seq, seq_bucket, piece, head, diff.

    The text source splits on ``\\ndiff --git ``, so a row it reads is one diff and the headers
    of the commits that follow it; those are cut off here.  No row holds more than one
    diff, however large the commit is.  Order key as :func:`read_patch_log`'s, then ``piece``.
    """
    rows = _numbered(spark, path, DIFF_SEP)
    first = F.col("value").startswith("commit ")  # a file begins with a header; a diff never begins like one
    value = F.when(first, F.concat(F.lit("\n"), F.col("value"))).otherwise(F.col("value"))
    rows = rows.select("seq", "seq_bucket", first.alias("first"), F.posexplode(F.split(value, COMMIT_SEP)).alias("piece", "text"))
    # Before a file's first header there is nothing, not a diff.
    rows, text = rows.where(~(F.col("first") & (F.col("piece") == 0))), F.col("text")
    return rows.select(
        "seq", "seq_bucket", "piece",
        F.when(F.col("piece") > 0, F.col("text")).alias("head"),
        F.when(F.col("piece") == 0, F.when(text.endswith("\n\n"), F.concat(F.rtrim(text, F.lit("\n")), F.lit("\n"))).otherwise(text)).alias("diff"),
    )


def _numbered(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """value, seq, seq_bucket of the records of a log that are not blank."""
    raw = spark.read.option("lineSep", separator).option("io.compression.codecs", ZSTD).text(path)
    names = sorted((_file_name(f) for f in raw.inputFiles()), key=_natural)
    if len(set(names)) != len(names):
        raise ValueError("a patch log's files must have different names: they give the order")
    m = F.col("_metadata")
    rows = raw.select(
        "value",
        m.getField("file_name").alias("name"),
        m.getField("file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ).where(F.length(F.trim(F.col("value"))) > 0)
    if len(names) == 1:
        rows = rows.withColumn("file", F.lit(0).cast("bigint"))
    else:
        numbers = spark.createDataFrame(list(zip(names, range(len(names)))), "name string, file long")
        # One short row per input file, all known to the driver that listed them: small unless there are very many.
        rows = rows.join(F.broadcast(numbers) if len(names) <= 100_000 else numbers, "name")
    return rows.select("value", F.struct("file", "block", "row").alias("seq"), F.struct("file", "block").alias("seq_bucket"))


def _file_name(uri: str) -> str:
    return unquote(uri.rstrip("/").rsplit("/", 1)[-1])


def _natural(name: str) -> list:
    """Sort key that compares the numbers in a name as numbers."""
    return [(1, int(x), "") if x.isdigit() else (0, 0, x) for x in re.findall(r"\d+|\D+", name)]


# English names of git's default date format.
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def log_date(ts: Column) -> Column:
    """'Mon Jan 2 03:04:05 2006' as the value's own clock shows it."""
    weekday = F.element_at(F.array(*[F.lit(x) for x in WEEKDAYS]), F.weekday(ts) + 1)
    month = F.element_at(F.array(*[F.lit(x) for x in MONTHS]), F.month(ts))
    return F.concat_ws(" ", weekday, month, F.dayofmonth(ts).cast("string"), F.substring(time_text(ts), 12, 8), F.year(ts).cast("string"))


def write_patch_log(log: DataFrame, path: str, mode: str = "overwrite", ordered: bool = False, codec: str = "none", file_rows: int = 0) -> None:
    """Write commit rows back as a log: range-sorted by ``seq`` so part files
    are named in log order; the newline the writer adds per row is git's blank
    line between commits.  ``ordered``: partitions, and rows in them, are in log order already.
    ``file_rows``: the most commits in a file (0: any number)."""
    out = (log if ordered else log.orderBy("seq")).select(F.concat(F.lit("commit "), F.col("text")).alias("value"))
    with shuffles_cleaned(log.sparkSession):
        out.write.mode(mode).options(**{"compression": codec, "parquet.compression.codec.zstd.level": "1", "maxRecordsPerFile": file_rows}).text(path)


def render_events_log(spark: SparkSession, sf_dir: str, slice_rows: int = 2_000_000) -> DataFrame:
    """Events as commits: the first event of a slot creates the slot's file
    with one line, every later one replaces that line.  One commit per event
    in (ts, event_id) order; author ``User n <un@example.org>``."""
    e = time_slices(events_slots(spark, sf_dir), "ts", slice_rows)
    e = shift_in_buckets(
        e, keys=["event_type", "props"], order=["ts", "event_id"], values=["event_id"],
        bucket=F.col("__hl_slice"), direction=-1, prefix="prev_",
    )
    first = F.col("prev_event_id").isNull()
    path = F.col("path")
    uid = F.col("user_id").cast("string")
    header = F.concat(
        F.sha1(F.col("event_id").cast("string")),
        F.lit("\nAuthor: User "), uid, F.lit(" <u"), uid, F.lit(f"@{EVENTS_EMAIL_DOMAIN}>"),
        F.lit("\nDate:   "), log_date(F.col("ts")), F.lit(" +0000"),
        F.lit("\n\n    event "), F.col("event_id").cast("string"), F.lit("\n"),
    )
    diff = F.concat(
        F.lit("\ndiff --git a/"), path, F.lit(" b/"), path, F.lit("\n"),
        F.when(first, F.concat(F.lit("new file mode 100644\n--- /dev/null\n")))
        .otherwise(F.concat(F.lit("--- a/"), path, F.lit("\n"))),
        F.lit("+++ b/"), path, F.lit("\n"),
        F.when(first, F.lit("@@ -0,0 +1 @@\n"))
        .otherwise(F.concat(F.lit("@@ -1 +1 @@\n-event "), F.col("prev_event_id").cast("string"), F.lit("\n"))),
        F.lit("+event "), F.col("event_id").cast("string"), F.lit("\n"),
    )
    return e.select(
        F.struct("ts", "event_id").alias("seq"),
        F.col("__hl_slice").alias("seq_bucket"),
        F.concat(header, diff).alias("text"),
    )


QUEUE_FILE = "queue.log"


def render_queue_log(spark: SparkSession, sf_dir: str, slice_rows: int = 2_000_000) -> DataFrame:
    """Events as commits on one hot file and very many small ones.

    Every event puts a line on top of the queue file, and every second one also removes the
    queue's last line, the oldest (a hunk of its own); its second diff creates a file
    with one line.  The queue has over half of the log's hunks and grows all the time.
    """
    e = time_slices(events_slots(spark, sf_dir).select("ts", "event_id", "user_id"), "ts", slice_rows)
    one = e.withColumn("one", F.lit(1).cast("bigint"))
    slices = F.col("__hl_slice")
    e = scan_in_buckets(one, [], ["ts", "event_id"], {"seen": ("sum", "one")}, [slices, F.floor(slices / 1000)], inclusive=False)
    r = F.coalesce("seen", F.lit(0).cast("bigint"))  # events before this one
    held = r - F.floor(r / 2)  # lines in the queue
    uid, eid, n = F.col("user_id").cast("string"), F.col("event_id").cast("string"), held.cast("string")
    header = F.concat(
        F.sha1(eid), F.lit("\nAuthor: User "), uid, F.lit(" <u"), uid, F.lit(f"@{EVENTS_EMAIL_DOMAIN}>\nDate:   "), log_date(F.col("ts")), F.lit(" +0000\n\n    event\n"),
    )
    take = F.concat(F.lit("@@ -"), n, F.lit(" +"), n, F.lit(",0 @@\n-event "), ((r - 1) / 2).cast("bigint").cast("string"), F.lit("\n"))
    queue = F.concat(
        F.lit(f"\ndiff --git a/{QUEUE_FILE} b/{QUEUE_FILE}\n"),
        F.when(r == 0, F.lit("new file mode 100644\n--- /dev/null\n")).otherwise(F.lit(f"--- a/{QUEUE_FILE}\n")),
        F.lit(f"+++ b/{QUEUE_FILE}\n@@ -0,0 +1 @@\n+event "), r.cast("string"), F.lit("\n"),
        F.when(r % 2 == 1, take).otherwise(F.lit("")),
    )
    note = F.concat(F.lit("notes/"), eid, F.lit(".txt"))
    small = F.concat(F.lit("diff --git a/"), note, F.lit(" b/"), note, F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), note, F.lit("\n@@ -0,0 +1 @@\n+note\n"))
    return e.select(F.struct("ts", "event_id").alias("seq"), F.col("__hl_slice").alias("seq_bucket"), F.concat(header, queue, small).alias("text"))


def events_alias_map(roster: DataFrame) -> DataFrame:
    """Alias map for the rendered events log: each e-mail maps to its local
    part (``u8@example.org`` -> ``u8``), derived from the roster."""
    return roster.select("alias_from", F.regexp_extract("alias_from", r"^([^@]+)@", 1).alias("alias_to"))


def stage_patch_log(log: DataFrame | Callable[[], DataFrame], key: tuple | None = None, ordered: bool = False, spark: SparkSession | None = None) -> DataFrame:
    """Write commit rows as a packed log under the shared checkpoint dir and read it
    back with :func:`read_log_records` (cuts lineage; survives executor loss).
    With ``key``, a log already written in this application is read again; ``log`` may be a
    function, which is called only if there is none (then with ``spark``)."""
    import uuid

    spark = spark or log.sparkSession
    if key is not None and (path := staged_path(spark, "patch-log", key)):
        return read_log_records(spark, path)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/patch-logs/{uuid.uuid4().hex}"
    write_patch_log(log() if callable(log) else log, path, ordered=ordered, codec=ZSTD, file_rows=COMMITS_A_FILE)
    if key is not None:
        remember_staged(spark, "patch-log", key, path)
    return read_log_records(spark, path)
