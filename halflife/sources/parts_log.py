"""Lineitem, orders and part rendered as a patch log with everything real logs have.

Parts are files, their order lines (by order key and line number) are the steps of
the file's history.  A file lives for eight steps, an *epoch*; step j of an epoch

* j = 0 creates the file with a line on top and one at the bottom;
* 1 <= j <= 6 puts a line on top, removes from j = 3 on the one added three steps before
  (context lines in between), and appends one at the bottom (a second hunk);
* j = 4 renames the file and edits it in the same diff; j = 5 renames it once more in
  a commit of its own, without hunks, before its edit;
* j = 7 deletes the file: with all its lines in odd epochs, without hunks in even ones.
  The next step creates the same path again.

Every third part lies below a folder whose name git has to quote.  With ``faulty``,
step 6 of every tenth part also removes two lines that the file does not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halflife.session import stage
from halflife.sources.patch_log import COMMITS_A_FILE, log_date

EPOCH = 8
# A folder name and the way git shows it.
QUOTED_FOLDER = 'a "b"/été\t'
QUOTED_FOLDER_SHOWN = 'a \\"b\\"/\\303\\251t\\303\\251\\t'
START = "2015-01-05 00:00:00"


def part_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, i (step), n (steps of the part), j, author, at: one row per order line."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    steps = Window.partitionBy("l_partkey")
    i = F.row_number().over(steps.orderBy("l_orderkey", "l_linenumber")) - 1
    out = rows.select(
        F.col("l_partkey").alias("part"),
        i.alias("i"),
        F.concat(F.lit("u"), (F.col("o_custkey") % 50).cast("string"), F.lit("@example.org")).alias("author"),
        (F.col("p_size") % 2 == 0).alias("java"),
    )
    return _dated(out)


def _dated(steps: DataFrame) -> DataFrame:
    at = F.expr(f"TIMESTAMP_NTZ '{START}'") + F.make_dt_interval(
        F.lit(7) * F.col("i"), F.lit(0), F.lit(0), F.pmod(F.col("part"), F.lit(600_000)).cast("decimal(18,6)")
    )
    return steps.withColumns({"j": F.col("i") % EPOCH, "at": at})


def ordered_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`part_steps` in log order, partitions and rows in them: the short rows are sorted, not the text they become."""
    steps = stage(part_steps(spark, sf_dir).select("part", "i", "author", "java"), "part-steps", compact=True)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), steps.count() // COMMITS_A_FILE + 1)
    return _dated(steps.repartitionByRange(parts, "i", "part").sortWithinPartitions("i", "part"))


def _path(version: int, shown: bool) -> Column:
    """The file's path in its first, second or third place."""
    folder = F.when(F.col("part") % 3 == 0, F.lit(QUOTED_FOLDER_SHOWN if shown else QUOTED_FOLDER)).otherwise(F.lit("parts"))
    place = "" if version == 1 else f"v{version}/"
    return F.concat(folder, F.lit(f"/{place}p"), F.col("part").cast("string"), F.when(F.col("java"), F.lit(".java")).otherwise(F.lit(".py")))


def _shown(path: Column, side: str = "") -> Column:
    """The path as a header line shows it, quoted where it has to be."""
    plain = F.concat(F.lit(side), path)
    return F.when(F.col("part") % 3 == 0, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(plain)


def _line(kind: str, step: Column) -> Column:
    return F.concat(F.lit(f"{kind} "), F.col("part").cast("string"), F.lit("."), step.cast("string"))


def _text(*lines: Column) -> Column:
    """Lines that are not null, each with its line end."""
    return F.concat(*[F.coalesce(F.concat(x, F.lit("\n")), F.lit("")) for x in lines])


def _diff(old: Column, new: Column, *lines: Column) -> Column:
    return F.concat(F.lit("\ndiff --git "), _shown(old, "a/"), F.lit(" "), _shown(new, "b/"), F.lit("\n"), _text(*lines))


def _hunks(faulty: bool) -> Column:
    """Both hunks of a step 1 <= j <= 6."""
    i, j = F.col("i"), F.col("j")
    tops = F.least(j, F.lit(3))  # lines on top before this step
    lasts = F.least(j, F.lit(2))  # context lines before the appended one
    say = lambda *x: F.concat(*[y if isinstance(y, Column) else F.lit(y) for y in x])
    num = lambda c: c.cast("string")
    first = _text(
        say("@@ -1,", num(tops), " +1,", num(F.when(j < 3, tops + 1).otherwise(tops)), " @@"),
        say("+", _line("top", i)),
        say(" ", _line("top", i - 1)),
        F.when(j >= 2, say(" ", _line("top", i - 2))),
        F.when(j >= 3, say("-", _line("top", i - 3))),
    )
    old_at = tops + F.greatest(j - 2, F.lit(0)) + 1
    new_at = F.when(j < 3, old_at + 1).otherwise(old_at)
    second = _text(
        say("@@ -", num(old_at), ",", num(lasts), " +", num(new_at), ",", num(lasts + 1), " @@ context"),
        F.when(j >= 2, say(" ", _line("low", i - 2))),
        say(" ", _line("low", i - 1)),
        say("+", _line("low", i)),
    )
    bad = F.lit("@@ -500,2 +500,0 @@\n-gone\n-gone\n")
    return F.concat(first, second, F.when((j == 6) & (F.col("part") % 10 == 0), bad).otherwise(F.lit(""))) if faulty else F.concat(first, second)


def render_parts_log(spark: SparkSession, sf_dir: str, faulty: bool = False) -> DataFrame:
    """The commits in log order (partitions, and rows in them): seq, seq_bucket, text."""
    s = ordered_steps(spark, sf_dir)
    i, j = F.col("i"), F.col("j")
    p1, p2, p3 = (_path(v, True) for v in (1, 2, 3))
    null = F.lit("/dev/null")
    now = F.when(j >= 5, p3).when(j == 4, p2).otherwise(p1)
    minus, plus = (lambda p: F.concat(F.lit("--- "), p)), (lambda p: F.concat(F.lit("+++ "), p))
    gone = F.concat(*[_text(F.concat(F.lit("-"), _line("top", i - k))) for k in (1, 2, 3)], *[_text(F.concat(F.lit("-"), _line("low", i - k))) for k in range(7, 0, -1)])
    create = F.concat(
        _diff(p1, p1, F.lit("new file mode 100644"), minus(null), plus(_shown(p1, "b/")), F.lit("@@ -0,0 +1,2 @@")),
        _text(F.concat(F.lit("+"), _line("top", i)), F.concat(F.lit("+"), _line("low", i))),
    )
    edit = F.concat(_diff(now, now, F.lit("index 1..2 100644"), minus(_shown(now, "a/")), plus(_shown(now, "b/"))), _hunks(faulty))
    moved = F.concat(
        _diff(p1, p2, F.lit("similarity index 60%"), F.concat(F.lit("rename from "), _shown(p1)), F.concat(F.lit("rename to "), _shown(p2)), minus(_shown(p1, "a/")), plus(_shown(p2, "b/"))),
        _hunks(faulty),
    )
    only_moved = _diff(p2, p3, F.lit("similarity index 100%"), F.concat(F.lit("rename from "), _shown(p2)), F.concat(F.lit("rename to "), _shown(p3)))
    with_lines = (F.floor(i / EPOCH) % 2) == 1
    delete = F.concat(
        _diff(p3, p3, F.lit("deleted file mode 100644")),
        F.when(with_lines, F.concat(_text(minus(_shown(p3, "a/")), plus(null), F.lit("@@ -1,10 +0,0 @@")), gone)).otherwise(F.lit("")),
    )
    body = F.when(j == 0, create).when(j == 7, delete).when(j == 4, moved).otherwise(edit)
    each = F.when(j == 5, F.array(only_moved, body)).otherwise(F.array(body))
    rows = s.select("*", F.posexplode(each).alias("sub", "diff"))
    header = F.concat(
        F.sha1(F.concat_ws(":", "part", "i", "sub")),
        F.lit("\nAuthor: Someone <"), F.col("author"), F.lit(">\nDate:   "), log_date(F.col("at")), F.lit(" +0100\n\n    step\n"),
    )
    return rows.select(F.struct("i", "part", "sub").alias("seq"), F.col("i").alias("seq_bucket"), F.concat(header, "diff").alias("text"))
