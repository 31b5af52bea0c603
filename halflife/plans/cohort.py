"""Cohort decay by (creation week, removal week) and decay rate per week.

Plan (reference mode, the default):

1. gap branch - distinct creation times, previous time via bucketed lag
   (hour buckets, so no single task sees the whole history), C7 minutes, averaged
   per creation cohort;
2. pair branch - one ``groupBy(create_cohort, remove_cohort)`` with count and
   max(lifespan) (the reference's two aggregates plus join, merged);
3. windows over the pair table (at most ~5,400 cohorts, since ids are yyWW):
   cohort total, running removed in (lifespan, remove_cohort) order, percentages,
   exponential rate;
4. the rate of a row whose cohort is fully lost keeps the previous row's rate,
   across cohorts too: last non-null within the cohort, else the carry from a
   one-row-per-cohort table.

``corrected=True`` counts living lines in the total only, leaves the rate null
when everything is lost and reports every cohort in P2.

A row may stand for several lines (the day states of ``plans/summary``): ``weight``
then names the column with their number, ``lifespan`` is their greatest, and ``times``
is the table with their creation times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halflife.functions.scalars import cohort_id, minutes_between
from halflife.operators.sequence import shift_in_buckets

P1_COLUMNS = [
    "create_cohort",
    "remove_cohort",
    "lifespan",
    "avg_time_between",
    "total_in_cohort",
    "removed_in_this_cohort",
    "total_removed_by_this_cohort",
    "pct_sliding_decay",
    "pct_total_decay",
    "decay_rate",
]

_UNBOUNDED = Window.unboundedPreceding


def with_cohorts(df: DataFrame) -> DataFrame:
    return df.withColumn("create_cohort", cohort_id("created")).withColumn(
        "remove_cohort", cohort_id("removed")
    )


def creation_gaps(df: DataFrame) -> DataFrame:
    """Gap of each distinct creation time to the previous one (C7 + R17).

    Equal neighbours give null in the all-rows window and ``avg`` skips nulls,
    so only distinct times matter.  Output: created, prev_created, gap_minutes.
    """
    times = df.select("created").where(F.col("created").isNotNull()).distinct()
    hour = F.datediff(F.to_date("created"), F.lit("1970-01-01").cast("date")).cast("bigint") * 24 + F.hour("created")
    prev = shift_in_buckets(
        times, keys=[], order=["created"], values=["created"], bucket=hour, direction=-1, prefix="prev_"
    )
    return prev.select(
        "created", "prev_created", minutes_between("created", "prev_created").alias("gap_minutes")
    )


def line_count(weight: str | None) -> Column:
    """Lines of a group: its rows, or the sum of their ``weight``."""
    return F.count(F.lit(1)) if weight is None else F.sum(weight).cast("bigint")


def cohort_pairs(df: DataFrame, weight: str | None = None) -> DataFrame:
    """Lines and max lifespan per (create_cohort, remove_cohort)."""
    return with_cohorts(df).groupBy("create_cohort", "remove_cohort").agg(
        line_count(weight).alias("removed_in_this_cohort"),
        F.max("lifespan").alias("lifespan"),
    )


def _avg_gaps(df: DataFrame) -> DataFrame:
    return (
        creation_gaps(df)
        .groupBy(cohort_id("created").alias("create_cohort"))
        .agg(F.avg("gap_minutes").alias("avg_time_between"))
    )


def _raw_rate(total, lost, lifespan):
    ratio = (total - lost).cast("double") / total.cast("double")
    return F.when(lost < total, F.ln(ratio) / F.greatest(lifespan, F.lit(1)).cast("double") * 100000.0)


def _decay_rows(df: DataFrame, corrected: bool, weight: str | None, times: DataFrame | None) -> DataFrame:
    lines = with_cohorts(df).select("create_cohort", "remove_cohort", "lifespan", *([weight] if weight else []))
    counted = (line_count(weight).alias("removed_in_this_cohort"), F.max("lifespan").alias("lifespan"))
    if corrected:
        lines = lines.where(F.col("create_cohort") != -1)
        totals = lines.groupBy("create_cohort").agg(line_count(weight).alias("total_in_cohort"))
        pairs = (
            lines.where(F.col("remove_cohort") != -1)
            .groupBy("create_cohort", "remove_cohort")
            .agg(*counted)
            .join(totals, "create_cohort")
        )
    else:
        pairs = lines.groupBy("create_cohort", "remove_cohort").agg(*counted)
        pairs = pairs.withColumn(
            "total_in_cohort", F.sum("removed_in_this_cohort").over(Window.partitionBy("create_cohort"))
        )
    w = (
        Window.partitionBy("create_cohort")
        .orderBy("lifespan", "remove_cohort")
        .rowsBetween(_UNBOUNDED, Window.currentRow)
    )
    running = F.sum("removed_in_this_cohort").over(w)
    out = pairs.withColumn("total_removed_by_this_cohort", running)
    total, lost = F.col("total_in_cohort"), F.col("total_removed_by_this_cohort")
    out = out.withColumn(
        "pct_sliding_decay", F.col("removed_in_this_cohort").cast("double") / total.cast("double") * 100.0
    ).withColumn("pct_total_decay", lost.cast("double") / total.cast("double") * 100.0)
    out = out.withColumn("raw_rate", _raw_rate(total, lost, F.col("lifespan")))
    return out.join(_avg_gaps(df if times is None else times), "create_cohort", "left")


def _carried(rows: DataFrame) -> DataFrame:
    """Reference carry: a missing rate repeats the last computed one, 0 at first."""
    w = (
        Window.partitionBy("create_cohort")
        .orderBy("lifespan", "remove_cohort")
        .rowsBetween(_UNBOUNDED, Window.currentRow)
    )
    rows = rows.withColumn("__in_rate", F.last("raw_rate", ignorenulls=True).over(w))
    ends = rows.groupBy("create_cohort").agg(
        F.max_by("__in_rate", F.struct("lifespan", "remove_cohort")).alias("__end_rate")
    )
    wc = Window.orderBy("create_cohort").rowsBetween(_UNBOUNDED, -1)
    ends = ends.select(
        "create_cohort",
        "__end_rate",
        F.coalesce(F.last("__end_rate", ignorenulls=True).over(wc), F.lit(0.0)).alias("__carry"),
        F.lead("create_cohort").over(Window.orderBy("create_cohort")).alias("__next_cohort"),
    )
    # One row per cohort; ids are yyWW or -1, so at most 100 * 54 + 1 rows.
    rows = rows.join(F.broadcast(ends), "create_cohort")
    return rows.withColumn("decay_rate", F.coalesce(F.col("__in_rate"), F.col("__carry")))


def cohort_decay(
    df: DataFrame, corrected: bool = False, weight: str | None = None, times: DataFrame | None = None
) -> DataFrame:
    """P1 on a typed lifecycle table (created/removed timestamps, lifespan int)."""
    rows = _decay_rows(df, corrected, weight, times)
    if corrected:
        rows = rows.withColumn("decay_rate", F.col("raw_rate"))
    else:
        rows = _carried(rows)
    return rows.select(*P1_COLUMNS).orderBy("create_cohort", "lifespan", "remove_cohort")


def weekly_decay(
    df: DataFrame, corrected: bool = False, weight: str | None = None, times: DataFrame | None = None
) -> DataFrame:
    """Rate at the end of each creation cohort; columns decay_rate, week.

    Reference mode leaves out the greatest cohort (never flushed).
    """
    rows = _decay_rows(df, corrected, weight, times)
    if corrected:
        weeks = (
            with_cohorts(df)
            .where(F.col("create_cohort") != -1)
            .select(F.col("create_cohort").alias("week"))
            .distinct()
        )
        last = rows.groupBy(F.col("create_cohort").alias("week")).agg(
            F.max_by("raw_rate", F.struct("lifespan", "remove_cohort")).alias("decay_rate")
        )
        return weeks.join(last, "week", "left").select("decay_rate", "week").orderBy("week")
    rows = _carried(rows)
    ends = rows.where(F.col("__next_cohort").isNotNull()).groupBy(
        F.col("create_cohort").alias("week")
    ).agg(F.max_by("decay_rate", F.struct("lifespan", "remove_cohort")).alias("decay_rate"))
    return ends.select("decay_rate", "week").orderBy("week")
