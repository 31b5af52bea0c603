"""Active lines and active people per week.

Weekly tables have one row per week id (bounded by the calendar), so the
running sums are global windows over a few thousand rows; the heavy work is
the partial-then-final weekly count over the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halflife.functions.scalars import cohort_id, cohort_sort_key
from halflife.plans.cohort import line_count

P3_COLUMNS = ["week", "lines_created", "running_created", "lines_removed", "running_removed", "active_lines"]


def _weekly(df: DataFrame, ts: str, count_name: str, run_name: str, weight: str | None) -> DataFrame:
    counts = (
        df.select(cohort_id(F.to_date(ts)).alias("week"), *([weight] if weight else []))
        .where(F.col("week") != -1)
        .groupBy("week")
        .agg(line_count(weight).alias(count_name))
    )
    # Default RANGE frame of an ordered window, as in the reference.
    return counts.withColumn(run_name, F.sum(count_name).over(Window.orderBy("week")))


def active_lines(df: DataFrame, corrected: bool = False, weight: str | None = None) -> DataFrame:
    """P3.  Reference mode: created weeks LEFT JOIN removed weeks, so weeks with
    removals only are lost and weeks without removals have null active_lines.
    Corrected: every week with an event, totals carried, nulls as 0, weeks in
    calendar order (year * 100 + week).  ``weight``: column with the number of lines
    that a row stands for."""
    if not corrected:
        created = _weekly(df, "created", "lines_created", "running_created", weight)
        removed = _weekly(df, "removed", "lines_removed", "running_removed", weight)
        out = created.join(removed, "week", "left").withColumn(
            "active_lines", F.col("running_created") - F.col("running_removed")
        )
        return out.select(*P3_COLUMNS).orderBy("week")

    def counts(ts, name):
        return (
            df.select(cohort_sort_key(F.to_date(ts)).alias("week_key"), *([weight] if weight else []))
            .where(F.col("week_key") != -1)
            .groupBy("week_key")
            .agg(line_count(weight).alias(name))
        )

    both = counts("created", "lines_created").join(counts("removed", "lines_removed"), "week_key", "full")
    both = both.fillna(0, ["lines_created", "lines_removed"])
    w = Window.orderBy("week_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = (
        both.withColumn("running_created", F.sum("lines_created").over(w))
        .withColumn("running_removed", F.sum("lines_removed").over(w))
        .withColumn("active_lines", F.col("running_created") - F.col("running_removed"))
        .withColumn("week", ((F.floor(F.col("week_key") / 100) % 100) * 100 + F.col("week_key") % 100).cast("int"))
    )
    return out.orderBy("week_key").select(*P3_COLUMNS)


def active_people(df: DataFrame, corrected: bool = False) -> DataFrame:
    """Distinct persons per week.

    Reference mode counts creators by creation week (week -1 included): both
    union branches of the reference select the creator.  Corrected adds the
    removers by removal week and drops week -1 and null persons.
    """
    creators = df.select(F.col("creator").alias("person"), cohort_id(F.to_date("created")).alias("week"))
    if corrected:
        removers = df.select(F.col("remover").alias("person"), cohort_id(F.to_date("removed")).alias("week"))
        people = creators.unionByName(removers).where((F.col("week") != -1) & F.col("person").isNotNull())
    else:
        people = creators  # the reference's second branch repeats the first; distinct counts do not change
    # Distinct (week, person) first: partial aggregation before the shuffle, and
    # a hot week only holds its distinct people.
    return (
        people.groupBy("week")
        .agg(F.count_distinct("person").alias("active_people"))
        .orderBy("week")
    )
