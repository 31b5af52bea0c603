"""R14/P4 as mergeable bitmaps: persons get dense numbers, weeks are sets of numbers.

``number_people`` gives every person a number, from 1 on without gaps, in the order of the
first week the person is seen; persons who arrive later get the next numbers, so earlier
bitmaps stay valid.  ``week_bitmaps`` holds a week as blocks of 32,768 bits (Spark's bitmap
aggregates); persons who start together have neighbouring numbers, so a week touches few
blocks.  Bitmaps of any split of the input merge by OR, and distinct persons of a week, a
year or any set of weeks are bit counts: (week, person) pairs are never read again.

No task sees all persons: numbers are ranks within (first week, hash part) plus the
start of that part, from a table of one row per part (calendar weeks times ``parts``).

Null persons and rows without a week (-1) take no part, as in P4 corrected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halflife.functions.scalars import cohort_sort_key


def people_weeks(df: DataFrame) -> DataFrame:
    """(person, week) of creators by creation week and removers by removal week; a week is year * 100 + week."""
    both = F.explode(
        F.array(
            F.struct(F.col("creator").alias("person"), cohort_sort_key("created").alias("week")),
            F.struct(F.col("remover").alias("person"), cohort_sort_key("removed").alias("week")),
        )
    )
    rows = df.select(both.alias("x")).select("x.person", "x.week")
    return rows.where(F.col("person").isNotNull() & (F.col("week") != -1)).distinct()


def number_people(weeks: DataFrame, known: DataFrame | None = None, parts: int = 16) -> DataFrame:
    """(person, number) of all persons in ``weeks`` and ``known``; numbers of ``known`` are kept."""
    first = weeks.groupBy("person").agg(F.min("week").alias("first"))
    start = F.lit(0).cast("bigint")
    if known is not None:
        first = first.join(known, "person", "left_anti")
        start = F.coalesce(known.agg(F.max("number")).scalar(), start)
    first = first.withColumn("part", F.pmod(F.xxhash64("person"), F.lit(parts)))
    # One row per (week, part): bounded by the calendar.
    sizes = first.groupBy("first", "part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("first", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("first", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("first", "part").orderBy("person"))
    ranked = first.withColumn("rank", rank).join(F.broadcast(starts), ["first", "part"])
    new = ranked.select("person", (start + F.col("before") + F.col("rank")).cast("bigint").alias("number"))
    return new if known is None else known.select("person", "number").unionByName(new)


def week_bitmaps(weeks: DataFrame, numbers: DataFrame) -> DataFrame:
    """(week, block, bits): the persons of each week as blocks of bits."""
    at = weeks.join(numbers, "person")
    return at.groupBy("week", F.bitmap_bucket_number("number").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    )


def merge_bitmaps(*parts: DataFrame) -> DataFrame:
    """Bitmaps of the union of the parts (which may overlap)."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("week", "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_people(bitmaps: DataFrame, period: Column, name: str) -> DataFrame:
    """Distinct persons per ``period``, an expression on ``week`` (year * 100 + week)."""
    blocks = bitmaps.groupBy(period.alias(name), "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    return blocks.groupBy(name).agg(F.sum(F.bitmap_count("bits")).alias("active_people")).orderBy(name)
