"""Weekly activity (P3/P4, corrected mode) kept up to date as line events arrive.

A lifecycle row is not append-only (a line is created in one log segment and
removed in a later one), but its events are: ``created`` at the creation time
by the creator, ``removed`` at the removal time by the remover.  New log
segments therefore append line events, and the weekly reports are streaming
aggregations over them:

* ``weekly_counts`` - lines created / removed per week (state: one row per week);
* ``weekly_people`` - distinct people per week, via ``dropDuplicates`` on
  (week, person) (state: one row per pair) and a count per week.

``start_weekly_activity`` runs both and, per micro-batch, turns the complete
weekly tables (bounded by the calendar) into the P3/P4 snapshots with running
totals, written with ``foreachBatch`` to a table folder (overwrite).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halflife.functions.scalars import cohort_sort_key

LINE_EVENT_SCHEMA = "kind STRING, at TIMESTAMP_NTZ, person STRING"


def to_line_events(lifecycle: DataFrame) -> DataFrame:
    """Batch helper: a lifecycle table as its append-only line events."""
    created = lifecycle.where(F.col("created").isNotNull()).select(
        F.lit("created").alias("kind"), F.col("created").alias("at"), F.col("creator").alias("person")
    )
    removed = lifecycle.where(F.col("removed").isNotNull()).select(
        F.lit("removed").alias("kind"), F.col("removed").alias("at"), F.col("remover").alias("person")
    )
    return created.unionByName(removed)


def _week_key(events: DataFrame) -> DataFrame:
    return events.withColumn("week_key", cohort_sort_key(F.to_date("at"))).where(F.col("week_key") != -1)


def weekly_counts(events: DataFrame) -> DataFrame:
    """Streaming-safe aggregate: week_key, lines_created, lines_removed."""
    return _week_key(events).groupBy("week_key").agg(
        F.count_if(F.col("kind") == "created").alias("lines_created"),
        F.count_if(F.col("kind") == "removed").alias("lines_removed"),
    )


def weekly_people(events: DataFrame) -> DataFrame:
    """Streaming-safe distinct count: week_key, active_people."""
    pairs = _week_key(events).where(F.col("person").isNotNull()).select("week_key", "person")
    return pairs.dropDuplicates(["week_key", "person"]).groupBy("week_key").agg(
        F.count(F.lit(1)).alias("active_people")
    )


def _week_id(key):
    return ((F.floor(key / 100) % 100) * 100 + key % 100).cast("int")


def active_lines_snapshot(counts: DataFrame) -> DataFrame:
    """P3 (corrected) from a complete weekly count table (a few thousand rows)."""
    w = Window.orderBy("week_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        counts.withColumn("running_created", F.sum("lines_created").over(w))
        .withColumn("running_removed", F.sum("lines_removed").over(w))
        .withColumn("active_lines", F.col("running_created") - F.col("running_removed"))
        .orderBy("week_key")
        .select(_week_id(F.col("week_key")).alias("week"), "lines_created", "running_created",
                "lines_removed", "running_removed", "active_lines")
    )


def start_weekly_activity(events: DataFrame, out_dir: str, checkpoint_dir: str, trigger: dict | None = None):
    """Start the two streaming queries; returns them (call ``processAllAvailable``
    / ``awaitTermination`` as needed).  Snapshots land in ``out_dir/active_lines``
    and ``out_dir/active_people``."""

    def lines_batch(batch: DataFrame, _epoch: int) -> None:
        active_lines_snapshot(batch).write.mode("overwrite").parquet(f"{out_dir}/active_lines")

    def people_batch(batch: DataFrame, _epoch: int) -> None:
        batch.select(_week_id(F.col("week_key")).alias("week"), "active_people").orderBy("week").write.mode(
            "overwrite"
        ).parquet(f"{out_dir}/active_people")

    trig = trigger or {"availableNow": True}
    q1 = (
        weekly_counts(events).writeStream.outputMode("complete").foreachBatch(lines_batch)
        .option("checkpointLocation", f"{checkpoint_dir}/active_lines").trigger(**trig).start()
    )
    q2 = (
        weekly_people(events).writeStream.outputMode("complete").foreachBatch(people_batch)
        .option("checkpointLocation", f"{checkpoint_dir}/active_people").trigger(**trig).start()
    )
    return q1, q2
