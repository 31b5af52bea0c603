"""Lifecycle views over the driver's TPC-H-like test tables (FIXTURES.md §3).

Each view reads whole tables and yields the typed lifecycle schema

    path STRING, creator STRING, remover STRING,
    created TIMESTAMP_NTZ, removed TIMESTAMP_NTZ, lifespan INT

or, for files, ``file_id, added, removed``.  Column pruning and filters reach
the parquet scans; joins are left to Catalyst/AQE (no unchecked broadcasts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halflife.functions.scalars import lifespan_days, truncate_seconds
from halflife.operators.sequence import shift_in_buckets, time_slices
from halflife.session import source_key, stage

LIFECYCLE_COLUMNS = ["path", "creator", "remover", "created", "removed", "lifespan"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


ORDER_TABLES = ("lineitem", "orders", "part")


def tables_key(spark: SparkSession, sf_dir: str, names) -> tuple:
    """State of the named tables' files."""
    return source_key(spark, *[f"{sf_dir.rstrip('/')}/{n}.parquet" for n in names])


def _staged(df: DataFrame, name: str, spark: SparkSession, sf_dir: str, tables, *more) -> DataFrame:
    return stage(df, name, key=(tables_key(spark, sf_dir, tables), *more))


def staged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders_life_raw`` as the table that every order report reads."""
    return _staged(orders_life_raw(spark, sf_dir), "orders_life", spark, sf_dir, ORDER_TABLES)


def with_lifespan(df: DataFrame) -> DataFrame:
    """Lifespan against the history's last change + 1 day.

    The last change is a scalar subquery (one aggregate, computed once).
    """
    last_day = df.agg(
        (F.greatest(F.max("created"), F.max("removed")) + F.expr("INTERVAL 1 DAY")).alias("last_day")
    ).scalar()
    return df.withColumn("lifespan", lifespan_days("created", "removed", last_day))


def orders_life_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as code lines: part name is the file, customer the creator,
    supplier the remover of finished lines (FIXTURES §3.2), without lifespan."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linestatus", "l_shipdate"
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    done = F.col("l_linestatus") == "F"
    return j.select(
        F.concat(
            F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.lit(".java")).otherwise(F.lit(".py"))
        ).alias("path"),
        F.concat(F.lit("u"), (F.col("o_custkey") % 50).cast("string")).alias("creator"),
        F.when(done, F.concat(F.lit("u"), (F.col("l_suppkey") % 50).cast("string"))).alias("remover"),
        F.col("o_orderdate").alias("created"),
        F.when(done, F.col("l_shipdate")).alias("removed"),
    )


def orders_life(spark: SparkSession, sf_dir: str, staged: bool = True) -> DataFrame:
    raw = orders_life_raw(spark, sf_dir)
    return with_lifespan(_staged(raw, "orders_life", spark, sf_dir, ORDER_TABLES) if staged else raw)


def events_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their slot (event_type, props) and the slot's file path."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    k = F.get_json_object("props", "$.k")
    suffix = F.when(F.col("event_type").isin("click", "view"), F.lit(".java")).otherwise(F.lit(".py"))
    return e.withColumn("path", F.concat(F.col("event_type"), F.lit("/"), k, suffix))


def events_life_raw(spark: SparkSession, sf_dir: str, slice_rows: int = 2_000_000) -> DataFrame:
    """A slot is held by a user until the next event of the slot takes it
    (FIXTURES §3.1).  The successor is found per time slice, so a hot slot is
    spread over many tasks (see operators.sequence)."""
    e = time_slices(events_slots(spark, sf_dir), "ts", slice_rows)
    nxt = shift_in_buckets(
        e,
        keys=["event_type", "props"],
        order=["ts", "event_id"],
        values=["ts", "user_id"],
        bucket=F.col("__hl_slice"),
        direction=1,
        prefix="next_",
    )
    return nxt.select(
        "path",
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("creator"),
        F.concat(F.lit("u"), F.col("next_user_id").cast("string")).alias("remover"),
        truncate_seconds("ts").alias("created"),
        truncate_seconds("next_ts").alias("removed"),
    )


def events_life(spark: SparkSession, sf_dir: str, slice_rows: int = 2_000_000, staged: bool = True) -> DataFrame:
    raw = events_life_raw(spark, sf_dir, slice_rows)
    return with_lifespan(_staged(raw, "events_life", spark, sf_dir, ("events",), slice_rows) if staged else raw)


def parts_files(spark: SparkSession, sf_dir: str, staged: bool = True) -> DataFrame:
    """Parts as files: first order date adds, every fifth part is removed at its
    last ship date (FIXTURES §3.3).  Partial aggregation runs before the shuffle."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    g = (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .groupBy("l_partkey")
        .agg(F.min("o_orderdate").alias("added"), F.max("l_shipdate").alias("__last_ship"))
    )
    files = g.select(
        F.col("l_partkey").alias("file_id"),
        "added",
        F.when(F.col("l_partkey") % 5 == 0, F.col("__last_ship")).alias("removed"),
    )
    return _staged(files, "parts_files", spark, sf_dir, ("lineitem", "orders")) if staged else files
