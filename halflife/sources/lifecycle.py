"""The lifecycle table as text (CSV) and typed.

Text form, one row per item, all strings, header
``Path, Creator, Remover, Created, Removed, Lifespan``; the literal ``None``
marks a missing remover/removal; times are ``yyyy-MM-dd HH:mm:ss``.  Typed
form: see :data:`TYPED_SCHEMA`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from halflife.functions.scalars import NONE_TEXT, clean_date, clean_int, time_text, whole_days

TEXT_SCHEMA = StructType(
    [StructField(n, StringType()) for n in ["path", "creator", "remover", "created", "removed", "lifespan"]]
)
TYPED_SCHEMA = (
    "path STRING, creator STRING, remover STRING, created TIMESTAMP_NTZ, "
    "removed TIMESTAMP_NTZ, lifespan INT"
)
# Fixed value: header line of the lifecycle text file.
TEXT_HEADER = ["Path", "Creator", "Remover", "Created", "Removed", "Lifespan"]


def read_lifecycle_text(spark: SparkSession, path: str) -> DataFrame:
    """S3: all-string schema bound by position, header skipped, malformed rows dropped.

    Column pruning in the CSV parser is off for this read, so DROPMALFORMED
    judges whole rows whatever the query projects (Q15).
    """
    reader = spark.read.option("columnPruning", "false")
    return reader.csv(path, schema=TEXT_SCHEMA, header=True, mode="DROPMALFORMED")


def format_time(c) -> F.Column:
    """Python ``str(datetime)``: seconds, plus six fraction digits only when non-zero."""
    c = F.col(c) if isinstance(c, str) else c
    text = c.cast("string")  # drops trailing zeros of the fraction, and a zero fraction altogether
    frac = F.rpad(F.substring(text, 21, 6), 6, "0")
    return F.when(F.length(text) <= 19, text).otherwise(F.concat(time_text(c), F.lit("."), frac))


def to_lifecycle_text(df: DataFrame, last_day_col: str | None = None) -> DataFrame:
    """Render typed rows in the text form.

    ``lifespan`` is the raw whole-day count (negative when removed before
    created), as the log replay writes it; with ``last_day_col`` open items are
    measured to that column, otherwise the typed ``lifespan`` is written.
    """
    if last_day_col is not None:
        days = whole_days("created", F.coalesce(F.col("removed"), F.col(last_day_col)))
        life = F.when(F.col("created").isNull(), F.lit(None)).otherwise(days.cast("string"))
    else:
        life = F.col("lifespan").cast("string")
    none = F.lit(NONE_TEXT)
    return df.select(
        F.coalesce(F.col("path"), none).alias("path"),
        F.coalesce(F.col("creator"), none).alias("creator"),
        F.coalesce(F.col("remover"), none).alias("remover"),
        F.coalesce(format_time("created"), none).alias("created"),
        F.coalesce(format_time("removed"), none).alias("removed"),
        F.coalesce(life, none).alias("lifespan"),
    )


def type_lifecycle(raw: DataFrame) -> DataFrame:
    """Text columns to typed ones (lifespan INT, times TIMESTAMP_NTZ)."""
    return raw.select(
        "path",
        "creator",
        F.when(F.col("remover") != NONE_TEXT, F.col("remover")).alias("remover"),
        clean_date("created").alias("created"),
        clean_date("removed").alias("removed"),
        clean_int("lifespan").alias("lifespan"),
    )


def write_lifecycle_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Quoted CSV with the reference header, so commas in paths/authors survive."""
    out = df.toDF(*TEXT_HEADER)
    out.write.mode(mode).option("header", True).option("quoteAll", True).csv(path)


def write_lifecycle_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S4 (columnar): typed lifecycle as parquet, the preferred hand-over format."""
    df.write.mode(mode).parquet(path)
