"""Per-author decay and daily change rates per author."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halflife.plans.cohort import line_count

P5_COLUMNS = [
    "creator",
    "lines_created",
    "lines_removed",
    "author_first",
    "author_last",
    "avg_lifespan",
    "lines_removed_by_author",
    "lines_active",
    "account_age",
    "account_lifespan",
    "account_dormant_for",
    "pct_removed",
    "pct_removed_by_self",
    "pct_of_active_code_base",
]


def _as_of(as_of) -> F.Column:
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, (_dt.date, str)):
        return F.lit(str(as_of)).cast("date")
    return as_of


def _nonzero(c):
    return F.when(c > 0, c)


def author_decay(
    df: DataFrame,
    path_like: str | None = None,
    exclude: Iterable[str] = (),
    as_of=None,
    weight: str | None = None,
) -> DataFrame:
    """P5 over all lines, or those whose path is LIKE ``path_like``: one conditional aggregate per creator (instead of five aggregates and
    four outer joins).  Counts absent in the reference's outer joins are null,
    not 0.  The live-line total is a scalar subquery, not a
    driver action.  ``as_of`` defaults to ``current_date()``.

    A row may stand for ``weight`` lines; it then carries ``lifespan_sum`` and
    ``lifespan_n`` (sum and number of their known lifespans)."""
    rows = df
    if path_like is not None:
        rows = rows.where(F.col("path").like(path_like))
    rows = rows.where(F.col("creator").isNotNull())
    exclude = list(exclude)
    if exclude:
        rows = rows.where(~F.col("creator").isin(exclude))
    spans = ["lifespan"] if weight is None else [weight, "lifespan_sum", "lifespan_n"]
    rows = rows.select("creator", "remover", "created", "removed", *spans)

    def lines_where(condition):
        if weight is None:
            return F.count_if(condition)
        return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0)).cast("bigint")

    if weight is None:
        avg_lifespan = F.avg("lifespan")
    else:
        avg_lifespan = F.try_divide(F.sum("lifespan_sum").cast("double"), F.sum("lifespan_n"))
    removed = F.col("removed").isNotNull()
    per = rows.groupBy("creator").agg(
        line_count(weight).alias("lines_created"),
        _nonzero(lines_where(removed)).alias("lines_removed"),
        F.to_date(F.min("created")).alias("author_first"),
        F.to_date(F.max("created")).alias("author_last"),
        avg_lifespan.alias("avg_lifespan"),
        _nonzero(lines_where(removed & (F.col("remover") == F.col("creator")))).alias("lines_removed_by_author"),
        _nonzero(lines_where(~removed)).alias("lines_active"),
    )
    total = rows.agg(lines_where(~removed)).scalar()  # live lines, one subquery
    day = _as_of(as_of)
    out = per.select(
        *[c for c in per.columns],
        F.datediff(day, F.col("author_first")).alias("account_age"),
        F.datediff(F.col("author_last"), F.col("author_first")).alias("account_lifespan"),
        F.datediff(day, F.col("author_last")).alias("account_dormant_for"),
        F.try_divide(F.col("lines_removed").cast("double"), F.col("lines_created")).alias("pct_removed"),
        F.try_divide(F.col("lines_removed_by_author").cast("double"), F.col("lines_created")).alias(
            "pct_removed_by_self"
        ),
        F.try_divide(F.col("lines_active").cast("double"), total).alias(
            "pct_of_active_code_base"
        ),
    )
    return out.select(*P5_COLUMNS).orderBy(F.col("pct_removed").asc_nulls_first(), "creator")


def author_change_rates(df: DataFrame, corrected: bool = False, weight: str | None = None) -> DataFrame:
    """Lines added and removed per (day, author).

    Reference mode counts as added only lines still alive (a line added and
    later removed shows up only as removed); corrected counts every creation.
    Input may carry ``file_removed``; lines of removed files are all closed, so
    'alive' is simply ``removed IS NULL``.  ``weight``: column with the number of lines
    that a row stands for.
    """
    lines, none = (F.lit(1) if weight is None else F.col(weight)).cast("bigint"), F.lit(0).cast("bigint")
    adds = df.where(F.col("created").isNotNull())
    if not corrected:
        adds = adds.where(F.col("removed").isNull())
    added = adds.select(
        F.to_date("created").alias("date"), F.col("creator").alias("author"),
        lines.alias("a"), none.alias("r"),
    )
    gone = df.where(F.col("removed").isNotNull()).select(
        F.to_date("removed").alias("date"), F.col("remover").alias("author"),
        none.alias("a"), lines.alias("r"),
    )
    return (
        added.unionByName(gone)
        .groupBy("date", "author")
        .agg(F.sum("a").alias("lines_added"), F.sum("r").alias("lines_removed"))
        .orderBy("date", "author")
    )
