"""Neighbour lookups (lead / lag) that do not put a whole key, or the whole
table, into one task.

``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one task; a
key holding a third of the data then runs on one core, and a window without
keys runs on one core always.  Here the ordered rows are cut into buckets by a
monotone function of the order column (for example the day, or a time slice
sized from the data), the neighbour is taken inside each (key, bucket) group,
and only the rows at a bucket edge look across: their neighbour is the
first (or last) row of the next (or previous) non-empty bucket of the same key,
found by a window over one row per bucket.

Results equal the plain window whenever ``bucket`` is non-decreasing in the
order columns (nulls first).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halflife.functions.scalars import clock_micros

MICROS_PER_HOUR = 3_600_000_000

_B = "__hl_bucket"
_N = "__hl_near"
_E = "__hl_edge"


def shift_in_buckets(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    bucket: Column,
    *,
    direction: int = 1,
    prefix: str = "next_",
) -> DataFrame:
    """Add ``prefix + v`` for each ``v`` in ``values``: the value on the next
    (``direction=1``, lead) or previous (``direction=-1``, lag) row in ``order``
    within ``keys``.  Rows without such a neighbour get nulls.
    """
    keys, order, values = list(keys), list(order), list(values)
    payload = F.struct(*[F.col(v).alias(v) for v in values])
    rank = F.struct(*[F.col(o) for o in order])
    staged = df.withColumn(_B, bucket)

    w = Window.partitionBy(*keys, _B).orderBy(*[F.col(o).asc_nulls_first() for o in order])
    near = F.lead(payload, 1).over(w) if direction > 0 else F.lag(payload, 1).over(w)
    marked = staged.withColumn(_N, near)

    # One row per (key, bucket): the row a neighbouring bucket's edge row needs.
    edge_value = F.min_by(payload, rank) if direction > 0 else F.max_by(payload, rank)
    per_bucket = staged.groupBy(*keys, _B).agg(edge_value.alias(_E))
    wb = Window.partitionBy(*keys).orderBy(F.col(_B).asc_nulls_first())
    carry = F.lead(_E, 1).over(wb) if direction > 0 else F.lag(_E, 1).over(wb)
    per_bucket = per_bucket.select(*keys, _B, carry.alias(_E))

    joined = marked.join(per_bucket, on=[*keys, _B], how="left")
    filled = F.coalesce(F.col(_N), F.col(_E))
    out = joined.withColumn(_N, filled)
    out = out.select(
        *[c for c in df.columns],
        *[F.col(f"{_N}.{v}").alias(prefix + v) for v in values],
    )
    return out


def time_slices(df: DataFrame, ts: str, target_rows: int = 2_000_000) -> DataFrame:
    """Add ``__hl_slice``: a time slice of about ``target_rows`` rows, non-decreasing in ``ts``.

    Slices are cut by the rows of each hour: quiet hours share a slice, and an hour with
    more rows than that is cut into equal parts, so a burst spreads over as many
    slices as its rows ask for.  The table of hours is bounded by the calendar.
    Use as the ``bucket`` of :func:`shift_in_buckets`.
    """
    hour = (F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")) * 24 + F.hour(ts)).cast("bigint")
    in_hour = F.pmod(clock_micros(ts), F.lit(MICROS_PER_HOUR))
    rows = df.withColumns({"__hl_hour": hour, "__hl_in": in_hour})
    hours = rows.groupBy("__hl_hour").agg(F.count(F.lit(1)).alias("__hl_n"))
    before = Window.orderBy("__hl_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select(
        F.col("__hl_hour").alias("__hl_h"),
        F.floor(F.coalesce(F.sum("__hl_n").over(before), F.lit(0)) / target_rows).cast("bigint").alias("__hl_base"),
        F.greatest(F.ceil(F.col("__hl_n") / target_rows), F.lit(1)).cast("bigint").alias("__hl_parts"),
    )
    rows = rows.join(hours, F.col("__hl_hour").eqNullSafe(F.col("__hl_h")))
    part = F.coalesce(F.floor(F.col("__hl_in") * F.col("__hl_parts") / MICROS_PER_HOUR), F.lit(0))
    return rows.withColumn("__hl_slice", (F.col("__hl_base") + part).cast("bigint")).select(*df.columns, "__hl_slice")


def fill_forward_in_buckets(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    bucket: Column,
    out: str,
) -> DataFrame:
    """Add ``out``: the last non-null ``value`` at or before each row in
    ``order`` within ``keys`` (``last(value, ignorenulls)`` over a running
    frame), computed per (key, bucket) with a carry from earlier buckets.
    """
    keys, order = list(keys), list(order)
    rank = F.struct(*[F.col(o) for o in order])
    staged = df.withColumn(_B, bucket)
    w = (
        Window.partitionBy(*keys, _B)
        .orderBy(*[F.col(o).asc_nulls_first() for o in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    marked = staged.withColumn(_N, F.last(value, ignorenulls=True).over(w))
    # Every bucket gets a row (null when it has no value), so the carry reaches
    # buckets without values too.
    last_in_bucket = F.max(F.when(F.col(value).isNotNull(), F.struct(rank.alias("r"), F.col(value).alias("v"))))
    per_bucket = staged.groupBy(*keys, _B).agg(last_in_bucket.getField("v").alias(_E))
    wb = Window.partitionBy(*keys).orderBy(F.col(_B).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select(*keys, _B, F.last(_E, ignorenulls=True).over(wb).alias(_E))
    joined = marked.join(per_bucket, on=[*keys, _B], how="left")
    return joined.select(*df.columns, F.coalesce(F.col(_N), F.col(_E)).alias(out))


# How a running value takes the carry of the buckets before.
_MEET = {
    "sum": lambda carry, here: F.coalesce(carry + here, carry, here),
    "min": lambda carry, here: F.least(carry, here),
    "max": lambda carry, here: F.greatest(carry, here),
    "last": lambda carry, here: F.coalesce(here, carry),
}
_RUN = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def scan_in_buckets(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, tuple[str, str]],
    buckets: Column | Sequence[Column],
    *,
    inclusive: bool = True,
) -> DataFrame:
    """Add running values: ``columns`` maps each new column to (``sum``, ``min``, ``max`` or
    ``last``, value column), over the rows up to each row (before it, if not ``inclusive``) in
    ``order`` within ``keys``; ``last`` skips nulls.

    A prefix scan in two passes.  Rows are scanned per (key, bucket); each bucket's total
    becomes one row, the totals are scanned, and every row takes the carry of the buckets
    before its own.  ``buckets`` may be several, from fine to coarse, each non-decreasing in
    the one before: then the totals are scanned in the coarser buckets in the same way, so
    that no task ever holds all of them.  Rows of one order value should lie in one bucket.
    """
    buckets = [buckets] if isinstance(buckets, Column) else list(buckets)
    keys, order = list(keys), list(order)
    names = [f"{_B}_{len(buckets)}_{i}" for i in range(len(buckets))]  # unlike those of the scan of totals
    rows = df.withColumns(dict(zip(names, buckets)))
    inside = Window.partitionBy(*keys, names[0]).orderBy(*[F.col(o).asc_nulls_first() for o in order])
    frame = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    here = {out: f"__hl_here_{out}" for out in columns}
    rows = rows.withColumns({here[out]: _RUN[fn](F.col(v)).over(frame) for out, (fn, v) in columns.items()})
    rank = F.struct(*[F.col(o) for o in order])

    def total(fn: str, value: str) -> Column:
        if fn != "last":
            return _RUN[fn](F.col(value))
        return F.max(F.when(F.col(value).isNotNull(), F.struct(rank.alias("r"), F.col(value).alias("v")))).getField("v")

    totals = rows.groupBy(*keys, *names).agg(*[total(fn, v).alias(f"__hl_total_{out}") for out, (fn, v) in columns.items()])
    carried = {f"__hl_carry_{out}": (fn, f"__hl_total_{out}") for out, (fn, _) in columns.items()}
    if len(names) > 1:
        totals = scan_in_buckets(totals, keys, [names[0]], carried, [F.col(n) for n in names[1:]], inclusive=False)
    else:
        before = Window.partitionBy(*keys).orderBy(F.col(names[0]).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumns({c: _RUN[fn](F.col(v)).over(before) for c, (fn, v) in carried.items()})
    totals = totals.select(*[F.col(k).alias(f"__hl_k_{k}") for k in keys], F.col(names[0]).alias("__hl_at"), *carried)
    same = F.col(names[0]).eqNullSafe(F.col("__hl_at"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__hl_k_{k}"))
    met = rows.join(totals, same, "left")
    return met.select(*df.columns, *[_MEET[fn](F.col(f"__hl_carry_{out}"), F.col(here[out])).alias(out) for out, (fn, _) in columns.items()])
