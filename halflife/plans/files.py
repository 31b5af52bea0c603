"""Daily file population statistics and the history summary.

The reference loops days x files.  Here nothing is expanded over days.  A file is in one
age bucket on an interval of days, ten buckets at most in its life, and counts on an
interval of days in each sum.  So files are counted by their days (added, removed) first;
each such group adds its number where an interval begins and takes it off where it ends;
those differences are summed per day, and one running sum along the calendar, scanned in
buckets of a year, gives every day's figures.  Work is linear in files and days.

Day ``D`` is stamped ``D 23:59:59``.  A file counts from the first stamp after
its time: ``e = date(t + 1s)``.  Its age on ``D`` is ``(stamp - t).days + 1 =
D - k + 1`` with ``k = date(t + 999999us)``; it is "today" only when
``D == e == k`` (a time of exactly 23:59:59 counts from the next day and never
as today).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halflife.functions.scalars import day_string, whole_days
from halflife.operators.sequence import scan_in_buckets

P7_COLUMNS = (
    ["date", "files_created_today", "files_removed_today", "files_in_existence", "files_in_removed",
     "avg_lifetime", "avg_removetime"]
    + [f"e{i}" for i in range(1, 11)]
    + [f"r{i}" for i in range(1, 11)]
)
P8_COLUMNS = ["files", "removed_files", "start", "last_change", "duration"]


def file_bounds(files: DataFrame) -> DataFrame:
    """One row: history start (first add) and last change (last add or removal)."""
    return files.agg(
        F.min("added").alias("start"),
        F.greatest(F.max("added"), F.max("removed")).alias("last_change"),
    )


def _calendar(bounds: DataFrame) -> DataFrame:
    first_day = F.col("start") - F.expr("INTERVAL 1 DAY")
    last_day = F.col("last_change") + F.expr("INTERVAL 1 DAY")
    n_days = whole_days(first_day, last_day) + 1
    return bounds.select(
        "start",
        F.to_date(first_day).alias("d0"),
        F.date_add(F.to_date(first_day), n_days - 1).alias("d_max"),
    )


def _span(lo, hi):
    return F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<date>")))


def _day_number(day) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint")


def _floor_div(a: Column, b) -> Column:
    """floor(a / b) of integers, b > 0."""
    b = F.lit(b).cast("bigint") if isinstance(b, int) else b
    return F.call_function("div", a - F.pmod(a, b), b)


def _age_bounds(k: Column, d0: Column) -> list[Column]:
    """First day on which a live file's bucket is i or more, for i = 1 .. 9.

    On day D the bucket is 10 (D - k + 1) // (D - d0), so it is i or more from
    D = ceil((10 (k - 1) - i d0) / (10 - i)) on: the older the history, the nearer to its age.
    """
    return [-_floor_div(-(10 * (k - 1) - i * d0), 10 - i) for i in range(1, 10)]


def _removal_bounds(age: Column, d0: Column) -> list[Column]:
    """First day on which a removed file's bucket, 10 age // (D - d0), is below i, for i = 1 .. 9."""
    return [d0 + _floor_div(10 * age, i) + 1 for i in range(1, 10)]


def _differences(groups: DataFrame, intervals: list[tuple[str, Column, Column]], n: Column) -> DataFrame:
    """Per day: for each named sum, what begins less what ends there; ``intervals`` are (name,
    first day, day after the last), empty ones add nothing."""
    names = sorted({name for name, _, _ in intervals})
    ends = F.array(*[F.struct(F.lit(name).alias("c"), lo.alias("lo"), hi.alias("hi")) for name, lo, hi in intervals])
    some = groups.select(n.alias("n"), "k", F.explode(ends).alias("x")).where("x.lo < x.hi")
    both = F.array(F.struct(F.col("x.lo").alias("d"), F.lit(1).alias("sign")), F.struct(F.col("x.hi").alias("d"), F.lit(-1).alias("sign")))
    at = some.select("n", "k", F.col("x.c").alias("c"), F.explode(both).alias("at")).select("c", "at.d", (F.col("n") * F.col("at.sign")).alias("w"), "k")
    of = lambda name: F.sum(F.when(F.col("c") == name, F.when(F.col("c").startswith("sum"), F.col("w") * F.col("k")).otherwise(F.col("w"))))
    return at.groupBy("d").agg(*[of(name).alias(name) for name in names])


def _bucket_intervals(p: str, bounds: list[Column], rising: bool) -> list[tuple[str, Column, Column]]:
    """Intervals of days of a group that counts on [b, g): all of them, and those of each bucket.

    ``bounds`` are the days from which the bucket is i or more (``rising``) or below i, for i =
    1 .. 9.  On the calendar's first day there are no days yet to share out: bucket 0.
    """
    b, g, first = F.col("b"), F.col("g"), F.col("first")
    later = F.greatest(b, first + 1)
    out = [(f"all_{p}", b, g), (f"sum_{p}", b, g), (f"{p}1", b, F.least(g, first + 1))]
    for i in range(10):
        if rising:
            lo, hi = (bounds[i - 1] if i else later), (bounds[i] if i < 9 else g)
        else:
            lo, hi = (bounds[i] if i < 9 else later), (bounds[i - 1] if i else g)
        out.append((f"{p}{i + 1}", F.greatest(later, lo), F.least(g, hi)))
    return out


def file_population(files: DataFrame, bounds: DataFrame | None = None, corrected: bool = False) -> DataFrame:
    """P7 over ``files(added, removed)``; ``bounds`` is a one-row (start, last_change).

    Reference mode: existence and age buckets (e1..e10) cover files never
    removed; removal stats (r1..r10) cover removed files, aged from the history
    start.  Corrected: existence counts every file alive at the day's stamp and
    created-today counts every file added that day.
    """
    if bounds is None:
        bounds = file_bounds(files)
    cal = _calendar(bounds)  # one row: history start, first and last report day
    c = cal.select(F.struct("start", "d0", "d_max")).scalar()
    plus_1s = F.expr("INTERVAL 1 SECOND")
    almost_1s = F.expr("INTERVAL 0.999999 SECOND")
    f = files.select(
        F.to_date(F.col("added") + plus_1s).alias("e"),
        F.to_date(F.col("added") + almost_1s).alias("k"),
        F.to_date(F.col("removed") + plus_1s).alias("er"),
        F.to_date(F.col("removed") + almost_1s).alias("kr"),
        whole_days(c.getField("start"), F.col("removed")).alias("rage"),
        F.col("removed").isNull().alias("live"),
        c.getField("d0").alias("d0"),
        c.getField("d_max").alias("d_max"),
        F.col("added").isNotNull().alias("has_add"),
    )

    d0, end = _day_number(F.col("d0")), _day_number(F.col("d_max")) + 1
    f = f.withColumns({"first": d0, "end": end})

    # -- existence: from the effective day on; in the corrected mode until the removal's
    ex = f.where(F.col("has_add") & (F.col("live") if not corrected else F.lit(True)))
    begin = F.greatest(_day_number(F.col("e")), F.col("first"))
    gone = F.when(F.col("er").isNotNull(), F.greatest(_day_number(F.col("er")), begin)) if corrected else F.lit(None).cast("bigint")
    ex = ex.groupBy(_day_number(F.col("k")).alias("k"), begin.alias("b"), F.least(F.coalesce(gone, F.col("end")), F.col("end")).alias("g"), "first").agg(F.count(F.lit(1)).alias("n"))
    ex = _differences(ex, _bucket_intervals("e", _age_bounds(F.col("k"), F.col("first")), rising=True), F.col("n"))

    # -- removals: from the day after the removal on, with the age it had, the history's start being 0
    rm = f.where(~F.col("live")).groupBy(F.col("rage").cast("bigint").alias("k"), F.greatest(_day_number(F.col("er")), F.col("first")).alias("b"), F.col("end").alias("g"), "first").agg(F.count(F.lit(1)).alias("n"))
    rm = _differences(rm, _bucket_intervals("r", _removal_bounds(F.col("k"), F.col("first")), rising=False), F.col("n"))

    # -- running sums of the differences along the calendar
    days = cal.select(_span(F.col("d0"), F.col("d_max")).alias("day")).withColumn("d", _day_number(F.col("day")))
    sums = ["existing", "sum_e", "removed_files", "sum_r"] + [f"{p}{i}" for p in "er" for i in range(1, 11)]
    daily = days.join(ex.withColumnRenamed("all_e", "existing"), "d", "left").join(rm.withColumnRenamed("all_r", "removed_files"), "d", "left")
    daily = daily.select("day", "d", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(f"__{c}") for c in sums])
    daily = scan_in_buckets(daily, [], ["d"], {c: ("sum", f"__{c}") for c in sums}, F.floor(F.col("d") / 366))
    daily = daily.select(
        "day", *[F.col(c) for c in sums[4:]], F.col("existing").alias("files_in_existence"), F.col("removed_files").alias("files_in_removed"),
        ((F.col("d") + 1) * F.col("existing") - F.col("sum_e")).alias("__age_sum"), F.col("sum_r").alias("__rage_sum"),
    )

    # -- "today" counts: one group per day
    adds = f.where(F.col("has_add") & (F.col("e") == F.col("k")))
    if not corrected:
        adds = adds.where(F.col("live"))
    made = adds.groupBy(F.col("e").alias("day")).agg(F.count(F.lit(1)).alias("files_created_today"))
    gone = (
        f.where(~F.col("live") & (F.col("er") == F.col("kr")))
        .groupBy(F.col("er").alias("day"))
        .agg(F.count(F.lit(1)).alias("files_removed_today"))
    )

    out = daily.join(made, "day", "left").join(gone, "day", "left")
    counts = ["files_created_today", "files_removed_today", "files_in_existence", "files_in_removed"] + [
        f"{p}{i}" for p in "er" for i in range(1, 11)
    ]
    out = out.fillna(0, counts)
    avg_life = F.when(F.col("files_in_existence") > 0, F.floor(F.col("__age_sum") / F.col("files_in_existence"))).otherwise(0)
    avg_rm = F.when(F.col("files_in_removed") > 0, F.floor(F.col("__rage_sum") / F.col("files_in_removed"))).otherwise(0)
    out = out.select(
        day_string("day").alias("date"),
        *[F.col(c).cast("bigint").alias(c) for c in counts[:4]],
        avg_life.cast("bigint").alias("avg_lifetime"),
        avg_rm.cast("bigint").alias("avg_removetime"),
        *[F.col(c).cast("bigint").alias(c) for c in counts[4:]],
    )
    return out.select(*P7_COLUMNS).orderBy("date")


def history_summary(files: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Files, removed files, start, last change and duration in days (+1)."""
    if bounds is None:
        bounds = file_bounds(files)
    counts = files.agg(
        F.count_if(F.col("removed").isNull()).alias("files"),
        F.count_if(F.col("removed").isNotNull()).alias("removed_files"),
    )
    bd = bounds.select(F.struct("start", "last_change")).scalar()
    start, last = bd.getField("start"), bd.getField("last_change")
    return counts.select(
        "files",
        "removed_files",
        start.alias("start"),
        last.alias("last_change"),
        (whole_days(start, last) + 1).alias("duration"),
    )
