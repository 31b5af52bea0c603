"""Scalar functions C1-C22 as Catalyst expressions (no Python UDFs).

Every function takes and returns ``Column`` objects, so it stays inside
whole-stage codegen and can be pushed around by the optimizer.  Timestamps are
TIMESTAMP_NTZ (zone-less wall time, as in the patch log).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_of",
    "clean_int",
    "clean_date",
    "to_day",
    "cohort_week",
    "cohort_id",
    "cohort_sort_key",
    "cohort_label",
    "micros_between",
    "clock_micros",
    "time_text",
    "days_between",
    "minutes_between",
    "whole_days",
    "lifespan_days",
    "truncate_seconds",
    "day_start",
    "day_stamp",
    "day_string",
    "NONE_TEXT",
]

MICROS_PER_DAY = 86_400_000_000
MICROS_PER_SECOND = 1_000_000

# Fixed values of the lifecycle text format: the literal written for a missing
# value, and the accepted date pattern (strptime '%Y-%m-%d %H:%M:%S').
NONE_TEXT = "None"
DATE_TEXT_PATTERN = r"^(\d{4})-(\d{1,2})-(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})$"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_int(c) -> Column:
    """Null -> 0; trimmed text of digits only -> its value; anything else -> -1."""
    c = col_of(c)
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return (
        F.when(c.isNull(), F.lit(0))
        .when(t.rlike(r"^[0-9]+$"), F.coalesce(t.try_cast("int"), F.lit(-1)))
        .otherwise(F.lit(-1))
        .cast("int")
    )


def clean_date(c) -> Column:
    """C2: 'yyyy-M-d H:m:s' text -> TIMESTAMP_NTZ; null, 'None' or unparsable -> null."""
    c = col_of(c)
    parts = [F.regexp_extract(c, DATE_TEXT_PATTERN, i).try_cast("int") for i in range(1, 7)]
    return F.when(c.rlike(DATE_TEXT_PATTERN), F.try_make_timestamp_ntz(*parts))


def to_day(c) -> Column:
    """Timestamp -> DATE."""
    return F.to_date(col_of(c))


def cohort_week(c) -> Column:
    """strftime('%W'): Monday-based week of the year, days before the first Monday are 0."""
    d = F.to_date(col_of(c))
    return F.floor((F.dayofyear(d) + F.lit(6) - F.weekday(d)) / 7).cast("int")


def cohort_id(c) -> Column:
    """C4: date -> int yyWW (two-digit year, %W week); null -> -1."""
    d = F.to_date(col_of(c))
    return F.coalesce((F.year(d) % 100) * 100 + cohort_week(d), F.lit(-1)).cast("int")


def cohort_sort_key(c) -> Column:
    """Full-year week key year*100 + %W (orders 1999 before 2000); null -> -1."""
    d = F.to_date(col_of(c))
    return F.coalesce(F.year(d) * 100 + cohort_week(d), F.lit(-1)).cast("int")


def cohort_label(c) -> Column:
    """Date -> 'WW_yy'; null -> '1'."""
    d = F.to_date(col_of(c))
    label = F.concat_ws(
        "_",
        F.lpad(cohort_week(d).cast("string"), 2, "0"),
        F.lpad((F.year(d) % 100).cast("string"), 2, "0"),
    )
    return F.when(d.isNull(), F.lit("1")).otherwise(label)


def micros_between(start, end) -> Column:
    """end - start in microseconds, by the calendar and the clock: no session zone takes part.

    Zone-less timestamps differ by a day-time interval; its fields are plain divisions of a
    number, so both operands are read once.
    """
    span = col_of(end).cast("timestamp_ntz") - col_of(start).cast("timestamp_ntz")
    field = lambda name: F.extract(F.lit(name), span)
    minutes = (field("DAY").cast("bigint") * 24 + field("HOUR")) * 60 + field("MINUTE")
    return minutes * (60 * MICROS_PER_SECOND) + (field("SECOND") * MICROS_PER_SECOND).cast("bigint")


def clock_micros(c) -> Column:
    """Microseconds since midnight on the value's own clock."""
    c = col_of(c).cast("timestamp_ntz")
    return micros_between(c.cast("date").cast("timestamp_ntz"), c)


def time_text(c) -> Column:
    """'yyyy-MM-dd HH:mm:ss' as the value's own clock shows it (a cast, so no zone)."""
    return F.substring(col_of(c).cast("string"), 1, 19)


def whole_days(start, end) -> Column:
    """Python ``(end - start).days``: floor of the difference in days."""
    micros = micros_between(start, end)
    day = F.lit(MICROS_PER_DAY)
    return F.call_function("div", micros - F.pmod(micros, day), day).cast("int")


def days_between(start, end) -> Column:
    """Days of start - end, floored; start null -> -1, end null -> -2."""
    start, end = col_of(start), col_of(end)
    return (
        F.when(start.isNull(), F.lit(-1))
        .when(end.isNull(), F.lit(-2))
        .otherwise(whole_days(end, start))
        .cast("int")
    )


def minutes_between(start, end) -> Column:
    """Minutes of the within-day part of start - end (timedelta.seconds // 60).

    Null when either side is null or both are equal.  Whole days are dropped,
    so 2 days 2 minutes -> 2.
    """
    start, end = col_of(start), col_of(end)
    secs = F.floor(micros_between(end, start) / F.lit(MICROS_PER_SECOND))
    return F.when(start != end, F.floor(F.pmod(secs, F.lit(86_400)) / 60).cast("int"))


def lifespan_days(created, removed, last_day) -> Column:
    """Whole days alive, open items measured to ``last_day``; floored at -1.

    -1 is what C1 makes of a negative day count after the text round trip.
    """
    end = F.coalesce(col_of(removed), col_of(last_day))
    return F.greatest(whole_days(created, end), F.lit(-1)).cast("int")


def truncate_seconds(c) -> Column:
    """Drop the sub-second part of a TIMESTAMP_NTZ, keeping the NTZ type."""
    c = col_of(c)
    return F.try_make_timestamp_ntz(
        F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c), F.second(c)
    )


def day_start(c) -> Column:
    """Midnight of the day, as TIMESTAMP_NTZ."""
    d = F.to_date(col_of(c))
    return F.make_timestamp_ntz(F.year(d), F.month(d), F.dayofmonth(d), F.lit(0), F.lit(0), F.lit(0))


def day_stamp(c, hour=23, minute=59, second=59) -> Column:
    """The day of ``c`` at a fixed clock time (e.g. 23:59:59 or 01:00:00)."""
    d = F.to_date(col_of(c))
    return F.make_timestamp_ntz(
        F.year(d), F.month(d), F.dayofmonth(d), F.lit(hour), F.lit(minute), F.lit(second)
    )


def day_string(c) -> Column:
    """C22: '%Y-%m-%d' rendering."""
    return F.to_date(col_of(c)).cast("string")
