"""C1-C7 against the hand-worked values of FIXTURES.md §2.1."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from halflife.functions import scalars as S

T = dt.datetime
D = dt.date


def _one(spark, expr, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr.alias("x")).collect()]


def test_clean_int(spark):
    cases = [(None, 0), (" 12 ", 12), ("7", 7), ("", -1), ("-3", -1), ("1.5", -1), ("x", -1), ("\t5\n", 5)]
    got = _one(spark, S.clean_int("s"), [(c,) for c, _ in cases], "s string")
    assert got == [e for _, e in cases]


def test_clean_date(spark):
    cases = [
        ("2018-09-14 00:00:00", T(2018, 9, 14)),
        ("2018-9-4 1:2:3", T(2018, 9, 4, 1, 2, 3)),
        ("None", None), (None, None), ("2018-09-14", None), ("2018-09-14 00:00:00.123", None),
        ("2018-02-30 00:00:00", None), (" 2018-09-14 00:00:00", None), ("18-09-14 00:00:00", None),
    ]
    got = _one(spark, S.clean_date("s"), [(c,) for c, _ in cases], "s string")
    assert got == [e for _, e in cases]


@pytest.mark.parametrize(
    "day,cid,label",
    [(D(2018, 9, 14), 1837, "37_18"), (D(2018, 9, 16), 1837, None), (D(2018, 9, 17), 1838, None),
     (D(2018, 1, 1), 1801, None), (D(2020, 1, 1), 2000, "00_20"), (D(2005, 1, 1), 500, None),
     (D(2000, 1, 3), 1, None), (D(1999, 12, 31), 9952, None), (None, -1, "1")],
)
def test_cohort_id_and_label(spark, day, cid, label):
    df = spark.createDataFrame([(day,)], "d date")
    r = df.select(S.cohort_id("d"), S.cohort_label("d")).first()
    assert r[0] == cid
    if label is not None:
        assert r[1] == label


def test_cohort_id_matches_strftime(spark):
    days = [D(1990, 1, 1) + dt.timedelta(days=i) for i in range(0, 16801, 7)] + [D(2024, 12, 30), D(2023, 1, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [r[0] for r in df.select(S.cohort_id("d")).collect()]
    assert got == [int(d.strftime("%y%W")) for d in days]


def test_minutes_between(spark):
    a = T(2018, 9, 10, 9)
    cases = [(a, a, None), (None, a, None), (a, None, None), (a + dt.timedelta(minutes=2, seconds=30), a, 2),
             (a + dt.timedelta(days=2, minutes=2), a, 2), (a + dt.timedelta(days=1), a, 0),
             (a + dt.timedelta(seconds=59), a, 0)]
    got = _one(spark, S.minutes_between("s", "e"), [(s, e) for s, e, _ in cases], "s timestamp_ntz, e timestamp_ntz")
    assert got == [x for _, _, x in cases]


def test_days_between(spark):
    cases = [(None, T(2018, 9, 10), -1), (T(2018, 9, 10), None, -2),
             (T(2018, 9, 13, 10), T(2018, 9, 10, 9), 3), (T(2018, 9, 10, 9), T(2018, 9, 13, 10), -4)]
    got = _one(spark, S.days_between("s", "e"), [(s, e) for s, e, _ in cases], "s timestamp_ntz, e timestamp_ntz")
    assert got == [x for _, _, x in cases]


def test_truncate_and_stamps(spark):
    df = spark.createDataFrame([(T(2020, 1, 2, 3, 4, 5, 678),)], "t timestamp_ntz")
    r = df.select(S.truncate_seconds("t"), S.day_stamp("t"), S.day_stamp("t", 1, 0, 0), S.day_string("t")).first()
    assert tuple(r) == (T(2020, 1, 2, 3, 4, 5), T(2020, 1, 2, 23, 59, 59), T(2020, 1, 2, 1), "2020-01-02")
    assert dict(df.select(S.truncate_seconds("t").alias("x")).dtypes)["x"] == "timestamp_ntz"
