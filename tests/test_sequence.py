"""Bucketed lead/lag and fill-forward equal the plain window, whatever the buckets."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halflife.operators.sequence import fill_forward_in_buckets, scan_in_buckets, shift_in_buckets

rows_strategy = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 40), st.one_of(st.none(), st.integers(0, 9))),
    min_size=1,
    max_size=60,
)


def _frame(spark, rows):
    data = [(k, t, i, v) for i, (k, t, v) in enumerate(rows)]
    return spark.createDataFrame(data, "k string, t int, id int, v int")


def _plain(df, direction):
    w = Window.partitionBy("k").orderBy("t", "id")
    f = F.lead if direction > 0 else F.lag
    return {(r.id): r.nv for r in df.select("id", f("v").over(w).alias("nv")).collect()}


def _plain_ff(df):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    return {r.id: r.ff for r in df.select("id", F.last("v", ignorenulls=True).over(w).alias("ff")).collect()}


@settings(max_examples=15, deadline=None)
@given(rows=rows_strategy, width=st.integers(1, 15), direction=st.sampled_from([1, -1]))
def test_shift_matches_window(spark, rows, width, direction):
    df = _frame(spark, rows)
    got = shift_in_buckets(df, ["k"], ["t", "id"], ["v"], F.floor(F.col("t") / width), direction=direction, prefix="n_")
    got = {r.id: r.n_v for r in got.collect()}
    assert got == _plain(df, direction)


@settings(max_examples=15, deadline=None)
@given(rows=rows_strategy, width=st.integers(1, 15))
def test_fill_forward_matches_window(spark, rows, width):
    df = _frame(spark, rows)
    got = fill_forward_in_buckets(df, ["k"], ["t", "id"], "v", F.floor(F.col("t") / width), out="ff")
    assert {r.id: r.ff for r in got.collect()} == _plain_ff(df)


def test_global_lag_in_buckets(spark):
    random.seed(1)
    rows = [("x", random.randint(0, 500), random.choice([None, 1, 2])) for _ in range(300)]
    df = _frame(spark, rows)
    got = shift_in_buckets(df, [], ["t", "id"], ["id"], F.floor(F.col("t") / 7), direction=-1, prefix="p_")
    w = Window.orderBy("t", "id")
    exp = {r.id: r.p for r in df.select("id", F.lag("id").over(w).alias("p")).collect()}
    assert {r.id: r.p_id for r in got.collect()} == exp


@settings(max_examples=4, deadline=None)
@given(rows=rows_strategy, width=st.integers(1, 15), coarse=st.integers(1, 4), inclusive=st.booleans(), keyed=st.booleans())
def test_scan_matches_window(spark, rows, width, coarse, inclusive, keyed):
    """Running sum, min, max and last value, with one or two levels of buckets."""
    df = _frame(spark, rows)
    keys = ["k"] if keyed else []
    fine = F.floor(F.col("t") / width)
    wanted = {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "z": ("last", "v")}
    got = {r.id: (r.s, r.lo, r.hi, r.z) for r in scan_in_buckets(df, keys, ["t", "id"], wanted, [fine, F.floor(fine / coarse)], inclusive=inclusive).collect()}
    assert got == {r.id: (r.s, r.lo, r.hi, r.z) for r in scan_in_buckets(df, keys, ["t", "id"], wanted, fine, inclusive=inclusive).collect()}
    w = Window.partitionBy(*keys).orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    plain = df.select("id", F.sum("v").over(w).alias("s"), F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"), F.last("v", ignorenulls=True).over(w).alias("z"))
    assert got == {r.id: (r.s, r.lo, r.hi, r.z) for r in plain.collect()}


def test_scan_with_null_keys_and_buckets(spark):
    df = spark.createDataFrame([(None, None, 1), (None, 2, 2), ("a", None, 3), ("a", 5, 4)], "k string, t int, v int")
    got = {r.v: r.s for r in scan_in_buckets(df, ["k"], ["t"], {"s": ("sum", "v")}, F.col("t")).collect()}
    assert got == {1: 1, 2: 3, 3: 3, 4: 7}
