"""Day states and person bitmaps give what the lines give, at any split of the input."""

import datetime as dt
import random
import uuid

import pytest
from fixtures import LIFECYCLE_SCHEMA, lifecycle, rows
from pyspark.sql import functions as F

from halflife import plans as P
from halflife.session import ensure_checkpoint_dir

JAVA = {"java": "%.java"}


def _path(spark):
    return f"{ensure_checkpoint_dir(spark)}/summary-{uuid.uuid4().hex}"


def _random_lines(spark, seed, n=300):
    rng = random.Random(seed)
    people = [None, "ann", "bob", "cat", "dan", "eve"]
    out = []
    for _ in range(n):
        created = None if rng.random() < 0.05 else dt.datetime(2018, 12, 20) + dt.timedelta(minutes=rng.randrange(60 * 24 * 40))
        removed = (created or dt.datetime(2018, 12, 25)) + dt.timedelta(minutes=rng.randrange(60 * 24 * 40)) if rng.random() < 0.5 else None
        span = None if rng.random() < 0.1 else rng.randrange(-1, 60)
        path = rng.choice(["a.java", "b.py", None, "c.java"])
        out.append((path, rng.choice(people), rng.choice(people) if removed else None, created, removed, span))
    return spark.createDataFrame(out, LIFECYCLE_SCHEMA)


def _same(lines, s):
    for corrected in (False, True):
        assert rows(s.cohort_decay(corrected)) == rows(P.cohort_decay(lines, corrected))
        assert rows(s.weekly_decay(corrected)) == rows(P.weekly_decay(lines, corrected))
        assert rows(s.active_lines(corrected)) == rows(P.active_lines(lines, corrected))
        assert rows(s.active_people(corrected)) == rows(P.active_people(lines, corrected))
        assert rows(s.author_change_rates(corrected)) == rows(P.author_change_rates(lines, corrected))
    day = "2019-06-01"
    assert rows(s.author_decay(as_of=day)) == rows(P.author_decay(lines, as_of=day))
    assert rows(s.author_decay("java", ["bob"], day)) == rows(P.author_decay(lines, "%.java", ["bob"], day))


def test_reports_from_the_summary(spark):
    lines = lifecycle(spark)
    _same(lines, P.write_summary(lines, _path(spark), JAVA))


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_parts(spark, seed):
    lines = _random_lines(spark, seed).cache()
    part = F.pmod(F.xxhash64(*lines.columns), F.lit(3))
    parts = [P.write_summary(lines.where(part == i), _path(spark), JAVA) for i in range(3)]
    _same(lines, P.merge_summaries(*parts))


def test_empty_and_unknown_class(spark):
    empty = spark.createDataFrame([], LIFECYCLE_SCHEMA)
    s = P.write_summary(empty, _path(spark), JAVA)
    assert rows(s.cohort_decay()) == [] and rows(s.author_decay("java")) == []
    with pytest.raises(ValueError):
        s.author_decay("py")
    with pytest.raises(ValueError):
        P.merge_summaries(s, P.write_summary(empty, _path(spark)))


def test_one_scan_of_the_lines(spark):
    """The lines are read once for both tables: a column counted while it is written is seen once per row."""
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    lines = _random_lines(spark, 3)
    P.write_summary(lines.mapInArrow(touch, LIFECYCLE_SCHEMA), _path(spark), JAVA)
    assert seen.value == 300


@pytest.mark.parametrize("parts", [1, 5])
def test_bitmaps_at_any_split(spark, parts):
    lines = _random_lines(spark, 4).cache()
    part = F.pmod(F.xxhash64(*lines.columns), F.lit(parts))
    numbers, maps = None, []
    for i in range(parts):  # parts arrive one after the other, later persons get later numbers
        weeks = P.people_weeks(lines.where(part == i))
        numbers = P.number_people(weeks, numbers, parts=3).cache()
        maps.append(P.week_bitmaps(weeks, numbers))
    got = [r["number"] for r in numbers.orderBy("number").collect()]
    assert got == list(range(1, len(got) + 1))
    merged = P.merge_bitmaps(*maps)
    weekly = P.distinct_people(merged, (F.floor(F.col("week") / 100) % 100 * 100 + F.col("week") % 100).cast("int"), "week")
    assert rows(weekly) == rows(P.active_people(lines, corrected=True))
    pairs = {(r["week"] // 100, r["person"]) for r in P.people_weeks(lines).collect()}
    years = sorted({y for y, _ in pairs})
    yearly = P.distinct_people(merged, F.floor(F.col("week") / 100).cast("int"), "year")
    assert rows(yearly) == [(y, sum(1 for a, _ in pairs if a == y)) for y in years]
