"""P1-P8 on the lifecycle table of FIXTURES.md §2.2, both modes."""

import random
import pytest

import datetime as dt

from fixtures import files, lifecycle, rows
from halflife import plans as P

D = dt.date

P1_REFERENCE = [
    (-1, 1840, 0, None, 1, 1, 1, 100.0, 100.0, 0.0),
    (1837, 1837, 3, 2.0, 5, 2, 2, 40.0, 40.0, -17027.520792),
    (1837, 1838, 8, 2.0, 5, 1, 3, 20.0, 60.0, -11453.634148),
    (1837, -1, 23, 2.0, 5, 2, 5, 40.0, 100.0, -11453.634148),
    (1838, 1839, 8, 1378.0, 2, 1, 1, 50.0, 50.0, -8664.339757),
    (1838, -1, 16, 1378.0, 2, 1, 2, 50.0, 100.0, -8664.339757),
    (1840, -1, 2, 15.0, 2, 2, 2, 100.0, 100.0, -8664.339757),
]


def test_cohort_decay(spark):
    lc = lifecycle(spark)
    assert rows(P.cohort_decay(lc)) == P1_REFERENCE
    assert rows(P.cohort_decay(lc, corrected=True)) == [
        (1837, 1837, 3, 2.0, 5, 2, 2, 40.0, 40.0, -17027.520792),
        (1837, 1838, 8, 2.0, 5, 1, 3, 20.0, 60.0, -11453.634148),
        (1838, 1839, 8, 1378.0, 2, 1, 1, 50.0, 50.0, -8664.339757),
    ]


def test_weekly_decay(spark):
    lc = lifecycle(spark)
    assert rows(P.weekly_decay(lc)) == [(0.0, -1), (-11453.634148, 1837), (-8664.339757, 1838)]
    assert rows(P.weekly_decay(lc, corrected=True)) == [(-11453.634148, 1837), (-8664.339757, 1838), (None, 1840)]


def test_active_lines(spark):
    lc = lifecycle(spark)
    assert rows(P.active_lines(lc)) == [(1837, 5, 5, 2, 2, 3), (1838, 2, 7, 1, 3, 4), (1840, 2, 9, 1, 5, 4)]
    assert rows(P.active_lines(lc, corrected=True)) == [
        (1837, 5, 5, 2, 2, 3), (1838, 2, 7, 1, 3, 4), (1839, 0, 7, 1, 4, 3), (1840, 2, 9, 1, 5, 4)]


def test_active_people(spark):
    lc = lifecycle(spark)
    assert rows(P.active_people(lc)) == [(-1, 1), (1837, 2), (1838, 1), (1840, 2)]
    assert rows(P.active_people(lc, corrected=True)) == [(1837, 2), (1838, 2), (1839, 1), (1840, 2)]


def test_author_decay(spark):
    got = rows(P.author_decay(lifecycle(spark), path_like="%.java", as_of="2018-11-01"))
    assert got == [
        ("ann", 4, 2, D(2018, 9, 10), D(2018, 10, 1), 9.0, 1, 2, 52, 21, 31, 0.5, 0.25, 0.5),
        ("bob", 2, 1, D(2018, 9, 12), D(2018, 9, 12), 10.5, 1, 1, 50, 0, 50, 0.5, 0.5, 0.25),
        ("cat", 2, 1, D(2018, 9, 17), D(2018, 9, 17), 12.0, None, 1, 45, 0, 45, 0.5, None, 0.25),
    ]
    excluded = rows(P.author_decay(lifecycle(spark), path_like="%.java", exclude=["bob"], as_of="2018-11-01"))
    assert [r[0] for r in excluded] == ["ann", "cat"] and excluded[0][-1] == round(2 / 3, 6)


def test_author_change_rates(spark):
    lc = lifecycle(spark)
    ref = [(D(2018, 9, 10), "ann", 1, 0), (D(2018, 9, 12), "bob", 1, 1), (D(2018, 9, 13), "bob", 0, 1),
           (D(2018, 9, 17), "cat", 1, 0), (D(2018, 9, 18), "ann", 0, 1), (D(2018, 9, 25), "ann", 0, 1),
           (D(2018, 10, 1), "ann", 1, 0), (D(2018, 10, 1), "cat", 1, 0), (D(2018, 10, 2), "cat", 0, 1)]
    assert rows(P.author_change_rates(lc)) == ref
    corrected = {(D(2018, 9, 10), "ann"): 3, (D(2018, 9, 12), "bob"): 2, (D(2018, 9, 17), "cat"): 2}
    exp = [(d, a, corrected.get((d, a), x), y) for d, a, x, y in ref]
    assert rows(P.author_change_rates(lc, corrected=True)) == exp


def _pop(*nonzero):
    out = {}
    for n in nonzero:
        out[n] = 1
    return out


def test_file_population(spark):
    got = rows(P.file_population(files(spark)))
    cols = P.files.P7_COLUMNS
    as_dicts = [dict(zip(cols, r)) for r in got]
    assert [d["date"] for d in as_dicts] == ["2019-12-31", "2020-01-01", "2020-01-02", "2020-01-03"]
    head = [tuple(d[c] for c in cols[1:7]) for d in as_dicts]
    assert head == [(0, 0, 0, 0, 0, 0), (1, 0, 1, 0, 1, 0), (0, 0, 1, 0, 2, 0), (0, 1, 2, 1, 2, 1)]
    buckets = [{c: d[c] for c in cols[7:] if d[c]} for d in as_dicts]
    assert buckets == [{}, {"e10": 1}, {"e10": 1}, {"e7": 1, "e10": 1, "r4": 1}]
    # corrected: r1 counts as existing while alive (days 01-01 and 01-02)
    cor = [dict(zip(cols, r)) for r in rows(P.file_population(files(spark), corrected=True))]
    assert [d["files_in_existence"] for d in cor] == [0, 2, 2, 2]
    assert [d["files_created_today"] for d in cor] == [0, 2, 0, 0]


def test_history_summary(spark):
    import datetime as _dt

    got = rows(P.history_summary(files(spark)))
    assert got == [(2, 1, _dt.datetime(2020, 1, 1, 12), _dt.datetime(2020, 1, 3, 6), 2)]


def test_partition_count_independence(spark):
    lc = lifecycle(spark).repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows(P.cohort_decay(lc)) == P1_REFERENCE
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("corrected", [False, True])
def test_file_population_matches_a_loop_over_days_and_files(spark, corrected):
    rng = random.Random(3)
    t0 = dt.datetime(2020, 1, 1, 15, 30)

    def at(lo, days):
        clock = rng.choice([dt.timedelta(0), dt.timedelta(hours=23, minutes=59, seconds=59), dt.timedelta(seconds=rng.randrange(86_400))])
        return dt.datetime.combine((lo + dt.timedelta(days=rng.randrange(days))).date(), dt.time()) + clock

    table = [(t0, None)]
    for _ in range(70):
        a = max(at(t0, 90), t0)
        table.append((a, rng.choice([None, max(a, at(a, 60))])))
    start, last = t0, max(x for r in table for x in r if x)
    d0 = start.date() - dt.timedelta(days=1)
    want = {}
    for i in range((last - start).days + 3):
        day = d0 + dt.timedelta(days=i)
        stamp = dt.datetime.combine(day, dt.time(23, 59, 59))
        there = [(stamp - a).days + 1 for a, r in table if a < stamp and (not (r and r < stamp) if corrected else r is None)]
        gone = [(r - start).days for a, r in table if r and r < stamp]
        share = lambda ages: [sum(min(max(x * 10 // i, 0), 9) == b if i else b == 0 for x in ages) for b in range(10)]
        mean = lambda ages: sum(ages) // len(ages) if ages else 0
        want[str(day)] = (len(there), len(gone), mean(there), mean(gone), *share(there), *share(gone))
    out = P.file_population(spark.createDataFrame(table, "added timestamp_ntz, removed timestamp_ntz"), corrected=corrected)
    got = {r["date"]: tuple(r[c] for c in out.columns[3:]) for r in out.collect()}
    assert got == want
