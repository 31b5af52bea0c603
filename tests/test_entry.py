"""Driver contract: entry() smoke run and every query against its DuckDB oracle at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, canon, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["create_cohort", "remove_cohort", "lifespan"]
    assert df.count() > 0


def test_every_report_has_an_oracle():
    assert set(E._report_oracles()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(E._report_oracles()))
def test_query_matches_oracle(spark, duck, name):
    got = canon(*spark_rows(E.queries()[name](spark, SF)))
    exp = canon(*duck_rows(duck, E.oracle_sql()[name]))
    assert got[0] == exp[0]
    assert got[1] == exp[1]


@pytest.mark.parametrize("name", ["clean_date", "gap_minutes", "file_population", "line_lifecycle"])
def test_results_do_not_depend_on_session_zone(spark, duck, name):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = canon(*spark_rows(E.queries()[name](spark, SF)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == canon(*duck_rows(duck, E.oracle_sql()[name]))


def test_events_life_with_tiny_slices_matches_plain_lead(spark, duck):
    """Every slot spread over many time slices: same rows as the unsliced window."""
    from halflife.sources import bindings as B

    got = canon(*spark_rows(B.events_life(spark, SF, slice_rows=40, staged=False)))
    exp = canon(*duck_rows(duck, E.oracle_sql()["line_lifecycle"]))
    assert got == exp
