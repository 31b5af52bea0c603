"""Queries of F2 to F23 on a master that is not local, with a checkpoint dir that all machines mount (file:)."""

import duckdb
import pytest

import __spark_entry__ as E

ROWS = {
    "supplier": "SELECT i::BIGINT AS s_suppkey, (i % 25)::INTEGER AS s_nationkey FROM range(20) t(i)",
    "part": "SELECT i::BIGINT AS p_partkey, 'part ' || i AS p_name, (i % 7)::INTEGER AS p_size FROM range(10) t(i)",
    "orders": "SELECT i::BIGINT AS o_orderkey, (i * 7 % 30)::BIGINT AS o_custkey, TIMESTAMP '1997-01-01' + to_days((i * 11 % 300)::INTEGER) AS o_orderdate FROM range(40) t(i)",
    "lineitem": """SELECT (i % 40)::BIGINT AS l_orderkey, (i % 10)::BIGINT AS l_partkey, (i % 20)::BIGINT AS l_suppkey, (i // 40 + 1)::INTEGER AS l_linenumber,
        (1 + i % 5)::DOUBLE AS l_quantity, CASE WHEN i % 3 = 0 THEN 'O' ELSE 'F' END AS l_linestatus, 'N' AS l_returnflag,
        TIMESTAMP '1997-01-01' + to_days((i % 40 * 11 % 300 + 5 + i % 90)::INTEGER) AS l_shipdate FROM range(120) t(i)""",
    "events": """SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_minutes((i * 97)::BIGINT) AS ts, (i % 9)::BIGINT AS user_id,
        ['click', 'view', 'error'][i % 3 + 1] AS event_type, 1.5::DOUBLE AS value, '{"k": ' || (i % 4) || '}' AS props FROM range(120) t(i)""",
}
FAILED = """active_lines_stream active_lines_corrected active_people active_lines_summary active_people_bitmaps active_people_summary
active_people_corrected active_people_years alias_csv alias_resolution author_decay author_decay_summary author_decay_excluded author_decay_today
author_rates author_rates_corrected author_rates_parts author_rates_log author_rates_summary clean_date author_roster clean_int""".split()


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    for name, rows in ROWS.items():
        duckdb.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", FAILED)
def test_runs_with_a_mounted_checkpoint_dir_on_a_cluster(spark, tables, monkeypatch, name):
    assert spark.sparkContext.getCheckpointDir().startswith("file:")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    assert E.queries()[name](spark, tables).count() > 0
