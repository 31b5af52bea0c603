"""The corpus pipeline stage by stage on the smallest tables, and its registered queries."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from halflife.llm import op8_bpe, registry
from tools.oracle_check import TABLES, canon, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.MODULES) == list(range(1, 14))
    assert "pipeline" in E.queries() and set(registry.oracle_sql()) <= set(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    assert canon(*spark_rows(E.queries()[name](spark, SF))) == canon(*duck_rows(duck, E.oracle_sql()[name]))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, before = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == columns and after.schema == before.schema, name
        ids = {r[0] for r in before.select("doc_id").collect()}
        after = after.checkpoint()
        assert {r[0] for r in after.select("doc_id").collect()} <= ids and after.count() > 0
        before = after
    out = corpus_pipeline.bpe(spark, before, SF).collect()
    path, pattern = op8_bpe.default_ranks()
    bpe = op8_bpe.coder(path, pattern)
    texts = {(r["doc_id"], r["text"]) for r in before.collect()}
    assert all(r["round_trip"] for r in out) and len(out) == before.count()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in out).keys() == {(i, bpe.encode_packed(t)) for i, t in texts}


def test_stages_on_awkward_rows(spark, docs, none):
    for start in (docs, none):
        for _, stage in corpus_pipeline.STAGES[1:]:
            start = stage(spark, start, SF).checkpoint()
        assert start.count() >= 0
