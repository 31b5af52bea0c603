"""Identity in slices of the log, and the replay as a stream of files, against the history simulator and the oracles."""

import glob

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from gitsim import Sim
from halflife import session
from halflife.operators import ingest as I
from halflife.sources.patch_log import read_log_records
from test_cluster import ROWS
from test_ingest import _rows, _written


@pytest.mark.parametrize("events", [1, 7, 40])
def test_identity_in_slices(spark, monkeypatch, events):
    """Slices of few events, each (but for the last size) one ordering bucket: files are those of one slice."""
    sim = Sim(3).run(150)
    diffs = I.parse_log(read_log_records(spark, _written(sim.log_text()))).withColumn("seq_bucket", F.col("seq"))
    seen = lambda df: sorted(str(tuple(r)) for r in df.collect())
    cols = ["seq", "dpos", "ev", "file_id"]
    one = [seen(df.select(c)) for df, c in zip(I.file_identity(diffs), (cols, ["file_id", "path", "added", "removed"]))]
    monkeypatch.setattr(I, "SLICE_EVENTS", events)
    assert I._sliced(I.path_events(diffs))[1]
    assert [seen(df.select(c)) for df, c in zip(I.file_identity(diffs), (cols, ["file_id", "path", "added", "removed"]))] == one
    assert sorted(tuple(r) for r in I.file_identity(diffs)[1].select("path", "added", "removed").collect()) == sim.files_truth()


@pytest.mark.parametrize("split_above", [3, 12, 200_000])
def test_hot_and_other_files(spark, split_above):
    sim = Sim(4).run(120)
    records = read_log_records(spark, _written(sim.log_text()))
    exp = [tuple("" if v is None else v for v in (p, f"{c}@example.org", r and f"{r}@example.org", a, b, life)) for p, c, r, a, b, life in sim.truth(True)]
    assert _rows(I.line_lifecycle(records, include_removed_files=True, split_above=split_above)) == sorted(exp)


def test_flushed_files(spark, monkeypatch):
    """Rows that go out in the middle of a file, and diffs that are forgotten between files."""
    from halflife.operators import replay as R

    monkeypatch.setattr(R, "FLUSH_ROWS", 3)
    diffs = I.parse_log(read_log_records(spark, _written(Sim(2).run(80).log_text())))
    diff_files, files = I.file_identity(diffs)
    rows = diff_files.withColumn("closes", F.col("ev") == "D")
    want = sorted(str(tuple(r)) for r in R.replay_diffs(rows, files, 1).collect())  # workers have the usual size
    stream = rows.select("file_id", "seq", "dpos", "author", "committed", F.col("hunk_ops.start").alias("starts"), F.col("hunk_ops.ops").alias("ops"), "closes").orderBy("file_id", "seq", "dpos").toArrow()
    named = {r["file_id"]: r for r in files.collect()}
    import pyarrow as pa

    batches, kind = [], pa.schema([("file_id", pa.string()), ("path", pa.string()), ("author", pa.string()), ("committed", pa.timestamp("us")), ("starts", pa.list_(pa.int32())), ("ops", pa.list_(pa.string())), ("closes", pa.bool_())])
    for name in sorted(named):
        head = {"file_id": name, "path": named[name]["path"], "author": None, "committed": named[name]["removed"], "starts": None, "ops": None, "closes": None}
        batches += pa.Table.from_pylist([head, *({**r, "path": None} for r in stream.to_pylist() if r["file_id"] == name)], schema=kind).to_batches()
    got = [r for b in R._replay_files(iter(batches)) for r in b.to_pylist()]
    assert sorted(str(tuple(r.values())) for r in got) == want and len(want) > 100


QUERIES = ["file_identity_parts", "file_population_parts", "line_lifecycle_parts", "line_lifecycle_parts_all", "author_rates_parts", "replay_errors"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    for name in ("part", "orders"):
        duckdb.execute(f"COPY ({ROWS[name]}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    duckdb.execute(f"COPY ({ROWS['lineitem'].replace('range(120)', 'range(1500)')}) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_parts_queries_equal_their_oracles(spark, tables, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    df = E.queries()[name](spark, tables)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({E.oracle_sql()[name]})").fetchall()
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(map(str, want))


def test_what_the_parts_queries_leave_on_disk(spark, tables):
    """No row per hunk, no second table of the diffs, and what is written is packed."""
    session.release_staged(spark)
    E.queries()["line_lifecycle_parts_all"](spark, tables).count()
    app = spark.sparkContext.applicationId
    left = {slot[1]: path for slot, path in session._STAGED.items() if slot[0] == app} | {x[1]: x[2] for x in session._UNKEYED if x[0] == app}
    assert not {"replay-hunks", "diff-files", "log-records", "path_events", "path_segments", "segments", "links", "part-steps"} & {*left}
    for name in ("diffs", "path-segments", "roots", "files", "replay"):
        part = next(f for f in glob.glob(f"{left[name].removeprefix('file:')}/*.parquet") if pq.ParquetFile(f).num_row_groups)
        assert pq.ParquetFile(part).metadata.row_group(0).column(0).compression == "ZSTD"
