"""

Every query reads whole test tables (through ``halflife.sources.bindings``)
and runs a halflife operator or report on them.  Doubles are rounded to six
places on both sides, counts are BIGINT, ties are broken the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from halflife import plans as P
from halflife.functions import scalars as S
from halflife.sources import bindings as B
from halflife.operators import ingest as I
from halflife.session import release_staged
from halflife.sources.lifecycle import (
    read_lifecycle_text,
    to_lifecycle_text,
    type_lifecycle,
    write_lifecycle_parquet,
    write_lifecycle_text,
)
from halflife.sources.parts_log import render_parts_log
from halflife.plans.files import P7_COLUMNS
from halflife.sources.patch_log import events_alias_map, render_events_log, render_queue_log, stage_patch_log
from halflife.sources.reports import write_author_roster, write_report

try:  # an optional part: the library and its queries work without it
    from halflife.llm import registry as LLM
except ModuleNotFoundError as missing:
    if missing.name not in ("halflife.llm", "corpus_pipeline"):
        raise
    LLM = None

SMOKE_DIR = "/root/testdata/sf0.001"
AS_OF = "2025-01-01"
EXCLUDED = ["u7", "u13"]


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: cohort decay (P1) of the order-line lifecycle at sf0.001."""
    return _rounded(P.cohort_decay(B.orders_life(spark, SMOKE_DIR)))


# ---------------------------------------------------------------- queries


def _q_clean_int(spark, d):
    """C1 on the lifespan text the log replay writes (raw whole days, may be negative)."""
    base = B.staged_orders(spark, d)
    last_day = base.agg(
        (F.greatest(F.max("created"), F.max("removed")) + F.expr("INTERVAL 1 DAY")).alias("last_day")
    ).scalar()
    text = to_lifecycle_text(base.withColumn("__last_day", last_day), last_day_col="__last_day")
    counts = text.groupBy(F.col("lifespan").alias("lifespan_text")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("lifespan_text", S.clean_int("lifespan_text").alias("lifespan"), "n")


def _q_lifecycle_csv(spark, d):
    """S4 -> S3 -> C1/C2: the lifecycle written as text (as log replay hands it
    over), read back with an all-string schema and DROPMALFORMED, and typed."""
    import uuid

    from halflife.session import ensure_checkpoint_dir

    base = B.staged_orders(spark, d)
    last_day = base.agg(
        (F.greatest(F.max("created"), F.max("removed")) + F.expr("INTERVAL 1 DAY")).alias("last_day")
    ).scalar()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/lifecycle-text/{uuid.uuid4().hex}"
    write_lifecycle_text(to_lifecycle_text(base.withColumn("__last_day", last_day), last_day_col="__last_day"), path)
    return type_lifecycle(read_lifecycle_text(spark, path))


def _q_clean_date(spark, d):
    """C2 on the created/removed text of the event lifecycle ('None' for open lines)."""
    text = to_lifecycle_text(B.events_life(spark, d))
    stamps = text.select(F.explode(F.array("created", "removed")).alias("text"))
    counts = stamps.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("text", S.clean_date("text").alias("parsed"), "n")


def _q_cohort_ids(spark, d):
    life = B.staged_orders(spark, d)
    days = life.select(F.explode(F.array(S.to_day("created"), S.to_day("removed"))).alias("day"))
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("n")).select(
        "day",
        S.cohort_id("day").alias("cohort_id"),
        S.cohort_label("day").alias("cohort_label"),
        S.cohort_sort_key("day").alias("week_key"),
        "n",
    )


def _q_gap_minutes(spark, d):
    return P.creation_gaps(B.events_life(spark, d))


def _q_days_between(spark, d):
    life = B.events_life(spark, d)
    return life.groupBy(S.days_between("removed", "created").alias("days")).agg(F.count(F.lit(1)).alias("n"))


def _q_cohort_pairs(spark, d):
    return P.cohort_pairs(B.orders_life(spark, d))


def _report(fn, binding, **kw):
    def run(spark, d):
        return _rounded(fn(binding(spark, d), **kw))

    return run


def _q_file_population(corrected):
    def run(spark, d):
        return P.file_population(B.parts_files(spark, d), corrected=corrected)

    return run


def _q_history_summary(spark, d):
    return P.history_summary(B.parts_files(spark, d))


def _events_log(spark, d):
    """The events table rendered as a patch log, written once per application
    and read back (S1): the log file every ingest query starts from."""
    return stage_patch_log(lambda: render_events_log(spark, d), key=_events_key(spark, d), spark=spark)


def _events_key(spark, d):
    return ("events", *B.tables_key(spark, d, ("events",)))


def _events_aliased(spark, d, **options):
    """Log -> roster -> alias map -> replayed lines; log, parse and replay are written once."""
    log = _events_log(spark, d)
    alias = events_alias_map(I.author_roster(I.commits(log)))
    return I.line_lifecycle(log, alias, key=("aliased", *_events_key(spark, d)), **options)


def _events_diffs(spark, d):
    return I.parse_log(_events_log(spark, d), key=_events_key(spark, d))


def _q_line_lifecycle(spark, d):
    """Log -> roster -> alias map -> replayed line lifecycle."""
    return _events_aliased(spark, d)


def _q_patch_hunks(spark, d):
    return _hunk_rows(_events_diffs(spark, d))


def _hunk_rows(diffs):
    return I.hunks(diffs).select("new_path", "author", "committed", "kind", "start", "lines_added", "lines_removed")


def _q_file_identity(spark, d):
    _, files = I.file_identity(_events_diffs(spark, d), _events_key(spark, d))
    return files.select("path", "added", "removed")


def _q_author_roster(spark, d):
    return I.author_roster(I.commits(_events_log(spark, d)))


def _q_alias_resolution(spark, d):
    cm = I.commits(_events_log(spark, d))
    resolved = I.resolve_aliases(cm, events_alias_map(I.author_roster(cm)))
    return resolved.groupBy("author").agg(F.count(F.lit(1)).alias("commits"))


def _q_history_summary_log(spark, d):
    diffs = _events_diffs(spark, d)
    _, files = I.file_identity(diffs, _events_key(spark, d))
    return P.history_summary(files, I.history_bounds(diffs, files))


def _q_author_rates_log(spark, d):
    """P6 on the replayed lines of the log, lines of removed files included."""
    return P.author_change_rates(_events_aliased(spark, d, include_removed_files=True))


def _q_file_population_log(spark, d):
    """P7 on the files of the log, bounded by its first add and last change."""
    diffs = _events_diffs(spark, d)
    _, files = I.file_identity(diffs, _events_key(spark, d))
    return P.file_population(files, I.history_bounds(diffs, files))


# The parts log: files of several lines, hunks with context, renames, deletes, re-creates, quoted paths.


def _parts_key(spark, d, faulty=False):
    return ("parts", faulty, *B.tables_key(spark, d, B.ORDER_TABLES))


def _parts_log(spark, d, faulty=False):
    log = stage_patch_log(lambda: render_parts_log(spark, d, faulty), key=_parts_key(spark, d, faulty), ordered=True, spark=spark)
    release_staged(spark, "part-steps")
    return log


def _parts_diffs(spark, d, faulty=False):
    return I.parse_log(_parts_log(spark, d, faulty), key=_parts_key(spark, d, faulty))


def _parts_lines(spark, d, **options):
    return I.lifecycle_of(_parts_diffs(spark, d), key=_parts_key(spark, d), **options)


def _q_patch_hunks_parts(spark, d):
    return _hunk_rows(_parts_diffs(spark, d))


def _q_file_identity_parts(spark, d):
    _, files = I.file_identity(_parts_diffs(spark, d), _parts_key(spark, d))
    return files.select("path", "added", "removed")


def _q_line_lifecycle_parts(spark, d):
    return _parts_lines(spark, d)


def _q_line_lifecycle_parts_all(spark, d):
    return _parts_lines(spark, d, include_removed_files=True)


def _q_author_rates_parts(spark, d):
    return P.author_change_rates(_parts_lines(spark, d, include_removed_files=True))


def _q_file_population_parts(spark, d):
    diffs = _parts_diffs(spark, d)
    _, files = I.file_identity(diffs, _parts_key(spark, d))
    return P.file_population(files, I.history_bounds(diffs, files))


def _q_line_lifecycle_hot(spark, d):
    """I9 on a log with over half of its hunks in one file, replayed in segments, and a file per commit."""
    key = ("queue", *B.tables_key(spark, d, ("events",)))
    log = stage_patch_log(lambda: render_queue_log(spark, d), key=key, spark=spark)
    return I.line_lifecycle(log, key=key, split_above=2_000)


def _q_replay_errors(spark, d):
    """Mismatches of a log with known faults, by file (Q5)."""
    errors = I.ingest_errors(_parts_diffs(spark, d, faulty=True), key=_parts_key(spark, d, faulty=True))
    return errors.select("kind", "path", "n")


# Sinks: written below the shared folder and read back.


def _scratch(spark, name):
    import uuid

    from halflife.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


def _q_alias_csv(spark, d):
    """The edited alias file - blanks around values, a later line wins - read and applied to the suppliers."""
    path = _scratch(spark, "alias-csv")
    s = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_nationkey")
    line = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(", "), F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(" "))
    earlier = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(",old"))
    lines = F.when(F.col("s_suppkey") % 2 == 0, F.array(earlier, line)).otherwise(F.array(line))
    s.where("s_suppkey % 5 <> 0").select(F.posexplode(lines).alias("pos", "value"), "s_suppkey").sort("s_suppkey", "pos").select("value").write.text(path)
    people = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("author"))
    return I.resolve_aliases(people, I.read_alias_map(spark, path)).groupBy("author").agg(F.count(F.lit(1)).alias("n"))


def _q_report_sink(spark, d):
    """The weekly report as one sorted CSV file with a header, read back."""
    path = _scratch(spark, "report")
    write_report(P.active_lines(B.orders_life(spark, d)), path, order_by=["week"], single_file=True)
    return spark.read.csv(path, header=True, schema="week int, lines_created long, running_created long, lines_removed long, running_removed long, active_lines long")


def _q_daily_sink(spark, d):
    """The daily change rates as CSV, read back."""
    path = _scratch(spark, "daily")
    write_report(P.author_change_rates(B.events_life(spark, d)), path, order_by=["date", "author"])
    return spark.read.csv(path, header=True, schema="date date, author string, lines_added long, lines_removed long")


def _q_population_sink(spark, d):
    """The daily file population, all 27 columns, as CSV, read back."""
    path = _scratch(spark, "population")
    write_report(P.file_population(B.parts_files(spark, d)), path, order_by=["date"])
    schema = ", ".join(f"{c} {'string' if c == 'date' else 'long'}" for c in P7_COLUMNS)
    return spark.read.csv(path, header=True, schema=schema)


def _q_roster_sink(spark, d):
    """The roster as the template of an alias file, read back as one."""
    path = _scratch(spark, "roster")
    write_author_roster(I.author_roster(I.commits(_events_log(spark, d))), path, single_file=True)
    return I.read_alias_map(spark, path)


def _q_lifecycle_parquet(spark, d):
    """The typed hand-over table."""
    path = _scratch(spark, "lifecycle")
    write_lifecycle_parquet(B.events_life(spark, d), path)
    return spark.read.parquet(path)


def _q_author_decay_today(spark, d):
    """Ages against the current date."""
    return _rounded(P.author_decay(B.orders_life(spark, d), path_like="%.java"))


def _q_day_stamps(spark, d):
    """First instant and two fixed clock times of the days of the event lifecycle."""
    days = B.events_life(spark, d).groupBy(S.to_day("created").alias("day")).agg(F.max("created").alias("last"), F.count(F.lit(1)).alias("n"))
    return days.select("day", S.day_start("last").alias("day_start"), S.day_stamp("last").alias("day_end"), S.day_stamp("last", 1, 0, 0).alias("day_one"), "n")


def _q_active_lines_stream(spark, d):
    """Streaming P3 (corrected): the order-line lifecycle as line-event files,
    consumed by the streaming job (availableNow) in two arrivals; returns its
    final snapshot."""
    import uuid

    from halflife.session import ensure_checkpoint_dir
    from halflife.streaming import LINE_EVENT_SCHEMA, start_weekly_activity, to_line_events

    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    life = B.orders_life(spark, d)
    events = to_line_events(life)
    cut = life.agg(F.percentile_approx("created", 0.5)).scalar()
    for part in (events.where(F.col("at") < cut), events.where(F.col("at") >= cut)):
        part.write.mode("append").parquet(f"{root}/src")
        stream = spark.readStream.schema(LINE_EVENT_SCHEMA).parquet(f"{root}/src")
        for q in start_weekly_activity(stream, f"{root}/out", f"{root}/ckpt"):
            q.awaitTermination()
    return spark.read.parquet(f"{root}/out/active_lines")


def _orders_summary(spark, d):
    """Day states and creation times of all order lines, written once per state of the tables."""
    import uuid

    from halflife.session import ensure_checkpoint_dir, remember_staged, staged_path

    key = B.tables_key(spark, d, B.ORDER_TABLES)
    path = staged_path(spark, "orders_summary", key)
    if path:
        return P.read_summary(spark, path)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/orders_summary-{uuid.uuid4().hex}"
    summary = P.write_summary(B.orders_life(spark, d), path, {"java": "%.java"})
    remember_staged(spark, "orders_summary", key, path)
    return summary


def _from_summary(report, **options):
    """A report read from the summary instead of the lines."""
    return lambda spark, d: _rounded(getattr(P.LineSummary, report)(_orders_summary(spark, d), **options))


def _people_bitmaps(spark, d):
    """Weekly person bitmaps of the order lines in two arrivals, older lines first, merged."""
    from halflife.session import stage

    life = B.orders_life(spark, d)
    cut = life.agg(F.percentile_approx("created", 0.5)).scalar()
    late = F.coalesce(F.col("created") >= cut, F.lit(False))
    numbers, maps = None, []
    for part in (life.where(~late), life.where(late)):
        weeks = stage(P.people_weeks(part), "people_weeks")
        numbers = stage(P.number_people(weeks, numbers), "people_numbers")
        maps.append(P.week_bitmaps(weeks, numbers))
    return P.merge_bitmaps(*maps)


def _q_active_people_bitmaps(spark, d):
    """P4 corrected from merged bitmaps."""
    week = (F.floor(F.col("week") / 100) % 100 * 100 + F.col("week") % 100).cast("int")
    return P.distinct_people(_people_bitmaps(spark, d), week, "week")


def _q_active_people_years(spark, d):
    """Distinct persons per year: the same weekly bitmaps, united by year."""
    return P.distinct_people(_people_bitmaps(spark, d), F.floor(F.col("week") / 100).cast("int"), "year")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q = {
        "clean_int": _q_clean_int,
        "clean_date": _q_clean_date,
        "lifecycle_csv": _q_lifecycle_csv,
        "cohort_ids": _q_cohort_ids,
        "gap_minutes": _q_gap_minutes,
        "days_between": _q_days_between,
        "cohort_pairs": _q_cohort_pairs,
        "cohort_decay": _report(P.cohort_decay, B.orders_life),
        "cohort_decay_events": _report(P.cohort_decay, B.events_life),
        "cohort_decay_corrected": _report(P.cohort_decay, B.orders_life, corrected=True),
        "weekly_decay": _report(P.weekly_decay, B.orders_life),
        "weekly_decay_corrected": _report(P.weekly_decay, B.orders_life, corrected=True),
        "active_lines": _report(P.active_lines, B.orders_life),
        "active_lines_corrected": _report(P.active_lines, B.orders_life, corrected=True),
        "active_people": _report(P.active_people, B.orders_life),
        "active_people_corrected": _report(P.active_people, B.orders_life, corrected=True),
        "author_decay": _report(P.author_decay, B.orders_life, path_like="%.java", as_of=AS_OF),
        "author_decay_excluded": _report(P.author_decay, B.orders_life, exclude=EXCLUDED, as_of=AS_OF),
        "author_decay_today": _q_author_decay_today,
        "alias_csv": _q_alias_csv,
        "report_sink": _q_report_sink,
        "daily_sink": _q_daily_sink,
        "population_sink": _q_population_sink,
        "roster_sink": _q_roster_sink,
        "lifecycle_parquet": _q_lifecycle_parquet,
        "day_stamps": _q_day_stamps,
        "patch_hunks_parts": _q_patch_hunks_parts,
        "file_identity_parts": _q_file_identity_parts,
        "line_lifecycle_parts": _q_line_lifecycle_parts,
        "line_lifecycle_hot": _q_line_lifecycle_hot,
        "line_lifecycle_parts_all": _q_line_lifecycle_parts_all,
        "author_rates_parts": _q_author_rates_parts,
        "file_population_parts": _q_file_population_parts,
        "replay_errors": _q_replay_errors,
        "author_rates": _report(P.author_change_rates, B.events_life),
        "author_rates_corrected": _report(P.author_change_rates, B.events_life, corrected=True),
        "file_population": _q_file_population(False),
        "file_population_corrected": _q_file_population(True),
        "history_summary": _q_history_summary,
        "patch_hunks": _q_patch_hunks,
        "author_roster": _q_author_roster,
        "alias_resolution": _q_alias_resolution,
        "file_identity": _q_file_identity,
        "history_summary_log": _q_history_summary_log,
        "line_lifecycle": _q_line_lifecycle,
        "author_rates_log": _q_author_rates_log,
        "file_population_log": _q_file_population_log,
        "active_lines_stream": _q_active_lines_stream,
        "cohort_decay_summary": _from_summary("cohort_decay"),
        "weekly_decay_summary": _from_summary("weekly_decay"),
        "active_lines_summary": _from_summary("active_lines"),
        "active_people_summary": _from_summary("active_people", corrected=True),
        "author_decay_summary": _from_summary("author_decay", path_class="java", as_of=AS_OF),
        "author_rates_summary": _from_summary("author_change_rates"),
        "active_people_bitmaps": _q_active_people_bitmaps,
        "active_people_years": _q_active_people_years,
    }
    return q | (LLM.queries() if LLM else {})


# ---------------------------------------------------------------- oracles


def _cid(x: str) -> str:
    """DuckDB cohort id yyWW (strftime %y%W), -1 for null."""
    d = f"CAST({x} AS DATE)"
    return (
        f"CAST(coalesce((year({d}) % 100) * 100 + (dayofyear({d}) + 7 - isodow({d})) // 7, -1) AS INTEGER)"
    )


def _wkey(x: str) -> str:
    d = f"CAST({x} AS DATE)"
    return f"CAST(coalesce(year({d}) * 100 + (dayofyear({d}) + 7 - isodow({d})) // 7, -1) AS INTEGER)"


def _days(a: str, b: str) -> str:
    """floor((b - a) in days), as INTEGER."""
    return f"CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400000000.0) AS INTEGER)"


_ORDERS_RAW = """
ol_raw AS (
  SELECT p_name || CASE WHEN p_size % 2 = 0 THEN '.java' ELSE '.py' END AS path,
         'u' || CAST(o_custkey % 50 AS VARCHAR) AS creator,
         CASE WHEN l_linestatus = 'F' THEN 'u' || CAST(l_suppkey % 50 AS VARCHAR) END AS remover,
         o_orderdate AS created,
         CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS removed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
),
ol_last AS (SELECT greatest(max(created), max(removed)) + INTERVAL 1 DAY AS last_day FROM ol_raw)"""

_ORDERS = (
    "WITH "
    + _ORDERS_RAW
    + f""",
life AS (
  SELECT path, creator, remover, created, removed,
         greatest({_days('created', 'coalesce(removed, last_day)')}, -1) AS lifespan
  FROM ol_raw, ol_last
)"""
)

_EVENTS_RAW = """
el_raw AS (
  SELECT event_type || '/' || json_extract_string(props, '$.k')
           || CASE WHEN event_type IN ('click', 'view') THEN '.java' ELSE '.py' END AS path,
         'u' || CAST(user_id AS VARCHAR) AS creator,
         'u' || CAST(lead(user_id) OVER w AS VARCHAR) AS remover,
         date_trunc('second', ts) AS created,
         date_trunc('second', lead(ts) OVER w) AS removed
  FROM events
  WINDOW w AS (PARTITION BY event_type, props ORDER BY ts, event_id)
),
el_last AS (SELECT greatest(max(created), max(removed)) + INTERVAL 1 DAY AS last_day FROM el_raw)"""

_EVENTS = (
    "WITH "
    + _EVENTS_RAW
    + f""",
life AS (
  SELECT path, creator, remover, created, removed,
         greatest({_days('created', 'coalesce(removed, last_day)')}, -1) AS lifespan
  FROM el_raw, el_last
)"""
)

_LOG_EVENTS = """WITH ev AS (
  SELECT *, event_type || '/' || json_extract_string(props, '$.k')
           || CASE WHEN event_type IN ('click', 'view') THEN '.java' ELSE '.py' END AS path,
         lag(event_id) OVER (PARTITION BY event_type, props ORDER BY ts, event_id) AS prev_id
  FROM events
)"""

_PARTS = """WITH files AS (
  SELECT l_partkey AS file_id, min(o_orderdate) AS added,
         CASE WHEN l_partkey % 5 = 0 THEN max(l_shipdate) END AS removed
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey
)"""


def _gaps_cte() -> str:
    return f""",
times AS (SELECT DISTINCT created FROM life WHERE created IS NOT NULL),
gaps AS (
  SELECT created, lag(created) OVER (ORDER BY created) AS prev_created FROM times
),
gap_min AS (
  SELECT created, prev_created,
         CAST(CASE WHEN prev_created IS NOT NULL AND prev_created <> created THEN
           (((epoch_us(created) - epoch_us(prev_created)) // 1000000) % 86400) // 60 END AS INTEGER) AS gap_minutes
  FROM gaps
),
avg_gap AS (SELECT {_cid('created')} AS create_cohort, avg(gap_minutes) AS avg_time_between FROM gap_min GROUP BY 1)"""


def _p1_sql(base: str) -> str:
    return (
        base
        + _gaps_cte()
        + f""",
pairs AS (
  SELECT {_cid('created')} AS create_cohort, {_cid('removed')} AS remove_cohort,
         count(*) AS removed_in_this_cohort, max(lifespan) AS lifespan
  FROM life GROUP BY 1, 2
),
run AS (
  SELECT *, CAST(sum(removed_in_this_cohort) OVER (PARTITION BY create_cohort) AS BIGINT) AS total_in_cohort,
         CAST(sum(removed_in_this_cohort) OVER (PARTITION BY create_cohort ORDER BY lifespan, remove_cohort
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_removed_by_this_cohort
  FROM pairs
),
rated AS (
  SELECT *, CASE WHEN total_removed_by_this_cohort < total_in_cohort THEN
           ln(CAST(total_in_cohort - total_removed_by_this_cohort AS DOUBLE) / CAST(total_in_cohort AS DOUBLE))
           / CAST(greatest(lifespan, 1) AS DOUBLE) * 100000.0 END AS raw_rate
  FROM run
),
carried AS (
  SELECT *, coalesce(last_value(raw_rate IGNORE NULLS) OVER (
              ORDER BY create_cohort, lifespan, remove_cohort
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS decay_rate
  FROM rated
)"""
    )


def _p1_select(src: str, rate: str) -> str:
    return f"""
SELECT r.create_cohort, r.remove_cohort, r.lifespan, round(g.avg_time_between, 6) AS avg_time_between,
       r.total_in_cohort, r.removed_in_this_cohort, r.total_removed_by_this_cohort,
       round(CAST(r.removed_in_this_cohort AS DOUBLE) / CAST(r.total_in_cohort AS DOUBLE) * 100.0, 6) AS pct_sliding_decay,
       round(CAST(r.total_removed_by_this_cohort AS DOUBLE) / CAST(r.total_in_cohort AS DOUBLE) * 100.0, 6) AS pct_total_decay,
       round({rate}, 6) AS decay_rate
FROM {src} r LEFT JOIN avg_gap g USING (create_cohort)"""


def _p1_corrected_sql(base: str) -> str:
    return (
        base
        + _gaps_cte()
        + f""",
lines AS (SELECT {_cid('created')} AS cc, {_cid('removed')} AS rc, lifespan FROM life WHERE {_cid('created')} <> -1),
totals AS (SELECT cc AS create_cohort, count(*) AS total_in_cohort FROM lines GROUP BY 1),
pairs AS (
  SELECT cc AS create_cohort, rc AS remove_cohort, count(*) AS removed_in_this_cohort, max(lifespan) AS lifespan
  FROM lines WHERE rc <> -1 GROUP BY 1, 2
),
run AS (
  SELECT p.*, t.total_in_cohort,
         CAST(sum(removed_in_this_cohort) OVER (PARTITION BY p.create_cohort ORDER BY lifespan, remove_cohort
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_removed_by_this_cohort
  FROM pairs p JOIN totals t USING (create_cohort)
),
rated AS (
  SELECT *, CASE WHEN total_removed_by_this_cohort < total_in_cohort THEN
           ln(CAST(total_in_cohort - total_removed_by_this_cohort AS DOUBLE) / CAST(total_in_cohort AS DOUBLE))
           / CAST(greatest(lifespan, 1) AS DOUBLE) * 100000.0 END AS raw_rate
  FROM run
)"""
    )


def _p2_sql(base: str) -> str:
    return (
        _p1_sql(base)
        + """,
ends AS (
  SELECT create_cohort AS week, decay_rate,
         row_number() OVER (PARTITION BY create_cohort ORDER BY lifespan DESC, remove_cohort DESC) AS rn,
         lead(create_cohort) OVER (ORDER BY create_cohort, lifespan, remove_cohort) AS nxt
  FROM carried
)
SELECT round(decay_rate, 6) AS decay_rate, week FROM ends
WHERE rn = 1 AND week < (SELECT max(create_cohort) FROM carried)"""
    )


def _p2_corrected_sql(base: str) -> str:
    return (
        _p1_corrected_sql(base)
        + """,
last_row AS (
  SELECT create_cohort AS week, raw_rate,
         row_number() OVER (PARTITION BY create_cohort ORDER BY lifespan DESC, remove_cohort DESC) AS rn
  FROM rated
)
SELECT round(l.raw_rate, 6) AS decay_rate, t.create_cohort AS week
FROM totals t LEFT JOIN last_row l ON l.week = t.create_cohort AND l.rn = 1"""
    )


def _p3_sql(base: str) -> str:
    return (
        base
        + f""",
cw AS (SELECT {_cid('CAST(created AS DATE)')} AS week, count(*) AS lines_created FROM life GROUP BY 1 HAVING week <> -1),
rw AS (SELECT {_cid('CAST(removed AS DATE)')} AS week, count(*) AS lines_removed FROM life GROUP BY 1 HAVING week <> -1),
cr AS (SELECT week, lines_created, CAST(sum(lines_created) OVER (ORDER BY week) AS BIGINT) AS running_created FROM cw),
rr AS (SELECT week, lines_removed, CAST(sum(lines_removed) OVER (ORDER BY week) AS BIGINT) AS running_removed FROM rw)
SELECT cr.week, lines_created, running_created, lines_removed, running_removed,
       running_created - running_removed AS active_lines
FROM cr LEFT JOIN rr USING (week)"""
    )


def _p3_corrected_sql(base: str) -> str:
    return (
        base
        + f""",
cw AS (SELECT {_wkey('created')} AS week_key, count(*) AS lines_created FROM life GROUP BY 1 HAVING week_key <> -1),
rw AS (SELECT {_wkey('removed')} AS week_key, count(*) AS lines_removed FROM life GROUP BY 1 HAVING week_key <> -1),
j AS (
  SELECT coalesce(cw.week_key, rw.week_key) AS week_key, coalesce(lines_created, 0) AS lines_created,
         coalesce(lines_removed, 0) AS lines_removed
  FROM cw FULL OUTER JOIN rw ON cw.week_key = rw.week_key
),
s AS (
  SELECT *, CAST(sum(lines_created) OVER (ORDER BY week_key) AS BIGINT) AS running_created,
         CAST(sum(lines_removed) OVER (ORDER BY week_key) AS BIGINT) AS running_removed FROM j
)
SELECT CAST(((week_key // 100) % 100) * 100 + week_key % 100 AS INTEGER) AS week, lines_created, running_created,
       lines_removed, running_removed, running_created - running_removed AS active_lines FROM s"""
    )


def _p4_sql(base: str, corrected: bool) -> str:
    if corrected:
        people = f"""
people AS (
  SELECT creator AS person, {_cid('created')} AS week FROM life
  UNION ALL SELECT remover, {_cid('removed')} FROM life
)
SELECT week, count(DISTINCT person) AS active_people FROM people
WHERE week <> -1 AND person IS NOT NULL GROUP BY week"""
    else:
        people = f"""
people AS (SELECT creator AS person, {_cid('created')} AS week FROM life)
SELECT week, count(DISTINCT person) AS active_people FROM people GROUP BY week"""
    return base + "," + people


def _p5_sql(base: str, rows: str = "path LIKE '%.java'", today: str = f"DATE '{AS_OF}'") -> str:
    return (
        base
        + f""",
rows_ AS (SELECT * FROM life WHERE {rows} AND creator IS NOT NULL),
tot AS (SELECT count(*) FILTER (WHERE removed IS NULL) AS act FROM rows_),
per AS (
  SELECT creator, count(*) AS lines_created,
         nullif(count(*) FILTER (WHERE removed IS NOT NULL), 0) AS lines_removed,
         CAST(min(created) AS DATE) AS author_first, CAST(max(created) AS DATE) AS author_last,
         avg(lifespan) AS avg_lifespan,
         nullif(count(*) FILTER (WHERE removed IS NOT NULL AND remover = creator), 0) AS lines_removed_by_author,
         nullif(count(*) FILTER (WHERE removed IS NULL), 0) AS lines_active
  FROM rows_ GROUP BY creator
)
SELECT creator, lines_created, lines_removed, author_first, author_last, round(avg_lifespan, 6) AS avg_lifespan,
       lines_removed_by_author, lines_active,
       CAST({today} - author_first AS INTEGER) AS account_age,
       CAST(author_last - author_first AS INTEGER) AS account_lifespan,
       CAST({today} - author_last AS INTEGER) AS account_dormant_for,
       round(CAST(lines_removed AS DOUBLE) / lines_created, 6) AS pct_removed,
       round(CAST(lines_removed_by_author AS DOUBLE) / lines_created, 6) AS pct_removed_by_self,
       round(CAST(lines_active AS DOUBLE) / nullif(act, 0), 6) AS pct_of_active_code_base
FROM per, tot"""
    )


def _p6_sql(base: str, corrected: bool) -> str:
    alive = "" if corrected else " AND removed IS NULL"
    return (
        base
        + f""",
ev AS (
  SELECT CAST(created AS DATE) AS date, creator AS author, 1 AS a, 0 AS r FROM life
  WHERE created IS NOT NULL{alive}
  UNION ALL
  SELECT CAST(removed AS DATE), remover, 0, 1 FROM life WHERE removed IS NOT NULL
)
SELECT date, author, CAST(sum(a) AS BIGINT) AS lines_added, CAST(sum(r) AS BIGINT) AS lines_removed
FROM ev GROUP BY date, author"""
    )


_LOG_FILES = """WITH files AS (
  SELECT min(date_trunc('second', ts)) AS added, CAST(NULL AS TIMESTAMP) AS removed
  FROM events GROUP BY event_type, props
),
b AS (SELECT min(added) AS start, (SELECT max(date_trunc('second', ts)) FROM events) AS last_change FROM files)"""

_PARTS_BOUNDS = (
    _PARTS + """,
b AS (SELECT min(added) AS start, greatest(max(added), max(removed)) AS last_change FROM files)"""
)


def _p7_sql(corrected: bool, files_and_bounds: str | None = None) -> str:
    """Brute force over days x files, as the reference loops (fine at sf0.01)."""
    exist = (
        "added < stamp AND (removed IS NULL OR removed >= stamp)"
        if corrected
        else "removed IS NULL AND added < stamp"
    )
    made = "TRUE" if corrected else "removed IS NULL"
    gone = "removed IS NOT NULL AND removed < stamp"
    e_cols = ",\n  ".join(f"count(*) FILTER (WHERE {exist} AND eb = {i}) AS e{i + 1}" for i in range(10))
    r_cols = ",\n  ".join(f"count(*) FILTER (WHERE {gone} AND rb = {i}) AS r{i + 1}" for i in range(10))
    return (
        (files_and_bounds or _PARTS_BOUNDS)
        + f""",
cal AS (
  SELECT start, start - INTERVAL 1 DAY AS first_day,
         {_days("start - INTERVAL 1 DAY", "last_change + INTERVAL 1 DAY")} + 1 AS n_days FROM b
),
days AS (
  SELECT i AS dc, CAST(CAST(first_day AS DATE) + CAST(i AS INTEGER) AS TIMESTAMP) + INTERVAL '23:59:59' AS stamp, start
  FROM cal, range(0, n_days) t(i)
),
x AS (
  SELECT dc, stamp, added, removed,
         {_days("added", "stamp")} + 1 AS age,
         {_days("start", "removed")} AS rage
  FROM days CROSS JOIN files
),
y AS (
  SELECT *,
         CASE WHEN dc > 0 THEN least(greatest(CAST(floor(age * 10.0 / dc) AS INTEGER), 0), 9) ELSE 0 END AS eb,
         CASE WHEN dc > 0 THEN least(greatest(CAST(floor(rage * 10.0 / dc) AS INTEGER), 0), 9) ELSE 0 END AS rb
  FROM x
)
SELECT strftime(CAST(stamp AS DATE), '%Y-%m-%d') AS date,
  count(*) FILTER (WHERE {made} AND added < stamp AND added > stamp - INTERVAL 1 DAY) AS files_created_today,
  count(*) FILTER (WHERE {gone} AND removed > stamp - INTERVAL 1 DAY) AS files_removed_today,
  count(*) FILTER (WHERE {exist}) AS files_in_existence,
  count(*) FILTER (WHERE {gone}) AS files_in_removed,
  CAST(coalesce(floor(sum(age) FILTER (WHERE {exist}) / nullif(count(*) FILTER (WHERE {exist}), 0)), 0) AS BIGINT)
    AS avg_lifetime,
  CAST(coalesce(floor(sum(rage) FILTER (WHERE {gone}) / nullif(count(*) FILTER (WHERE {gone}), 0)), 0) AS BIGINT)
    AS avg_removetime,
  {e_cols},
  {r_cols}
FROM y GROUP BY stamp"""
    )


def _p8_sql() -> str:
    return (
        _PARTS
        + f""",
b AS (SELECT min(added) AS start, greatest(max(added), max(removed)) AS last_change FROM files)
SELECT count(*) FILTER (WHERE removed IS NULL) AS files, count(*) FILTER (WHERE removed IS NOT NULL) AS removed_files,
       any_value(start) AS start, any_value(last_change) AS last_change,
       any_value({_days('start', 'last_change')}) + 1 AS duration
FROM files, b"""
    )


# The parts log, told without a log: which lines each step adds and what ends them.
_PARTS_LOG = """WITH steps AS (
  SELECT l_partkey AS part, p_size % 2 = 0 AS java, i, i % 8 AS j, i // 8 AS epoch,
    'u' || CAST(o_custkey % 50 AS VARCHAR) || '@example.org' AS author,
    TIMESTAMP '2015-01-05 00:00:00' + to_days(CAST(7 * i AS INTEGER)) + to_seconds(l_partkey % 600000) AS tm
  FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) - 1 AS i FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
),
pfiles AS (
  SELECT part, epoch, min(tm) AS added, max(tm) FILTER (WHERE j = 7) AS removed, max(author) FILTER (WHERE j = 7) AS deleter,
    max(j) AS last_j,
    CASE WHEN part % 3 = 0 THEN 'a "b"/été' || chr(9) ELSE 'parts' END || '/'
      || CASE WHEN max(j) >= 5 THEN 'v3/' WHEN max(j) = 4 THEN 'v2/' ELSE '' END
      || 'p' || part || CASE WHEN any_value(java) THEN '.java' ELSE '.py' END AS path
  FROM steps GROUP BY part, epoch
),
ends AS (
  SELECT s.*, f.path, f.removed AS file_removed, f.deleter, t.author AS next_author, t.tm AS next_at
  FROM steps s JOIN pfiles f USING (part, epoch)
  LEFT JOIN steps t ON t.part = s.part AND t.i = s.i + 3 AND s.j <= 3
  WHERE s.j <> 7
),
plines AS (
  SELECT path, author AS creator, tm AS created, coalesce(next_author, deleter) AS remover,
    coalesce(next_at, file_removed) AS removed, file_removed FROM ends
  UNION ALL
  SELECT path, author, tm, deleter, file_removed, file_removed FROM ends
)"""

_PARTS_LIFE = f"""
SELECT path, creator, remover, created, removed,
  greatest({_days('created', "coalesce(removed, (SELECT max(tm) FROM steps) + INTERVAL 1 DAY)")}, -1) AS lifespan
FROM plines"""

_PARTS_HUNKS = """,
shown AS (
  SELECT *, CASE WHEN part % 3 = 0 THEN 'a "b"/été' || chr(9) ELSE 'parts' END || '/'
    || CASE WHEN j >= 5 THEN 'v3/' WHEN j = 4 THEN 'v2/' ELSE '' END || 'p' || part || CASE WHEN java THEN '.java' ELSE '.py' END AS path
  FROM steps
)
SELECT path AS new_path, author, tm AS committed, CASE j WHEN 0 THEN 'C' WHEN 4 THEN 'R' ELSE 'M' END AS kind, 0 AS start,
  CASE WHEN j = 0 THEN 2 ELSE 1 END AS lines_added, CASE WHEN j >= 3 THEN 1 ELSE 0 END AS lines_removed FROM shown WHERE j <> 7
UNION ALL
SELECT path, author, tm, CASE j WHEN 4 THEN 'R' ELSE 'M' END, CAST(CASE j WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE j + 1 END AS INTEGER), 1, 0
FROM shown WHERE j BETWEEN 1 AND 6
UNION ALL
SELECT path, author, tm, 'D', 0, 0, 10 FROM shown WHERE j = 7 AND epoch % 2 = 1"""

_P6_TAIL = """,
ev AS (
  SELECT CAST(created AS DATE) AS date, creator AS author, 1 AS a, 0 AS r FROM life WHERE removed IS NULL
  UNION ALL
  SELECT CAST(removed AS DATE), remover, 0, 1 FROM life WHERE removed IS NOT NULL
)
SELECT date, author, CAST(sum(a) AS BIGINT) AS lines_added, CAST(sum(r) AS BIGINT) AS lines_removed FROM ev GROUP BY date, author"""


def oracle_sql() -> dict[str, str]:
    return _report_oracles() | (LLM.oracle_sql() if LLM else {})


def _report_oracles() -> dict[str, str]:
    gaps_only = _EVENTS + _gaps_cte() + "\nSELECT created, prev_created, gap_minutes FROM gap_min"
    return {
        "clean_int": "WITH "
        + _ORDERS_RAW
        + f""",
t AS (SELECT CAST({_days('created', 'coalesce(removed, last_day)')} AS VARCHAR) AS lifespan_text FROM ol_raw, ol_last)
SELECT coalesce(lifespan_text, 'None') AS lifespan_text,
       CAST(CASE WHEN lifespan_text IS NULL THEN -1
            WHEN regexp_matches(trim(lifespan_text), '^[0-9]+$') THEN coalesce(TRY_CAST(trim(lifespan_text) AS INTEGER), -1)
            ELSE -1 END AS INTEGER) AS lifespan,
       count(*) AS n
FROM t GROUP BY lifespan_text""",
        "clean_date": _EVENTS
        + """,
t AS (
  SELECT coalesce(strftime(created, '%Y-%m-%d %H:%M:%S'), 'None') AS text FROM life
  UNION ALL SELECT coalesce(strftime(removed, '%Y-%m-%d %H:%M:%S'), 'None') FROM life
)
SELECT text, CASE WHEN text <> 'None' THEN CAST(text AS TIMESTAMP) END AS parsed, count(*) AS n FROM t GROUP BY text""",
        "lifecycle_csv": _ORDERS + "\nSELECT path, creator, remover, created, removed, lifespan FROM life",
        "cohort_ids": "WITH "
        + _ORDERS_RAW
        + f""",
d AS (SELECT CAST(created AS DATE) AS day FROM ol_raw UNION ALL SELECT CAST(removed AS DATE) FROM ol_raw),
g AS (SELECT day, count(*) AS n FROM d GROUP BY day)
SELECT day, {_cid('day')} AS cohort_id,
       CASE WHEN day IS NULL THEN '1' ELSE strftime(day, '%W') || '_' || strftime(day, '%y') END AS cohort_label,
       {_wkey('day')} AS week_key, n
FROM g""",
        "gap_minutes": gaps_only,
        "days_between": _EVENTS
        + f"""
SELECT CASE WHEN removed IS NULL THEN -1 WHEN created IS NULL THEN -2 ELSE {_days('created', 'removed')} END AS days,
       count(*) AS n
FROM life GROUP BY 1""",
        "cohort_pairs": _ORDERS
        + f"""
SELECT {_cid('created')} AS create_cohort, {_cid('removed')} AS remove_cohort,
       count(*) AS removed_in_this_cohort, max(lifespan) AS lifespan
FROM life GROUP BY 1, 2""",
        "cohort_decay": _p1_sql(_ORDERS) + _p1_select("carried", "r.decay_rate"),
        "cohort_decay_events": _p1_sql(_EVENTS) + _p1_select("carried", "r.decay_rate"),
        "cohort_decay_corrected": _p1_corrected_sql(_ORDERS) + _p1_select("rated", "r.raw_rate"),
        "weekly_decay": _p2_sql(_ORDERS),
        "weekly_decay_corrected": _p2_corrected_sql(_ORDERS),
        "active_lines": _p3_sql(_ORDERS),
        "active_lines_corrected": _p3_corrected_sql(_ORDERS),
        "active_people": _p4_sql(_ORDERS, False),
        "active_people_corrected": _p4_sql(_ORDERS, True),
        "author_decay": _p5_sql(_ORDERS),
        "author_decay_excluded": _p5_sql(_ORDERS, "creator NOT IN ('u7', 'u13')"),
        "author_decay_today": _p5_sql(_ORDERS, today="current_date"),
        "alias_csv": """
SELECT CASE WHEN s_suppkey % 5 = 0 THEN 's' || s_suppkey ELSE 'n' || s_nationkey END AS author, count(*) AS n
FROM supplier GROUP BY 1""",
        "report_sink": _p3_sql(_ORDERS),
        "daily_sink": _p6_sql(_EVENTS, False),
        "population_sink": _p7_sql(False),
        "roster_sink": """
SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) || '@example.org' AS alias_from,
       'u' || CAST(user_id AS VARCHAR) || '@example.org' AS alias_to
FROM events""",
        "lifecycle_parquet": _EVENTS + "\nSELECT path, creator, remover, created, removed, lifespan FROM life",
        "day_stamps": _EVENTS + """
SELECT CAST(created AS DATE) AS day, date_trunc('day', max(created))::TIMESTAMP AS day_start,
  date_trunc('day', max(created)) + INTERVAL '23:59:59' AS day_end, date_trunc('day', max(created)) + INTERVAL '01:00:00' AS day_one,
  count(*) AS n
FROM life GROUP BY 1""",
        "patch_hunks_parts": _PARTS_LOG + _PARTS_HUNKS,
        "file_identity_parts": _PARTS_LOG + "\nSELECT path, added, removed FROM pfiles",
        "line_lifecycle_hot": f"""
WITH r AS (
  SELECT date_trunc('second', ts) AS tm, 'u' || CAST(user_id AS VARCHAR) || '@example.org' AS who, event_id,
    row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events
),
x AS (
  SELECT 'queue.log' AS path, a.who AS creator, b.who AS remover, a.tm AS created, b.tm AS removed FROM r a LEFT JOIN r b ON b.i = 2 * a.i + 1
  UNION ALL
  SELECT 'notes/' || CAST(event_id AS VARCHAR) || '.txt', who, NULL, tm, NULL FROM r
),
l AS (SELECT max(tm) + INTERVAL 1 DAY AS last_day FROM r)
SELECT path, creator, remover, created, removed, greatest({_days('created', 'coalesce(removed, last_day)')}, -1) AS lifespan FROM x, l""",
        "line_lifecycle_parts": _PARTS_LOG + _PARTS_LIFE + "\nWHERE file_removed IS NULL",
        "line_lifecycle_parts_all": _PARTS_LOG + _PARTS_LIFE,
        "author_rates_parts": _PARTS_LOG + ", life AS (" + _PARTS_LIFE + ")" + _P6_TAIL,
        "file_population_parts": _p7_sql(False, _PARTS_LOG + """,
files AS (SELECT added, removed FROM pfiles),
b AS (SELECT (SELECT min(added) FROM pfiles) AS start, (SELECT max(tm) FROM steps) AS last_change)"""),
        "replay_errors": _PARTS_LOG + """
SELECT 'replay' AS kind, path, CAST(2 AS BIGINT) AS n FROM pfiles WHERE part % 10 = 0 AND last_j >= 6""",
        "author_rates": _p6_sql(_EVENTS, False),
        "author_rates_corrected": _p6_sql(_EVENTS, True),
        "file_population": _p7_sql(False),
        "file_population_corrected": _p7_sql(True),
        "history_summary": _p8_sql(),
        "patch_hunks": _LOG_EVENTS
        + """
SELECT path AS new_path, 'u' || CAST(user_id AS VARCHAR) || '@example.org' AS author,
       date_trunc('second', ts) AS committed, CASE WHEN prev_id IS NULL THEN 'C' ELSE 'M' END AS kind,
       0 AS start, 1 AS lines_added, CASE WHEN prev_id IS NULL THEN 0 ELSE 1 END AS lines_removed
FROM ev""",
        "author_roster": """
SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) || '@example.org' AS alias_from,
       'u' || CAST(user_id AS VARCHAR) || '@example.org' AS alias_to
FROM events""",
        "alias_resolution": "SELECT 'u' || CAST(user_id AS VARCHAR) AS author, count(*) AS commits FROM events GROUP BY 1",
        "file_identity": _LOG_EVENTS
        + """
SELECT path, min(date_trunc('second', ts)) AS added, CAST(NULL AS TIMESTAMP) AS removed
FROM ev GROUP BY event_type, props, path""",
        "history_summary_log": f"""
WITH b AS (SELECT count(DISTINCT (event_type, props)) AS files, min(date_trunc('second', ts)) AS start,
                  max(date_trunc('second', ts)) AS last_change FROM events)
SELECT files, CAST(0 AS BIGINT) AS removed_files, start, last_change, {_days('start', 'last_change')} + 1 AS duration
FROM b""",
        "line_lifecycle": _EVENTS + "\nSELECT path, creator, remover, created, removed, lifespan FROM life",
        "author_rates_log": _p6_sql(_EVENTS, False),
        "file_population_log": _p7_sql(False, _LOG_FILES),
        "active_lines_stream": _p3_corrected_sql(_ORDERS),
        "cohort_decay_summary": _p1_sql(_ORDERS) + _p1_select("carried", "r.decay_rate"),
        "weekly_decay_summary": _p2_sql(_ORDERS),
        "active_lines_summary": _p3_sql(_ORDERS),
        "active_people_summary": _p4_sql(_ORDERS, True),
        "author_decay_summary": _p5_sql(_ORDERS),
        "author_rates_summary": _p6_sql(_ORDERS, False),
        "active_people_bitmaps": _p4_sql(_ORDERS, True),
        "active_people_years": _ORDERS + """,
people AS (
  SELECT creator AS person, year(created) AS year FROM life UNION ALL SELECT remover, year(removed) FROM life
)
SELECT CAST(year AS INTEGER) AS year, count(DISTINCT person) AS active_people FROM people
WHERE year IS NOT NULL AND person IS NOT NULL GROUP BY 1""",
    }
