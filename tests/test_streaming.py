"""Streaming weekly activity equals the batch corrected reports."""

import tempfile

from fixtures import lifecycle, rows
from halflife import plans as P
from halflife.streaming import LINE_EVENT_SCHEMA, start_weekly_activity, to_line_events


def test_weekly_activity_stream(spark):
    lc = lifecycle(spark)
    events = to_line_events(lc)
    src = tempfile.mkdtemp(prefix="halflife-stream-src-", dir="/tmp")
    out = tempfile.mkdtemp(prefix="halflife-stream-out-", dir="/tmp")
    ckpt = tempfile.mkdtemp(prefix="halflife-stream-ckpt-", dir="/tmp")
    # two arrivals: events before and after 2018-09-17
    events.where("at < '2018-09-17'").write.mode("append").parquet(src)
    stream = spark.readStream.schema(LINE_EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    for q in start_weekly_activity(stream, out, ckpt):
        q.awaitTermination()
    events.where("at >= '2018-09-17'").write.mode("append").parquet(src)
    for q in start_weekly_activity(stream, out, ckpt):
        q.awaitTermination()
    lines = spark.read.parquet(f"{out}/active_lines").orderBy("week")
    assert rows(lines) == rows(P.active_lines(lc, corrected=True))
    people = spark.read.parquet(f"{out}/active_people").orderBy("week")
    assert rows(people) == rows(P.active_people(lc, corrected=True))
