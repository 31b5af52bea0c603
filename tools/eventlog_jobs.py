"""Summarise a Spark event log (rolling, zstd) from a scratch folder: per-job time and stage count."""

import glob
import io
import json
import sys

import zstandard


def events(folder):
    for f in sorted(glob.glob(f"{folder}/**/events_*", recursive=True), key=lambda p: int(p.rsplit("events_", 1)[1].split("_")[0])):
        data = open(f, "rb").read()
        text = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read().decode() if f.endswith(".zstd") else data.decode()
        for line in text.splitlines():
            if line.strip():
                yield json.loads(line)


def main(folder):
    jobs, sql = {}, {}
    for e in events(folder):
        ev = e["Event"]
        if ev == "SparkListenerJobStart":
            jobs[e["Job ID"]] = [e["Submission Time"], None, len(e["Stage IDs"]), e.get("Properties", {}).get("spark.sql.execution.id")]
        elif ev == "SparkListenerJobEnd":
            jobs[e["Job ID"]][1] = e["Completion Time"]
        elif ev.endswith("SparkListenerSQLExecutionStart"):
            sql[str(e["executionId"])] = [e["time"], None, e.get("description", "")[:60]]
        elif ev.endswith("SparkListenerSQLExecutionEnd"):
            sql[str(e["executionId"])][1] = e["time"]
    t0 = min(v[0] for v in jobs.values())
    for k, v in sorted(sql.items(), key=lambda kv: kv[1][0]):
        js = [j for j, jv in jobs.items() if jv[3] == k]
        dur = (v[1] - v[0]) / 1000 if v[1] else None
        print(f"sql {k:>4} start={(v[0]-t0)/1000:7.2f}s dur={dur}s jobs={len(js)} stages={sum(jobs[j][2] for j in js)} {v[2]}")


if __name__ == "__main__":
    main(sys.argv[1])
