"""Patch-log ingest against hand-worked logs and a seeded history simulator."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from gitsim import Sim
from halflife.operators import ingest as I
from halflife.sources.patch_log import read_log_records, read_patch_log

T = dt.datetime


def _log(spark, text, parts=1):
    d = tempfile.mkdtemp(prefix="halflife-log-", dir="/tmp")
    if parts == 1:
        with open(os.path.join(d, "log.txt"), "w") as fh:
            fh.write(text)
    else:  # split the log into files named in order, at commit boundaries
        commits = ["commit " + c for c in text.split("\ncommit ")]
        commits[0] = commits[0][len("commit "):]
        step = max(1, len(commits) // parts)
        for i in range(0, len(commits), step):
            with open(os.path.join(d, f"log-{i:06d}.txt"), "w") as fh:
                fh.write("\n".join(commits[i:i + step]))
    return read_patch_log(spark, d)


def _rows(df):
    return sorted(tuple("" if v is None else v for v in r) for r in df.collect())


FIXTURE_LOG = """commit 1111
Author: Ann <ann@example.org>
Date:   Mon Sep 10 09:00:00 2018 +0200

    new a

diff --git a/a.java b/a.java
new file mode 100644
index 0000000..1111111
--- /dev/null
+++ b/a.java
@@ -0,0 +1,3 @@
+x
+y
+z

commit 2222
Author: Bob <bob@example.org>
Date:   Tue Sep 11 09:00:00 2018 +0200

    edit a

diff --git a/a.java b/a.java
index 1111111..2222222 100644
--- a/a.java
+++ b/a.java
@@ -1,3 +1,4 @@
 x
-y
+Y
 z
+w

commit 3333
Author: Cat <cat@example.org>
Date:   Wed Sep 12 09:00:00 2018 +0200

    rename

diff --git a/a.java b/c.java
similarity index 100%
rename from a.java
rename to c.java

commit 4444
Author: Ann <ann@example.org>
Date:   Thu Sep 13 09:00:00 2018 +0200

    edit c

diff --git a/c.java b/c.java
index 2222222..3333333 100644
--- a/c.java
+++ b/c.java
@@ -1,4 +1,3 @@
-x
 Y
 z
 w
"""


def test_fixture_log(spark):
    lc = I.line_lifecycle(_log(spark, FIXTURE_LOG))
    exp = [
        ("c.java", "ann@example.org", "ann@example.org", T(2018, 9, 10, 9), T(2018, 9, 13, 9), 3),
        ("c.java", "ann@example.org", "bob@example.org", T(2018, 9, 10, 9), T(2018, 9, 11, 9), 1),
        ("c.java", "ann@example.org", None, T(2018, 9, 10, 9), None, 4),
        ("c.java", "bob@example.org", None, T(2018, 9, 11, 9), None, 3),
        ("c.java", "bob@example.org", None, T(2018, 9, 11, 9), None, 3),
    ]
    assert _rows(lc) == sorted(tuple("" if v is None else v for v in r) for r in exp)


def test_alias_resolution(spark):
    d = tempfile.mkdtemp(prefix="halflife-alias-", dir="/tmp")
    with open(os.path.join(d, "authors_mapping.csv"), "w") as fh:
        fh.write("ann@example.org, ann\nbob@example.org,robert\nbob@example.org,  bob\n")
    alias = I.read_alias_map(spark, d)
    assert sorted(tuple(r) for r in alias.collect()) == [("ann@example.org", "ann"), ("bob@example.org", "bob")]
    lc = I.line_lifecycle(_log(spark, FIXTURE_LOG), alias)
    assert sorted({r.creator for r in lc.collect()}) == ["ann", "bob"]


def test_roster(spark):
    r = I.author_roster(I.commits(_log(spark, FIXTURE_LOG)))
    assert sorted(tuple(x) for x in r.collect()) == [
        ("ann@example.org", "ann@example.org"), ("bob@example.org", "bob@example.org"),
        ("cat@example.org", "cat@example.org")]


def test_header_parsing(spark):
    cm = I.commits(_log(spark, FIXTURE_LOG)).orderBy("seq").collect()
    assert [c.author for c in cm] == ["ann@example.org", "bob@example.org", "cat@example.org", "ann@example.org"]
    assert cm[0].committed == T(2018, 9, 10, 9)
    text = "commit 1\nAuthor: Just A Name\nDate:   Sat Feb 3 1:02:03 2001 -0500\n\n    m\n"
    c = I.commits(_log(spark, text)).collect()[0]
    assert c.author == "just a name" and c.committed == T(2001, 2, 3, 1, 2, 3)


EDGE_LOG = """commit aaaa
Author: Ann <ann@example.org>
Date:   Mon Sep 10 09:00:00 2018 +0200

    two files, one quoted

diff --git "a/dir/my file.txt" "b/dir/my file.txt"
new file mode 100644
index 0000000..1111111
--- /dev/null
+++ "b/dir/my file.txt"
@@ -0,0 +1,2 @@
+one
+two
\\ No newline at end of file
diff --git a/m.py b/m.py
new file mode 100644
index 0000000..1111111
--- /dev/null
+++ b/m.py
@@ -0,0 +1,8 @@
+1
+2
+3
+4
+5
+6
+7
+8

commit bbbb
Author: Bob <bob@example.org>
Date:   Tue Sep 11 09:00:00 2018 +0200

    no diff here

commit cccc
Author: Bob <bob@example.org>
Date:   Tue Sep 11 10:00:00 2018 +0200

    still no diff

commit dddd
Author: Bob <bob@example.org>
Date:   Wed Sep 12 09:00:00 2018 +0200

    multi hunk, a removed line that looks like a header

diff --git a/m.py b/m.py
index 1111111..2222222 100644
--- a/m.py
+++ b/m.py
@@ -1 +1 @@
-1
+-- a/one
@@ -8 +8,2 @@
 8
+9

commit eeee
Author: Cat <cat@example.org>
Date:   Thu Sep 13 09:00:00 2018 +0200

    edit the header-looking line away

diff --git a/m.py b/m.py
index 2222222..3333333 100644
--- a/m.py
+++ b/m.py
@@ -1,2 +1,2 @@
--- a/one
+x
 2

commit ffff
Author: Cat <cat@example.org>
Date:   Fri Sep 14 09:00:00 2018 +0200

    binary delete of the quoted file

diff --git "a/dir/my file.txt" "b/dir/my file.txt"
deleted file mode 100644
index 1111111..0000000
Binary files "a/dir/my file.txt" and /dev/null differ

commit 9999
Author: Dan <dan@example.org>
Date:   Sat Sep 15 09:00:00 2018 +0200

    re-create the same path

diff --git "a/dir/my file.txt" "b/dir/my file.txt"
new file mode 100644
index 0000000..1111111
--- /dev/null
+++ "b/dir/my file.txt"
@@ -0,0 +1 @@
+again
"""


def test_edge_cases(spark):
    lc = I.line_lifecycle(_log(spark, EDGE_LOG), include_removed_files=True, with_file_columns=True)
    rows = lc.collect()
    by_path = {}
    for r in rows:
        by_path.setdefault(r.path, []).append(r)
    quoted = by_path["dir/my file.txt"]
    # first incarnation: two lines closed by the binary delete; second: one live line
    closed = sorted((r.creator, r.remover, r.removed) for r in quoted if r.removed is not None)
    assert closed == [("ann@example.org", "cat@example.org", T(2018, 9, 14, 9))] * 2
    live = [r for r in quoted if r.removed is None]
    assert len(live) == 1 and live[0].creator == "dan@example.org" and live[0].file_removed is None
    assert len({r.file_id for r in quoted}) == 2
    m = sorted((r.creator, r.remover or "", str(r.created), str(r.removed)) for r in by_path["m.py"])
    assert len(by_path["m.py"]) == 11  # 8 + '-- a/one' + 9 + x
    removed = [x for x in m if x[1]]
    assert ("ann@example.org", "bob@example.org", "2018-09-10 09:00:00", "2018-09-12 09:00:00") in removed
    assert ("bob@example.org", "cat@example.org", "2018-09-12 09:00:00", "2018-09-13 09:00:00") in removed
    assert all(r.replay_errors == 0 for r in rows)
    # default: lines of deleted files are left out; the re-created file is live
    default = I.line_lifecycle(_log(spark, EDGE_LOG)).collect()
    assert len(default) == len(rows) - 2


def test_empty_log(spark):
    d = tempfile.mkdtemp(prefix="halflife-log-", dir="/tmp")
    open(os.path.join(d, "log.txt"), "w").close()
    assert I.line_lifecycle(read_patch_log(spark, d)).count() == 0


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 3), (3, 1), (4, 5)])
def test_simulated_history(spark, seed, parts):
    sim = Sim(seed).run(120)
    log = _log(spark, sim.log_text(), parts=parts)
    for include in (False, True):
        got = I.line_lifecycle(log, include_removed_files=include)
        exp = [tuple("" if v is None else v for v in (p, f"{c}@example.org", r and f"{r}@example.org", a, b, life))
               for p, c, r, a, b, life in sim.truth(include)]
        assert _rows(got) == sorted(exp)
    diffs = I.compact_diffs(I.file_diffs(I.commits(log)))
    _, files = I.file_identity(diffs)
    assert sorted(tuple(r) for r in files.select("path", "added", "removed").collect()) == sim.files_truth()


@pytest.mark.parametrize("seed", [5, 6])
def test_identity_independent_of_buckets(spark, seed):
    sim = Sim(seed).run(150)
    log = _log(spark, sim.log_text())
    diffs = I.compact_diffs(I.file_diffs(I.commits(log)))

    def ident(bucket):
        df, files = I.file_identity(diffs.withColumn("seq_bucket", bucket))
        return (sorted(tuple(r) for r in df.select("seq", "dpos", "ev", "file_id").collect()),
                sorted(tuple(r) for r in files.select("file_id", "path", "added", "removed").collect()))

    one = ident(F.lit(0))
    assert ident(F.col("seq")) == one  # every commit its own bucket
    assert one[1] and sorted((p, a, r) for _, p, a, r in one[1]) == sim.files_truth()


# ---------------------------------------------------------------- log records: cut at commits and diffs


def _both(spark, path):
    return read_patch_log(spark, path), read_log_records(spark, path)


def _parsed(log):
    cols = ["author", "committed", "old_path", "new_path", "is_create", "is_delete", "is_rename", "hunk_ops", "kind", "date_missing"]
    return sorted(str(tuple(r)) for r in I.parse_log(log).select(cols).collect())


def _written(*texts):
    d = tempfile.mkdtemp(prefix="halflife-log-", dir="/tmp")
    for i, text in enumerate(texts):
        with open(os.path.join(d, f"log-{i}.txt"), "w") as fh:
            fh.write(text)
    return d


@pytest.mark.parametrize("texts", [[FIXTURE_LOG], [EDGE_LOG], [FIXTURE_LOG, EDGE_LOG], ["commit 1\nAuthor: A <a@b.c>\n\n    no diff, no date\n"]])
def test_records_parse_like_commits(spark, texts):
    whole, records = _both(spark, _written(*texts))
    assert _parsed(records) == _parsed(whole)
    heads = [sorted(tuple(r) for r in I.commits(x).select("sha", F.coalesce("author", F.lit("")), F.col("committed").cast("string")).fillna("").collect()) for x in (whole, records)]
    assert heads[0] == heads[1]


def test_no_record_holds_two_diffs(spark):
    """One commit with many diffs, cut over several splits of the file, in log order."""
    body = "".join(f"diff --git a/f{i} b/f{i}\nnew file mode 100644\n--- /dev/null\n+++ b/f{i}\n@@ -0,0 +1,2 @@\n+{i}\n+{'x' * 200}\n" for i in range(400))
    later = FIXTURE_LOG.replace("a.java", "f7").replace("new file mode 100644\n", "")
    path = _written("commit 1\nAuthor: Big <big@example.org>\nDate:   Mon Sep 3 09:00:00 2018 +0200\n\n    import\n\n" + body + "\n" + later)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        records = read_log_records(spark, path)
        assert records.select("seq_bucket").distinct().count() > 3
        assert records.agg(F.max(F.length("diff"))).first()[0] < 400
        assert records.where("diff like '%diff --git%' or head like '%diff --git%'").count() == 0
        lines = sorted(tuple("" if v is None else str(v) for v in r) for r in I.line_lifecycle(records).collect())
        whole = sorted(tuple("" if v is None else str(v) for v in r) for r in I.line_lifecycle(read_patch_log(spark, path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert lines == whole and sum(r[1] == "big@example.org" for r in lines) == 800


@pytest.mark.parametrize("seed", [2, 4])
def test_simulated_history_from_records(spark, seed):
    sim = Sim(seed).run(120)
    records = read_log_records(spark, _written(sim.log_text()))
    exp = [tuple("" if v is None else v for v in (p, f"{c}@example.org", r and f"{r}@example.org", a, b, life)) for p, c, r, a, b, life in sim.truth(True)]
    assert _rows(I.line_lifecycle(records, include_removed_files=True)) == sorted(exp)
