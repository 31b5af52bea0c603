"""Patch-log ingest (I1-I13) as DataFrame jobs.

Input: log records (``seq``, a sortable key giving log order; ``seq_bucket``, a
coarser sortable key, non-decreasing in ``seq``, bounding how many rows one task
orders at a time; ``piece``; and either ``head``, a commit's header, or ``diff``, the text
of one file diff), or one row per commit with ``seq``, ``seq_bucket`` and ``text`` (the commit
of ``git log --patch --reverse`` without the leading ``commit ``).

Pipeline::

    records -> compact diffs -> diffs with their commit  narrow: regex + split + explode; bucketed fill-forward
    diffs -> hunks                                       narrow
    diffs -> path events -> segments -> file identity    windows in (path, bucket), pointer jumping
    hunks + identity -> replay                           sorted stream of files; hot files in segments
    replayed lines + files + bounds -> line lifecycle    joins, one-row bounds

Only the replay runs Python, on sorted Arrow batches; everything else is Catalyst
expressions, windows and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from halflife.functions.scalars import lifespan_days
from halflife.operators import parse as P
from halflife.operators.replay import replay_diffs, replay_rows
from halflife.operators.sequence import fill_forward_in_buckets
from halflife.session import release_staged, stage, staged_path

# English month abbreviations of git's default date format.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Fixed value: the pattern of an author's e-mail, inside <...> at the end of the Author line.
EMAIL_PATTERN = r"<([\w.\-_]+@[\w.\-_]+)>$"
DATE_PATTERN = r"(?m)^Date:\s+\S+\s+(\S+)\s+(\d+)\s+(\d+):(\d+):(\d+)\s+(\d+)"
ISO_DATE_PATTERN = r"^Date:\s+(\d{4})-(\d\d)-(\d\d)[ T](\d\d):(\d\d):(\d\d)"

KIND_CREATE, KIND_MODIFY, KIND_DELETE, KIND_RENAME = "C", "M", "D", "R"


def _nz(c: Column) -> Column:
    return F.when(c != "", c)


# ------------------------------------------------------------------ I1


def _header(text: Column) -> Column:
    """The commit header (sha, Author, Date, message): text before the first diff."""
    return F.substring_index(text, "\ndiff --git ", 1)


def author_of(text: Column) -> Column:
    """Lower-cased e-mail of the Author line, else the whole lower-cased text."""
    raw = F.lower(F.trim(F.regexp_extract(text, r"(?m)^Author: (.*)$", 1)))
    return F.coalesce(_nz(F.regexp_extract(raw, EMAIL_PATTERN, 1)), _nz(raw))


def commit_date_of(text: Column) -> Column:
    """The Date line's wall time, offset dropped; git's default format or ISO, else null."""
    line = F.regexp_extract(text, r"(?m)^(Date:.*)$", 1)  # one scan; the groups then read one short line
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(line, DATE_PATTERN, 1))
    parts = [F.regexp_extract(line, DATE_PATTERN, i).try_cast("int") for i in (6, 2, 3, 4, 5)]
    year, day, hour, minute, second = parts
    iso = [F.regexp_extract(line, ISO_DATE_PATTERN, i).try_cast("int") for i in range(1, 7)]
    return F.coalesce(F.try_make_timestamp_ntz(year, month.cast("int"), day, hour, minute, second), F.try_make_timestamp_ntz(*iso))


def commits(log: DataFrame) -> DataFrame:
    """Seq, seq_bucket, sha, author, committed, text, of commit rows or of the headers of log records."""
    if "head" in log.columns:
        log = log.where(F.col("head").isNotNull()).select(_commit_seq().alias("seq"), "seq_bucket", F.col("head").alias("text"))
    head = F.col("__head")
    return log.withColumn("__head", _header(F.col("text"))).select(
        "seq",
        "seq_bucket",
        F.regexp_extract(head, r"^(\S+)", 1).alias("sha"),
        author_of(head).alias("author"),
        commit_date_of(head).alias("committed"),
        "text",
    )


def _commit_seq() -> Column:
    """Log order of a header among log records."""
    return F.struct(F.col("seq.file").alias("file"), F.col("seq.block").alias("block"), F.col("seq.row").alias("row"), "piece")


def dated(diffs: DataFrame) -> DataFrame:
    """Give diffs of commits without a readable date the last date read before them in the log.

    ``date_missing`` marks them (``ingest_errors`` counts them).  At the log's head, where
    nothing precedes, the first date of the log is taken.
    """
    rows = diffs.withColumn("date_missing", F.col("committed").isNull()).withColumn("__all", F.lit(0))
    first = diffs.where(F.col("committed").isNotNull()).agg(F.min_by("committed", F.struct("seq", "dpos"))).scalar()
    filled = fill_forward_in_buckets(rows, ["__all"], ["seq", "dpos"], "committed", F.col("seq_bucket"), "__date")
    return filled.withColumn("committed", F.coalesce("__date", first)).drop("__all", "__date")


# ------------------------------------------------------------------ I2/I3/I4


# git's one-letter escapes in quoted paths, and the bytes they stand for.
ESCAPES = {"a": "07", "b": "08", "t": "09", "n": "0A", "v": "0B", "f": "0C", "r": "0D", '"': "22", "\\": "5C"}


def unquote(c: Column) -> Column:
    """A path as the log shows it -> the path: quotes, octal and one-letter escapes undone."""
    body = F.substring(c, 2, F.length(c) - 2) if isinstance(c, Column) else None
    parts = F.regexp_extract_all(body, F.lit(r"\\[0-7]{3}|\\.|[^\\]+"), F.lit(0))

    def as_hex(part: Column) -> Column:
        octal = F.lpad(F.conv(F.substring(part, 2, 3), 8, 16), 2, "0")
        letter = F.element_at(F.create_map(*[F.lit(x) for kv in ESCAPES.items() for x in kv]), F.substring(part, 2, 1))
        plain = F.hex(F.encode(part, "UTF-8"))
        return F.when(part.rlike(r"^\\[0-7]{3}$"), octal).when(part.startswith("\\"), F.coalesce(letter, plain)).otherwise(plain)

    path = F.decode(F.unhex(F.array_join(F.transform(parts, as_hex), "")), "UTF-8")
    return F.when(c.rlike(r'^".*"$'), F.when(body.contains("\\"), path).otherwise(body)).otherwise(c)


def _after_first(parts: Column) -> Column:
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def file_diffs(cm: DataFrame) -> DataFrame:
    """One row per file diff of a commit, with paths, flags and hunk texts."""
    parts = F.split(F.col("text"), r"\ndiff --git ")
    return diff_columns(cm.select("seq", "seq_bucket", "author", "committed", F.posexplode(_after_first(parts)).alias("dpos", "diff")))


QUOTED = r'"(?:[^"\\]|\\.)*"'


def diff_columns(d: DataFrame, read: bool = False) -> DataFrame:
    """Rows with a diff's text (``diff``) -> paths, kind and hunk texts instead; other columns stay.

    Path precedence: rename lines, then ---/+++ lines, then the diff line.  Quoted paths
    are unquoted wherever they stand.  With ``read``, ``odd`` tells rows that had a text (others
    are read already), and no kind is given.  Every pattern is matched once: the first text
    found for a side gives its path, and only those two are unquoted.  Short steps keep the
    generated code of each below the limit beyond which Spark would interpret it.
    """
    others = [c for c in d.columns if c != "diff"]
    diff, header, first = F.col("diff"), F.col("__header"), F.col("__first")
    d = d.select(
        *others, "diff",
        F.substring_index(diff, "\n@@ -", 1).alias("__header"),
        F.substring_index(diff, "\n", 1).alias("__first"),
    )

    def found(text: Column, pattern: str, side: str = "") -> Column:
        # The carriage return or tab that ends some header lines is no part of the path.
        raw = F.rtrim(F.regexp_extract(text, pattern, 1), F.lit("\t\r"))
        return F.struct(raw.alias("raw"), F.lit(side).alias("side"))

    same, known = found(first, r"^a/(.*) b/\1$"), diff.isNotNull()  # rows without a text cost nothing
    d = d.select(
        *others, known.alias("odd"),
        F.when(known, F.array(
            found(header, r"(?m)^--- (.*)$", "a/"), found(header, r"(?m)^rename from (.*)$"), same,
            found(first, rf"^({QUOTED}) ", "a/"), found(first, r"^a/(\S+) b/\S+$"),
        )).alias("__old"),
        F.when(known, F.array(
            found(header, r"(?m)^\+\+\+ (.*)$", "b/"), found(header, r"(?m)^rename to (.*)$"), same,
            found(first, rf" ({QUOTED})$", "b/"), found(first, r"^a/\S+ b/(\S+)$"),
        )).alias("__new"),
        header.rlike(r"(?m)^new file mode ").alias("__made"),
        header.rlike(r"(?m)^deleted file mode ").alias("__gone"),
        _after_first(F.split(diff, r"\n@@ -")).alias("hunk_texts"),
    )
    nowhere = F.lit("/dev/null")

    def chosen(side: str) -> Column:
        texts = F.col(side)
        order = F.concat(F.slice(texts, 2, 1), F.slice(texts, 1, 1), F.slice(texts, 3, 3))  # rename lines come first
        return F.get(F.filter(order, lambda x: (x["raw"] != "") & (x["raw"] != nowhere)), F.lit(0))

    clear = F.transform(F.when(F.col("odd"), F.array(chosen("__old"), chosen("__new"))), lambda x: F.struct(unquote(x["raw"]).alias("raw"), x["side"].alias("side")))
    strip = lambda x: _nz(F.when((x["side"] != "") & x["raw"].startswith(x["side"]), F.substring(x["raw"], 3, 1 << 30)).otherwise(x["raw"]))
    out = d.select(
        *others, "odd",
        F.transform(clear, strip).alias("__paths"),
        (F.col("__made") | (F.col("__old")[0]["raw"] == nowhere)).alias("is_create"),
        (F.col("__gone") | (F.col("__new")[0]["raw"] == nowhere)).alias("is_delete"),
        (F.col("__old")[1]["raw"] != "").alias("is_rename"),
        "hunk_texts",
    )
    out = out.select(*others, "odd", F.col("__paths")[0].alias("old_path"), F.col("__paths")[1].alias("new_path"), "is_create", "is_delete", "is_rename", "hunk_texts")
    return out if read else out.withColumn("kind", _kind()).drop("odd")


def _kind() -> Column:
    return (
        F.when(F.col("is_delete"), F.lit(KIND_DELETE))
        .when(F.col("is_rename"), F.lit(KIND_RENAME))
        .when(F.col("is_create"), F.lit(KIND_CREATE))
        .otherwise(F.lit(KIND_MODIFY))
    )


def carried_diffs(records: DataFrame, alias: DataFrame | None = None, key: tuple | None = None) -> DataFrame:
    """Log records -> compact diffs, each with its commit's author, date and place.

    A record holds one diff and the headers that follow it, so a commit of any size is
    never one row.  Records are read where they lie, in the order of their split
    (:mod:`halflife.operators.parse`): a diff takes its commit from the last header before it,
    and only diffs that stand before the first header of a split get theirs from a table
    of one header per split.  Records that are not in order are sorted, as before.
    """
    table = stage(_aliased(_parsed_records(records), alias), "diffs", key=key, compact=True)
    marks = table.where(F.col("mark").isNotNull())
    one = marks.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("mark").bitwiseAND(P.IN_ORDER)).alias("ordered"))
    if not one.where((F.col("n") > 1) | (F.col("ordered") == 0)).isEmpty():
        table = stage(_aliased(_sorted_records(records), alias), "diffs", key=key, compact=True, anew=True)
    return _of_commits(table)


def _aliased(diffs: DataFrame, alias: DataFrame | None) -> DataFrame:
    return diffs if alias is None else resolve_aliases(diffs, alias)


_DIFF = ("old_path", "new_path", "is_create", "is_delete", "is_rename")


def _parsed_records(records: DataFrame) -> DataFrame:
    """Diffs with the place of their commit in the split, and one row (``mark``) per split."""
    rows = records.select("seq.file", "seq.block", "seq.row", F.col("piece").cast("int").alias("piece"), "head", "diff")
    rows = compact_diffs(diff_columns(rows.mapInArrow(P.parse_records, P.SCHEMA), read=True))
    odd, head = F.col("odd"), F.col("odd_head")
    plain = lambda name: F.when(odd, F.col(name)).otherwise(F.col(f"f_{name}"))
    rows = rows.select(
        "file", "block", "row", "of_row", "of_piece",
        F.when(head.isNotNull(), author_of(head)).otherwise(F.col("f_author")).alias("author"),
        F.when(head.isNotNull(), commit_date_of(head)).otherwise(F.col("f_committed")).alias("committed"),
        *[plain(c).alias(c) for c in (*_DIFF, "hunk_ops")], "mark",
    )
    return rows.withColumn("kind", _kind())


def _sorted_records(records: DataFrame) -> DataFrame:
    """As :func:`_parsed_records`, for records in any order: commits are carried by a fill-forward in buckets."""
    head = F.col("head")
    commit = F.struct(
        _commit_seq().alias("seq"), F.col("seq_bucket").alias("bucket"), author_of(head).alias("author"), commit_date_of(head).alias("committed")
    )
    rows = records.select("seq", "seq_bucket", "piece", "diff", F.when(head.isNotNull(), commit).alias("commit"))
    rows = stage(compact_diffs(diff_columns(rows)), "log-records", compact=True)
    rows = fill_forward_in_buckets(rows, [], ["seq", "piece"], "commit", F.col("seq_bucket"), "of").where(F.col("commit").isNull())
    place = [F.col(f"seq.{c}").alias(c) for c in ("file", "block", "row")]
    of = [F.col("of.seq.file").alias("of_file"), F.col("of.seq.block").alias("of_block"), F.col("of.seq.row").alias("of_row"), F.col("of.seq.piece").alias("of_piece")]
    return rows.where(F.col("of.seq").isNotNull()).select(*place, *of, "of.author", "of.committed", *_DIFF, "hunk_ops", F.lit(None).cast("int").alias("mark"), "kind")


def _of_commits(table: DataFrame) -> DataFrame:
    """The diffs of a table of :func:`_parsed_records`, those that lead a split with the header before it."""
    bucket = F.struct("file", "block")
    diffs = table.where(F.col("mark").isNull())
    of = {c: F.col(c) for c in ("of_row", "of_piece", "author", "committed")}
    at = {c: F.col(c) for c in ("file", "block")}
    if "of_file" in table.columns:
        at = {"file": F.col("of_file"), "block": F.col("of_block")}
    elif not table.where(F.col("mark").bitwiseAND(P.LEADING) != 0).isEmpty():
        # One row per split, as in the carry of a fill-forward.
        before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        ends = table.where(F.col("mark").isNotNull()).withColumn("bucket", bucket)
        header = F.struct(*at, *of)
        ends = ends.select("bucket", F.last(F.when(F.col("of_row").isNotNull(), header), ignorenulls=True).over(before).alias("carry"))
        diffs = diffs.join(ends.where("carry is not null"), F.col("of_row").isNull() & (bucket == F.col("bucket")), "left")
        own = F.col("of_row").isNotNull()
        of = {c: F.when(own, F.col(c)).otherwise(F.col(f"carry.{c}")) for c in of}
        at = {c: F.when(own, F.col(c)).otherwise(F.col(f"carry.{c}")) for c in at}
        diffs = diffs.where(own | F.col("carry").isNotNull())
    place = [c.alias(n) for n, c in at.items()]
    return diffs.select(
        F.struct(*place, of["of_row"].alias("row"), of["of_piece"].alias("piece")).alias("seq"), F.struct(*place).alias("seq_bucket"),
        F.struct("block", "row").alias("dpos"), of["author"].alias("author"), of["committed"].alias("committed"), *_DIFF, "kind", "hunk_ops",
    )


HUNK_PATTERN = r"^(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def _hunk_ops(hunk: Column) -> Column:
    """struct(start, ops) of one hunk text.

    ``ops`` holds one character per hunk line: '+' added, '-' removed, ' '
    context (also blank lines); '\\ No newline' and other lines are skipped.
    The start is the 0-based new-side line (omitted counts mean 1); a hunk with
    no new-side lines starts after that line.
    """
    new_start = F.regexp_extract(hunk, HUNK_PATTERN, 3).try_cast("int")
    new_count = F.coalesce(_nz(F.regexp_extract(hunk, HUNK_PATTERN, 4)).try_cast("int"), F.lit(1))
    start = F.when(new_count > 0, new_start - 1).otherwise(new_start)
    # Per-line work as whole-string regex passes (no per-line lambdas):
    # blank line -> context, each line -> its first character, tab -> context,
    # then keep only '+', '-' and ' ' ('\\ No newline' and other lines drop out).
    body = F.regexp_replace(hunk, r"^[^\n]*\n?", "")  # drop the '@@ ... @@' line
    blank_as_context = F.regexp_replace(body, r"(?m)^$", " ")
    firsts = F.regexp_replace(blank_as_context, r"(?m)^(.)[^\n]*\n?", "$1")
    ops = F.regexp_replace(F.translate(firsts, "\t", " "), r"[^+\- ]", "")
    return F.struct(F.greatest(start, F.lit(0)).alias("start"), ops.alias("ops"))


def compact_diffs(diffs: DataFrame) -> DataFrame:
    """Replace hunk texts by their (start, ops) pairs: the diff table every
    later step reads, about one byte per changed line."""
    return diffs.withColumn("hunk_ops", F.transform("hunk_texts", _hunk_ops)).drop("hunk_texts")


def hunks(diffs: DataFrame) -> DataFrame:
    """One row per hunk with start, ops and line counts (input: compact diffs)."""
    if "hunk_ops" not in diffs.columns:
        diffs = compact_diffs(diffs)
    h = diffs.select(
        "seq", "seq_bucket", "dpos", "author", "committed", "kind", "old_path", "new_path",
        F.posexplode("hunk_ops").alias("hpos", "h"),
    )
    out = h.select(
        "seq", "seq_bucket", "dpos", "hpos", "author", "committed", "kind", "old_path", "new_path",
        F.col("h.start").alias("start"), F.col("h.ops").alias("ops"),
    )
    return out.withColumns(
        {
            "lines_added": (F.length("ops") - F.length(F.regexp_replace("ops", r"\+", ""))).cast("int"),
            "lines_removed": (F.length("ops") - F.length(F.regexp_replace("ops", "-", ""))).cast("int"),
        }
    )


# ------------------------------------------------------------------ I5/I6


def author_roster(cm: DataFrame) -> DataFrame:
    """Distinct lower-cased author e-mails as identity pairs (alias_from, alias_to)."""
    line = F.regexp_extract(_header(F.col("text")), r"(?m)^Author: (.*)$", 1)
    email = _nz(F.regexp_extract(F.lower(F.trim(line)), EMAIL_PATTERN, 1))
    e = cm.select(email.alias("alias_from")).where(F.col("alias_from").isNotNull()).distinct()
    return e.select("alias_from", F.col("alias_from").alias("alias_to"))


def read_alias_map(spark, path: str) -> DataFrame:
    """Two-column CSV (from, to), blanks after the comma allowed; a later
    line for the same 'from' wins."""
    raw = spark.read.csv(path, schema="alias_from STRING, alias_to STRING", ignoreLeadingWhiteSpace=True,
                         ignoreTrailingWhiteSpace=True)
    raw = raw.withColumn("__pos", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    return (
        raw.where(F.col("alias_from").isNotNull())
        .groupBy("alias_from")
        .agg(F.max_by("alias_to", "__pos").alias("alias_to"))
    )


def resolve_aliases(df: DataFrame, alias: DataFrame, col: str = "author") -> DataFrame:
    """One mapping step; unmapped names keep their own value.

    No hint: Spark broadcasts the map if its size allows, and joins by shuffle if not.
    """
    m = alias.select(F.col("alias_from").alias("__af"), F.col("alias_to").alias("__at"))
    out = df.join(m, df[col] == m["__af"], "left")
    return out.withColumn(col, F.coalesce(F.col("__at"), F.col(col))).drop("__af", "__at")


# ------------------------------------------------------------------ I7/I8


def path_events(diffs: DataFrame) -> DataFrame:
    """Each diff touches one path, a rename two: its source ends (phase 0) and
    its target starts (phase 1).  Deletes end their path (phase 0)."""
    ev = F.when(
        F.col("kind") == KIND_RENAME,
        F.array(
            F.struct(F.col("old_path").alias("path"), F.lit(0).alias("phase"), F.lit("RO").alias("ev"), F.lit(False).alias("primary")),
            F.struct(F.col("new_path").alias("path"), F.lit(1).alias("phase"), F.lit("RI").alias("ev"), F.lit(True).alias("primary")),
        ),
    ).otherwise(
        F.array(
            F.when(
                F.col("kind") == KIND_DELETE,
                F.struct(F.col("old_path").alias("path"), F.lit(0).alias("phase"), F.lit("D").alias("ev"), F.lit(True).alias("primary")),
            ).otherwise(
                F.struct(F.col("new_path").alias("path"), F.lit(1).alias("phase"), F.col("kind").alias("ev"), F.lit(True).alias("primary"))
            )
        )
    )
    hunk_ops = [c for c in diffs.columns if c == "hunk_ops"]  # they stay with the event that tells the diff's file
    e = diffs.select("seq", "seq_bucket", "dpos", "author", "committed", *hunk_ops, F.explode(ev).alias("e"))
    hunk_ops = [F.when(F.col("e.primary"), F.col(c)).alias(c) for c in hunk_ops]
    return e.select("seq", "seq_bucket", "dpos", "author", "committed", "e.path", "e.phase", "e.ev", "e.primary", *hunk_ops).where(
        F.col("path").isNotNull()
    )


def _resolve_roots(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Pointer jumping: (seg, parent) -> (seg, root), for segments that have a parent.

    Only renamed segments take part; a segment without a parent is its own root.
    Each round doubles the distance an open link spans and closes those that arrived;
    its links are written, so lineage is cut every round.  A log whose chains are longer
    than 2^max_rounds renames is refused.
    """
    open_ = links.where(F.col("parent").isNotNull()).select("seg", F.col("parent").alias("anc"))
    open_, closed = stage(open_, "links", compact=True), []
    for _ in range(max_rounds):
        if open_.isEmpty():
            break
        further = open_.select(F.col("seg").alias("b_seg"), F.col("anc").alias("b_anc"))
        # A parent that is no open link itself is a root, or was closed with its root in a round before.
        known = None
        for c in closed:
            known = c if known is None else known.unionByName(c)
        step = open_.join(further, open_["anc"] == further["b_seg"], "left")
        if known is not None:
            known = known.select(F.col("seg").alias("k_seg"), F.col("root").alias("k_root"))
            step = step.join(known, F.col("anc") == F.col("k_seg"), "left")
        else:
            step = step.withColumn("k_root", F.lit(None).cast(links.schema["seg"].dataType))
        step = stage(step.select("seg", F.coalesce("b_anc", "k_root", "anc").alias("anc"), F.col("b_seg").isNull().alias("done")), "links", compact=True)
        closed.append(step.where("done").select("seg", F.col("anc").alias("root")))
        open_ = step.where("not done").select("seg", "anc")
    else:
        if not open_.isEmpty():
            raise ValueError(f"rename chains are not resolved after {max_rounds} rounds of doubling")
    out = closed[0] if closed else links.limit(0).select("seg", F.col("seg").alias("root"))
    for c in closed[1:]:
        out = out.unionByName(c)
    return out


_ENDS = ("D", "RO")


def _begins(ev: Column, prev: Column, prev_known: Column) -> Column:
    """A segment begins at a create/modify of a vacant path, or at a rename target."""
    vacant = prev_known & (prev.isNull() | prev.isin(*_ENDS))
    return (ev.isin(KIND_CREATE, KIND_MODIFY) & vacant) | (ev == "RI")


# Path events in a slice of the log: what one task may have to put in order for one path.
SLICE_EVENTS = 5_000_000


def _sliced(ev: DataFrame) -> tuple[DataFrame, bool]:
    """Add ``__slice``, neighbouring ordering buckets with about ``SLICE_EVENTS`` events together; are there several?

    A path has events in few slices, however small the buckets are; one that is hot all the
    time is spread over all slices.
    """
    per = ev.groupBy("seq_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("seq_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per input split
    per = per.select(F.col("seq_bucket").alias("__bucket"), F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / SLICE_EVENTS).alias("__slice"))
    per = stage(per, "log-slices", compact=True)
    splits, last = per.agg(F.count(F.lit(1)), F.max("__slice")).first()
    if not last:
        return ev.withColumn("__slice", F.lit(0).cast("bigint")), False
    # One short row per input split, counted just now: small unless there are very many.
    per = F.broadcast(per) if splits <= 100_000 else per
    return ev.join(per, F.col("seq_bucket") == F.col("__bucket")).drop("__bucket"), True


def _segment_starts(ev: DataFrame, several: bool = True) -> DataFrame:
    """Per path, in log order: is the path vacant before each event, does the
    event begin a segment, and which event began the current segment (``seg``).

    One pass per (path, slice): a window gives each row its predecessor inside the
    slice; if there are ``several``, a one-row-per-slice table carries, across
    slices, the last event kind and the last segment begin; a second window on
    the same partitioning takes the running last begin.  Same result as the
    plain lag + running ``last(ignorenulls)`` over the whole path.

    A segment is known by the diff that begins it: a diff begins one at most.
    """
    order = [F.col("seq").asc(), F.col("phase").asc(), F.col("dpos").asc()]
    rank, diff = F.struct("seq", "phase", "dpos"), F.struct("seq", "dpos")
    w = Window.partitionBy("path", "__slice").orderBy(*order)
    rows, prev = ev.withColumn("__prev_local", F.lag("ev").over(w)), F.col("__prev_local")
    carried = []
    if several:
        rows = rows.withColumn("__first", F.row_number().over(w) == 1)
        # begin flags of all rows but a slice's first (their predecessor is local)
        rows = rows.withColumn("__lb", F.when(_begins(F.col("ev"), prev, ~F.col("__first")) & ~F.col("__first"), diff))
        per = rows.groupBy("path", "__slice").agg(
            F.max_by("ev", rank).alias("__last_ev"),
            F.min_by("ev", rank).alias("__first_ev"),
            F.min_by(diff, rank).alias("__first_diff"),
            F.max("__lb").alias("__last_lb"),
        )
        wb = Window.partitionBy("path").orderBy("__slice")
        per = per.withColumn("__prev_ev", F.lag("__last_ev").over(wb))
        first_begins = _begins(F.col("__first_ev"), F.col("__prev_ev"), F.lit(True))
        start = F.coalesce(F.col("__last_lb"), F.when(first_begins, F.col("__first_diff")))
        per = per.withColumn("__carry", F.last(start, ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, -1)))
        rows = rows.join(per.select("path", "__slice", "__prev_ev", "__carry"), ["path", "__slice"], "left")
        prev = F.when(F.col("__first"), F.col("__prev_ev")).otherwise(prev)
        carried = [F.col("__carry")]
    rows = rows.withColumn("prev_ev", prev)
    begin = _begins(F.col("ev"), F.col("prev_ev"), F.lit(True))
    rows = rows.withColumn("valid", ~(F.col("ev").isin(*_ENDS) & (F.col("prev_ev").isNull() | F.col("prev_ev").isin(*_ENDS))))
    rows = rows.withColumn("begins", F.coalesce(begin, F.lit(False)))
    run = F.last(F.when(F.col("begins"), diff), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("seg", F.coalesce(run, *carried)).withColumn("seg", F.when(F.col("valid"), F.col("seg")))
    hunk_ops = [c for c in ev.columns if c == "hunk_ops"]
    path = F.when(F.col("begins"), F.col("path")).alias("path")  # a segment has one path
    return rows.select("seq", "seq_bucket", "dpos", "author", "committed", path, "ev", "primary", "valid", "begins", "seg", *hunk_ops)


def _leaves(c: Column, kind) -> list[Column]:
    return [x for f in kind.fields for x in _leaves(c[f.name], f.dataType)] if isinstance(kind, StructType) else [c.cast("string")]


def _file_id(root: str, table: DataFrame) -> Column:
    """The name of the file whose first segment is ``root``: the place of the diff that began it."""
    return F.concat_ws("/", *_leaves(F.col(root), table.schema["seg"].dataType))


def file_identity(diffs: DataFrame, key: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """Give every diff the file it applies to; list the files.

    A path holds a sequence of segments; a segment starts at a create or
    modify of a vacant path, or at a rename target, and ends at a delete or
    rename source.  A rename target's segment continues the source's file.
    Returns ``(diff_files, files)``:

    * diff_files: seq, seq_bucket, dpos, file_id (and hunks, if ``diffs`` has them compact) for every
      diff that applies to a file (deletes/renames of vacant paths are ignored),
    * files: file_id, path (latest), added, removed (delete time or null).

    With ``key`` (the state of the log) segments and files are written once and read by every later call.
    """
    spark = diffs.sparkSession
    if key is not None and (done := staged_path(spark, "path-segments", key)):
        ev = spark.read.parquet(done)
    else:
        ev = stage(_segment_starts(*_sliced(path_events(diffs))), "path-segments", key=key, compact=True)
    if key is not None and (done := staged_path(spark, "roots", key)):
        roots = spark.read.parquet(done)
    else:
        ro = ev.where((F.col("ev") == "RO") & F.col("valid")).select(
            F.col("seq").alias("r_seq"), F.col("dpos").alias("r_dpos"), F.col("seg").alias("parent")
        )
        into = ev.where(F.col("begins") & (F.col("ev") == "RI"))
        links = into.join(ro, (into["seq"] == ro["r_seq"]) & (into["dpos"] == ro["r_dpos"])).select("seg", "parent")
        roots = stage(_resolve_roots(links), "roots", key=key, compact=True)
        release_staged(spark, "links")
    rooted = lambda rows: rows.join(roots, "seg", "left").withColumn("root", F.coalesce("root", "seg"))
    if key is not None and (done := staged_path(spark, "files", key)):
        files = spark.read.parquet(done)
    else:
        gone = (F.col("ev") == "D") & F.col("valid")
        ends = rooted(ev.where(F.col("begins") | gone).select("seg", "path", "committed", "begins"))
        files = ends.groupBy("root").agg(
            F.max_by("path", F.when(F.col("begins"), F.col("seg"))).alias("path"),
            F.max(F.when(F.col("begins") & (F.col("seg") == F.col("root")), F.col("committed"))).alias("added"),
            F.max(F.when(~F.col("begins"), F.col("committed"))).alias("removed"),
        )
        files = stage(files.select(_file_id("root", ev).alias("file_id"), "path", "added", "removed"), "files", key=key, compact=True)
    diff_files = rooted(ev.where(F.col("primary") & F.col("valid"))).withColumn("file_id", _file_id("root", ev))
    return diff_files.select("seq", "seq_bucket", "dpos", "ev", "author", "committed", "file_id", *[c for c in ev.columns if c == "hunk_ops"]), files


# ------------------------------------------------------------------ I9/I10


def replay_lines(hk: DataFrame, diff_files: DataFrame, partitions: int | None = None, split_above: int = 200_000) -> DataFrame:
    """The lines of all files, from hunks and delete markers.

    A valid delete closes every line still alive (binary and empty deletes
    included), after the hunks of its own diff.  Files are replayed in parallel, in as many
    partitions as their size asks for (AQE), or ``partitions``; one with more than
    ``split_above`` hunks in segments of its history (:mod:`halflife.operators.replay`).
    """
    h = hk.join(diff_files.select("seq", "dpos", "file_id"), ["seq", "dpos"]).select(
        "file_id", "seq_bucket", "seq", "dpos", F.lit(False).alias("closes"), "hpos", "author", "committed", "start", "ops",
    )
    closes = diff_files.where(F.col("ev") == "D").select(
        "file_id", "seq_bucket", "seq", "dpos", F.lit(True).alias("closes"), F.lit(0).alias("hpos"),
        "author", "committed", F.lit(0).alias("start"), F.lit("").alias("ops"),
    )
    return replay_rows(h.unionByName(closes), partitions, split_above)


# ------------------------------------------------------------------ I11-I13


def history_bounds(diffs: DataFrame, files: DataFrame) -> DataFrame:
    """One row (start, last_change).  Start is the first file creation;
    every diff but a pure rename moves the last change."""
    n_hunks = F.size("hunk_ops") if "hunk_ops" in diffs.columns else F.size("hunk_texts")
    last = diffs.where((F.col("kind") != KIND_RENAME) | (n_hunks > 0)).agg(F.max("committed").alias("last_change"))
    start = files.agg(F.min("added")).scalar()
    return last.select(start.alias("start"), "last_change")


def parse_log(log: DataFrame, alias: DataFrame | None = None, key: tuple | None = None) -> DataFrame:
    """I1-I5 once: commits -> aliased authors -> dated diffs with compact hunks,
    written as parquet under the checkpoint dir.  Every later step (identity,
    bounds, replay, reports) reads this lineage-free table.  ``key`` names the log
    (and the alias map): a table already written for it is read again."""
    spark = log.sparkSession
    if key is not None and (path := staged_path(spark, "diffs", key)):
        diffs = spark.read.parquet(path)
        diffs = _of_commits(diffs) if "mark" in diffs.columns else diffs
    elif "head" in log.columns:
        diffs = carried_diffs(log, alias, key)
    else:
        diffs = stage(_aliased(compact_diffs(file_diffs(commits(log))), alias), "diffs", key=key, compact=True)
    # A second pass only if some date could not be read.
    if diffs.where(F.col("committed").isNull()).isEmpty():
        return diffs.withColumn("date_missing", F.lit(False))
    return stage(dated(diffs), "dated-diffs", key=key)


def _replayed(diffs: DataFrame, key: tuple | None, split_above: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(replay rows with their file's path and removal, files), written once per ``key``."""
    diffs = diffs if "hunk_ops" in diffs.columns else compact_diffs(diffs)
    diff_files, files = file_identity(diffs, key)
    spark = diffs.sparkSession
    if key is not None and (path := staged_path(spark, "replay", key)):
        return spark.read.parquet(path), files
    rows = replay_diffs(diff_files.withColumn("closes", F.col("ev") == "D"), files, split_above=split_above)
    return stage(rows, "replay", key=key, compact=True), files


def ingest_errors(diffs: DataFrame, key: tuple | None = None) -> DataFrame:
    """What the ingest could not use, by kind: (kind, path, n).

    ``replay`` lines a hunk removes or shows where the file has none (by file),
    ``date`` diffs whose commit has no readable date, ``path`` diffs without a path.
    """
    rows, _ = _replayed(diffs, key)
    replay = rows.where(F.col("replay_errors").isNotNull())
    replay = replay.groupBy("path", "file_id").agg(F.sum("replay_errors").cast("bigint").alias("n"))
    path = F.when(F.col("kind") == KIND_DELETE, F.col("old_path")).otherwise(F.col("new_path"))
    counted = [replay.select(F.lit("replay").alias("kind"), "path", "n")]
    for kind, bad in (("date", F.col("date_missing")), ("path", path.isNull())):
        some = diffs.where(bad).groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"))
        counted.append(some.select(F.lit(kind).alias("kind"), "path", "n"))
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def line_lifecycle(
    log: DataFrame,
    alias: DataFrame | None = None,
    include_removed_files: bool = False,
    with_file_columns: bool = False,
    key: tuple | None = None,
    split_above: int = 200_000,
) -> DataFrame:
    """Commit log -> one row per code line ever written:
    path, creator, remover, created, removed, lifespan (+ file_id, file_removed,
    is_removed and the file's replay_errors with ``with_file_columns``).  Lines of
    deleted files are left out unless ``include_removed_files``.

    The replay is written once and read by every report; with ``key`` (the state of
    the log) it is shared by all calls of an application.  Files with more than ``split_above``
    hunks are replayed in segments."""
    return lifecycle_of(parse_log(log, alias, key), include_removed_files, with_file_columns, key, split_above)


def lifecycle_of(
    diffs: DataFrame,
    include_removed_files: bool = False,
    with_file_columns: bool = False,
    key: tuple | None = None,
    split_above: int = 200_000,
) -> DataFrame:
    """:func:`line_lifecycle` of a log that is parsed."""
    rows, files = _replayed(diffs, key, split_above)
    errors = rows.where(F.col("replay_errors").isNotNull()).groupBy("file_id").agg(F.sum("replay_errors").cast("int").alias("replay_errors"))
    lines = rows.where(F.col("replay_errors").isNull()).drop("replay_errors")
    last_day = history_bounds(diffs, files).select(
        (F.col("last_change") + F.expr("INTERVAL 1 DAY")).alias("last_day")
    ).scalar()
    out = lines if include_removed_files else lines.where(F.col("file_removed").isNull())
    out = out.withColumn("lifespan", lifespan_days("created", "removed", last_day))
    cols = ["path", "creator", "remover", "created", "removed", "lifespan"]
    if with_file_columns:
        out = out.join(errors, "file_id", "left").withColumn("replay_errors", F.coalesce("replay_errors", F.lit(0)))
        cols += ["file_id", "file_removed", "is_removed", "replay_errors"]
    return out.select(*cols)
