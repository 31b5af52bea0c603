"""I1-I4 over log records as one stream: headers, paths and hunks read line by line.

A partition of log records is read in log order; a diff takes its commit from the last
header before it in its bucket (an input split), so nothing is sorted or exchanged.  One
row per bucket (``mark``) tells which header it ends with and whether its records came
in order; whoever reads the rows carries headers over to buckets that begin with diffs of an
earlier commit.

Texts that are not plain (line ends other than ``\\n``, dates in another format, names that
need more than ASCII rules, oversized numbers) go out as they are (``odd``, ``odd_head``): the
expressions of :mod:`halflife.operators.ingest`, which define the parse, read those.
"""

from __future__ import annotations

import datetime as _dt
import re
from collections.abc import Iterator

import pyarrow as pa

OPS = pa.struct([("start", pa.int32()), ("ops", pa.string())])
_TIME = pa.timestamp("us")
SCHEMA = (
    "file BIGINT, block BIGINT, row BIGINT, of_row BIGINT, of_piece INT, f_author STRING, f_committed TIMESTAMP_NTZ, odd_head STRING, "
    "f_old_path STRING, f_new_path STRING, f_is_create BOOLEAN, f_is_delete BOOLEAN, f_is_rename BOOLEAN, "
    "f_hunk_ops ARRAY<STRUCT<start: INT, ops: STRING>>, diff STRING, mark INT"
)
# What a bucket's row says (``mark``, a sum): its records came in order; it begins with diffs of an earlier commit.
IN_ORDER, LEADING = 1, 2

_MONTHS = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}
_EMAIL = re.compile(r"<([\w.\-_]+@[\w.\-_]+)>$", re.ASCII)
_DATE = re.compile(r"Date:[ \t]+[^\s]+[ \t]+(\S+)[ \t]+(\d{1,2})[ \t]+(\d{1,2}):(\d{1,2}):(\d{1,2})[ \t]+(\d{4})(?!\d)", re.ASCII)
_HUNK = re.compile(r"(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", re.ASCII)
_SAME = re.compile(r"a/(.*) b/\1$")
_QUOTED_OLD = re.compile(r'("(?:[^"\\]|\\.)*") ')
_QUOTED_NEW = re.compile(r' ("(?:[^"\\]|\\.)*")$')
_OLD = re.compile(r"a/([^\s]+) b/[^\s]+$", re.ASCII)
_NEW = re.compile(r"a/[^\s]+ b/([^\s]+)$", re.ASCII)
_PARTS = re.compile(r"\\[0-7]{3}|\\.|[^\\]+")
_ESCAPES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "\\": 92}
_EPOCH = _dt.date(1970, 1, 1).toordinal()
KEPT = 50_000  # parsed dates, folders and hunk headers that are remembered


class Odd(Exception):
    """A text that the plain rules do not cover."""


def _plain(text: str) -> bool:
    """No line ends but ``\\n``: what else ends a line for the expressions is rare."""
    return "\r" not in text and (text.isascii() or not any(c in text for c in "\x85\u2028\u2029"))


def head_of(text: str, dates: dict) -> tuple[str | None, int | None, str | None]:
    """Commit header -> (author, time in microseconds, None), or the text to be read otherwise."""
    if not _plain(text):
        return None, None, text
    author = date = None
    for line in text.split("\n"):
        if author is None and line.startswith("Author: "):
            author = line[8:]
        elif date is None and line.startswith("Date:"):
            date = line
        else:
            continue
        if author is not None and date is not None:
            break
    rest = "\n".join(x for x in (None if author is None else f"Author: {author}", date) if x is not None)
    if author is None or date is None:
        return None, None, rest
    who = author.strip(" ").lower()
    found = _EMAIL.search(who)
    if found:
        who = found[1]
    elif not who or not who.isascii():
        return None, None, rest
    when = dates.get(date)
    if when is None:
        m = _DATE.match(date)
        if m is None or m[1] not in _MONTHS or not date.isascii():
            return None, None, rest
        h, mi, s = int(m[3]), int(m[4]), int(m[5])
        try:
            day = _dt.date(int(m[6]), _MONTHS[m[1]], int(m[2])).toordinal() - _EPOCH
        except ValueError:
            return None, None, rest
        if h > 23 or mi > 59 or s > 59:
            return None, None, rest
        when = (day * 86400 + h * 3600 + mi * 60 + s) * 1_000_000
        if len(dates) >= KEPT:
            dates.clear()
        dates[date] = when
    return who, when, None


def _unescaped(text: str) -> str:
    out = bytearray()
    for part in _PARTS.findall(text):
        if part[0] != "\\":
            out += part.encode()
        elif len(part) == 4:
            n = int(part[1:], 8)
            if n > 255:
                raise Odd
            out.append(n)
        elif part[1] in _ESCAPES:
            out.append(_ESCAPES[part[1]])
        else:
            out += part.encode()
    try:
        return out.decode()
    except UnicodeDecodeError:
        raise Odd from None


def path_of(raw: str, side: str, folders: dict) -> str | None:
    """A path as the log shows it -> the path."""
    if raw[0] == '"' and raw[-1] == '"' and len(raw) > 1:
        raw = raw[1:-1]
        if "\\" in raw:
            at = raw.rfind("/") + 1
            folder, name = raw[:at], raw[at:]
            known = folders.get(folder)
            if known is None:
                known = _unescaped(folder)
                if len(folders) >= KEPT:
                    folders.clear()
                folders[folder] = known
            raw = known + (_unescaped(name) if "\\" in name else name)
    if side and raw.startswith(side):
        raw = raw[2:]
    return raw or None


def _first_line(first: str, new: bool) -> tuple[str, str]:
    """The path that the diff line itself gives, and its side."""
    m = _SAME.match(first)
    if m and (raw := m[1].rstrip("\t")) and raw != "/dev/null":
        return raw, ""
    m = _QUOTED_NEW.search(first) if new else _QUOTED_OLD.match(first)
    if m:
        return m[1], "b/" if new else "a/"
    m = (_NEW if new else _OLD).match(first)
    if m and (raw := m[1].rstrip("\t")) and raw != "/dev/null":
        return raw, ""
    return "", ""


def hunk_of(text: str, starts: dict) -> tuple[int, str]:
    """(start, ops) of a hunk's text."""
    lines = text.split("\n")
    first = lines[0]
    start = starts.get(first)
    if start is None:
        m = _HUNK.match(first)
        if m is None:
            start = 0
        else:
            if len(m[3]) > 9 or len(m[4] or "") > 9:
                raise Odd
            start = int(m[3])
            if m[4] is None or int(m[4]) > 0:
                start = max(0, start - 1)
        if len(starts) >= KEPT:
            starts.clear()
        starts[first] = start
    if lines[-1] == "" and len(lines) > 1:
        lines.pop()
    del lines[0]
    ops = "".join([x[0] if x else " " for x in lines])
    if ops.strip("+- "):
        ops = "".join([c for c in ops.replace("\t", " ") if c in "+- "])
    return start, ops


def diff_of(text: str, folders: dict, starts: dict) -> tuple:
    """A file diff -> (old path, new path, is_create, is_delete, is_rename, hunks as (start, ops))."""
    if not _plain(text):
        raise Odd
    hunks = text.split("\n@@ -")
    lines = hunks[0].split("\n")
    minus = plus = old = new = None
    made = gone = False
    for line in lines:
        c = line[:4]
        if c == "--- ":
            if minus is None:
                minus = line[4:].rstrip("\t")
        elif c == "+++ ":
            if plus is None:
                plus = line[4:].rstrip("\t")
        elif c == "rena":
            if old is None and line.startswith("rename from "):
                old = line[12:].rstrip("\t")
            elif new is None and line.startswith("rename to "):
                new = line[10:].rstrip("\t")
        elif c == "new ":
            made = made or line.startswith("new file mode ")
        elif c == "dele":
            gone = gone or line.startswith("deleted file mode ")
    made, gone = made or minus == "/dev/null", gone or plus == "/dev/null"
    if old and old != "/dev/null":
        a, side_a = old, ""
    elif minus and minus != "/dev/null":
        a, side_a = minus, "a/"
    else:
        a, side_a = _first_line(lines[0], False)
    if new and new != "/dev/null":
        b, side_b = new, ""
    elif plus and plus != "/dev/null":
        b, side_b = plus, "b/"
    else:
        b, side_b = _first_line(lines[0], True)
    return (
        path_of(a, side_a, folders) if a else None, path_of(b, side_b, folders) if b else None,
        made, gone, bool(old), [hunk_of(h, starts) for h in hunks[1:]],
    )


class _Rows:
    """Columns of rows on their way out."""

    def __init__(self):
        self.place, self.of, self.commit, self.paths, self.hunks, self.n_hunks, self.odd, self.mark = [], [], [], [], [], [], [], []

    def add(self, place, of, commit, paths=(None,) * 5, hunks=None, odd=None, mark=None) -> None:
        self.place.append(place)
        self.of.append(of)
        self.commit.append(commit)
        self.paths.append(paths)
        self.n_hunks.append(-1 if hunks is None else len(hunks))
        if hunks:
            self.hunks += hunks
        self.odd.append(odd)
        self.mark.append(mark)

    def batch(self) -> pa.RecordBatch:
        at, offsets = 0, []
        for n in self.n_hunks:
            offsets.append(None if n < 0 else at)  # a null offset is a null list
            at += max(n, 0)
        offsets.append(at)
        starts, ops = zip(*self.hunks) if self.hunks else ((), ())
        hunks = pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ops, pa.string())], fields=list(OPS))
        )
        file, block, row = zip(*self.place)
        of_row, of_piece = zip(*self.of)
        author, when, odd_head = zip(*self.commit)
        old, new, made, gone, renamed = zip(*self.paths)
        columns = {
            "file": pa.array(file, pa.int64()), "block": pa.array(block, pa.int64()), "row": pa.array(row, pa.int64()),
            "of_row": pa.array(of_row, pa.int64()), "of_piece": pa.array(of_piece, pa.int32()),
            "f_author": pa.array(author, pa.string()), "f_committed": pa.array(when, pa.int64()).cast(_TIME), "odd_head": pa.array(odd_head, pa.string()),
            "f_old_path": pa.array(old, pa.string()), "f_new_path": pa.array(new, pa.string()),
            "f_is_create": pa.array(made, pa.bool_()), "f_is_delete": pa.array(gone, pa.bool_()), "f_is_rename": pa.array(renamed, pa.bool_()),
            "f_hunk_ops": hunks, "diff": pa.array(self.odd, pa.string()), "mark": pa.array(self.mark, pa.int32()),
        }
        self.__init__()
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


_NO_COMMIT = (None, None, None)


def parse_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (file, block, row, piece, head, diff) in log order -> diffs with their commit, and the buckets' rows."""
    dates, folders, starts, out = {}, {}, {}, _Rows()
    at = last = None
    first, of, commit, ok, leading = 0, (None, None), _NO_COMMIT, True, False

    def bucket_ends() -> None:
        out.add((*at, first), of, commit, mark=IN_ORDER * ok + LEADING * leading)

    for batch in batches:
        for file, block, row, piece, head, diff in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "row", "piece", "head", "diff"))):
            if (file, block) != at:
                if at is not None:
                    bucket_ends()
                at, first, last, of, commit, ok, leading = (file, block), row, None, (None, None), _NO_COMMIT, True, False
            if last is not None and (row, piece) <= last:
                ok = False
            last = (row, piece)
            if head is not None:
                of, commit = (row, piece), head_of(head, dates)
                continue
            leading = leading or of[0] is None
            if diff is None:
                out.add((file, block, row), of, commit)
                continue
            try:
                *paths, hunks = diff_of(diff, folders, starts)
            except Odd:
                out.add((file, block, row), of, commit, odd=diff)
            else:
                out.add((file, block, row), of, commit, paths, hunks)
        if len(out.place):
            yield out.batch()
    if at is not None:
        bucket_ends()
        yield out.batch()
