"""Line replay - which line was written and removed by which hunk.

Two paths give the same rows:

* **Many files.**  Hunks are hash-partitioned by file and sorted by (file, log order).  One
  ``mapInArrow`` pass reads a partition as a stream and sees the file boundaries
  itself, so a file costs no call, frame or batch of its own.  A file is a flat list of
  hunk numbers; a hunk is one slice assignment in it.
* **Hot files.**  The history of a file with more hunks than ``split_above`` is cut into
  *segments*, its hunks of one ordering bucket (an input split of the log), and
  the segments are replayed side by side.  A segment starts from the lines that are
  alive before it, known by their places only; how many they are follows from sums of
  lines added and removed.  Its result is a *position map*: which of those lines it
  removed, and what the file looks like after it, as runs of old places and of new
  lines.  Maps of neighbouring segments are composed pairwise, in as many rounds as
  doubling takes; composing gives the fate of all lines that were written in the
  left one and removed in the right one.  A map is never larger than the lines alive
  at the segment's ends.

The sums hold if every removal finds its line.  They are proven for each segment (the
least length its hunks need against the length it starts with); a hot file that
fails, a faulty log, is replayed as one stream like any other file.

Only plain tables are exchanged: lost executors recompute from the written hunk table
and from each round's written maps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halflife.session import stage

SCHEMA = (
    "file_id STRING, creator STRING, created TIMESTAMP_NTZ, remover STRING, removed TIMESTAMP_NTZ, "
    "is_removed BOOLEAN, replay_errors INT"
)
_TIME = pa.timestamp("us")
_ARROW = pa.schema(
    [("file_id", pa.string()), ("creator", pa.string()), ("created", _TIME), ("remover", pa.string()), ("removed", _TIME),
     ("is_removed", pa.bool_()), ("replay_errors", pa.int32())]
)
# A segment's row also has its number and its position map; lines have neither.
MAP_SCHEMA = SCHEMA + ", seg BIGINT, layout BINARY, lost BINARY"
_MAP_ARROW = pa.schema([*_ARROW, ("seg", pa.int64()), ("layout", pa.binary()), ("lost", pa.binary())])
FLUSH_ROWS = 50_000

_RUNS = re.compile(r"\++|-+| +")


# ---------------------------------------------------------------- one hunk


def apply_hunk(live: list, start: int, ops: str, mark, gone: list) -> int:
    """Apply a hunk to the lines of a file: ``mark`` is put in for each line added, lines
    removed are appended to ``gone``.  Returns how many removals and context lines found no line.
    """
    n = len(live)
    at = start if start < n else n
    body = ops.strip(" ")
    if not body:
        return max(0, at + len(ops) - n)
    lead = len(ops) - len(ops.lstrip(" "))
    errors = max(0, at + lead - n)
    at = min(at + lead, n)
    for run in (body,) if " " not in body else _RUNS.findall(body):
        # Between context lines the order of '+' and '-' does not matter: new lines stand
        # where the removed ones stood.
        minus = run.count("-")
        if run[0] == " ":
            errors += max(0, at + len(run) - len(live))
            at = min(at + len(run), len(live))
            continue
        plus = len(run) - minus
        if minus:
            taken = live[at : at + minus]
            errors += minus - len(taken)
            gone += taken
        live[at : at + minus] = [mark] * plus
        at += plus
    trail = len(ops) - lead - len(body)
    return errors + max(0, at + trail - len(live))


class LongLines:
    """A long file as :func:`apply_hunk` sees it: a list whose edits move no more than a chunk.

    Lines lie in chunks, chunks in blocks.  Lines from before that were never touched
    are ranges of their places, however many they are.
    """

    CHUNK, BLOCK = 1024, 256

    def __init__(self, before: int):
        self.n, self.sizes, self.blocks = before, [before], [[range(-1, -before - 1, -1)] if before else []]

    def __len__(self) -> int:
        return self.n

    def _find(self, at: int) -> tuple[int, int, int]:
        """(block, chunk, place in it) of a line, or of the end."""
        sizes = self.sizes
        if at < self.n - at:
            b = 0
            while at >= sizes[b] and b + 1 < len(sizes):
                at -= sizes[b]
                b += 1
        else:
            left, b = self.n - at, len(sizes) - 1  # lines from here to the end
            while left > sizes[b]:
                left -= sizes[b]
                b -= 1
            at = sizes[b] - left
        chunks, size = self.blocks[b], sizes[b]
        if at < size - at:
            c = 0
            while at >= len(chunks[c]) and c + 1 < len(chunks):
                at -= len(chunks[c])
                c += 1
            return b, c, at
        left, c = size - at, len(chunks) - 1
        while c > 0 and left > len(chunks[c]):
            left -= len(chunks[c])
            c -= 1
        return b, c, len(chunks[c]) - left if chunks else 0

    def __getitem__(self, part: slice) -> list:
        start, stop, _ = part.indices(self.n)
        out: list = []
        if start < stop:
            b, c, at = self._find(start)
            while len(out) < stop - start:
                if c == len(self.blocks[b]):
                    b, c = b + 1, 0
                    continue
                out += self.blocks[b][c][at : at + stop - start - len(out)]
                c, at = c + 1, 0
        return out

    def __setitem__(self, part: slice, new: list) -> None:
        start, stop, _ = part.indices(self.n)
        self._remove(start, stop - start)
        if new:
            self._insert(start, new)

    def _remove(self, start: int, k: int) -> None:
        while k > 0:
            b, c, at = self._find(start)
            chunks = self.blocks[b]
            chunk = chunks[c]
            m = min(k, len(chunk) - at)
            if isinstance(chunk, list) and m < len(chunk):
                del chunk[at : at + m]
            else:
                chunks[c : c + 1] = [x for x in (chunk[:at], chunk[at + m :]) if len(x)]
            self.sizes[b] -= m
            self.n -= m
            k -= m
            if not chunks and len(self.blocks) > 1:
                del self.blocks[b], self.sizes[b]

    def _insert(self, start: int, new: list) -> None:
        b, c, at = self._find(start)
        chunks = self.blocks[b]
        self.sizes[b] += len(new)
        self.n += len(new)
        if not chunks:
            chunks.append(list(new))
        elif isinstance(chunks[c], list):
            chunks[c][at:at] = new
        elif at == 0 and c > 0 and isinstance(chunks[c - 1], list):
            c -= 1
            chunks[c] += new
        else:
            old = chunks[c]
            chunks[c : c + 1] = [x for x in (old[:at], list(new), old[at:]) if len(x)]
            c += at > 0
        chunk = chunks[c]
        if len(chunk) > 2 * self.CHUNK:
            chunks[c : c + 1] = [chunk[i : i + self.CHUNK] for i in range(0, len(chunk), self.CHUNK)]
        if len(chunks) > 2 * self.BLOCK:
            cut = [chunks[i : i + self.BLOCK] for i in range(0, len(chunks), self.BLOCK)]
            self.blocks[b : b + 1] = cut
            self.sizes[b : b + 1] = [sum(map(len, x)) for x in cut]

    def __iter__(self):
        return (x for chunks in self.blocks for chunk in chunks for x in chunk)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(code of the first line, number of lines) of pieces of the file, in order."""
        codes, sizes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for chunks in self.blocks:
            for chunk in chunks:
                one = isinstance(chunk, range)
                codes.append(np.asarray([chunk[0]] if one else chunk, dtype=np.int64))
                sizes.append(np.asarray([len(chunk)], dtype=np.int64) if one else np.ones(len(chunk), dtype=np.int64))
        return np.concatenate(codes), np.concatenate(sizes)


# ---------------------------------------------------------------- a sorted stream of hunks


class _Lines:
    """Rows on their way out: numbers of the hunks that wrote and removed each line."""

    def __init__(self):
        self.files, self.counts, self.made, self.gone, self.size = [], [], [], [], 0

    def add(self, file_id: str, made, gone: int | list | None) -> None:
        """Lines written by ``made``, removed by ``gone`` (None: alive)."""
        n = len(made)
        if n:
            self.files.append(file_id)
            self.counts.append(n)
            self.made.append(np.asarray(made, dtype=np.int64))
            self.gone.append(np.full(n, -1) if gone is None else np.asarray(gone, dtype=np.int64))
            self.size += n

    def batch(self, authors: pa.Array, times: pa.Array) -> pa.Table:
        made, gone = np.concatenate(self.made), np.concatenate(self.gone)
        files = pa.array(self.files, pa.string()).take(pa.array(np.repeat(np.arange(len(self.files)), self.counts)))
        by = pa.array(gone, mask=gone < 0)
        text = lambda x: x.cast(pa.string())  # noqa: E731  authors may be numbered
        out = [files, text(authors.take(pa.array(made))), times.take(pa.array(made)), text(authors.take(by)), times.take(by), pa.array(gone >= 0)]
        self.__init__()
        return pa.table([*out, pa.nulls(len(made), pa.int32())], schema=_ARROW)


def _error_rows(found: list[tuple[str, int]]) -> pa.Table:
    """One row per file with mismatching hunks (Q5), told from lines by its count: counted, never invented."""
    n = len(found)
    files, errors = pa.array([f for f, _ in found], pa.string()), pa.array([e for _, e in found], pa.int32())
    return pa.table([files, *[pa.nulls(n, f.type) for f in list(_ARROW)[1:-1]], errors], schema=_ARROW)


def _with_map(table: pa.Table) -> pa.Table:
    for name, kind in (("seg", pa.int64()), ("layout", pa.binary()), ("lost", pa.binary())):
        table = table.append_column(name, pa.nulls(table.num_rows, kind))
    return table


class _Replay:
    """Replays a stream sorted by (file_id, seg, log order).  ``maps``: rows are segments of hot
    files, and their position maps go out beside the lines written and removed inside."""

    def __init__(self, maps: bool):
        self.maps, self.out, self.errors = maps, _Lines(), []
        self.key, self.live, self.gone, self.by, self.bad = None, [], [], [], 0
        self.lost: list = []
        self.authors: list = []
        self.times: list = []

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            cols = batch.to_pydict()
            times = batch.column("committed").cast(_TIME).cast(pa.int64()).to_pylist()
            seg, lines = cols.get("seg"), cols.get("lines_before")
            if seg is None:
                seg = lines = [0] * batch.num_rows
            for f, s, n, author, when, start, ops, closes in zip(
                cols["file_id"], seg, lines, cols["author"], times, cols["start"], cols["ops"], cols["closes"]
            ):
                if (f, s) != self.key:
                    yield from self.end()
                    self.key = (f, s)
                    # Lines from before are known by their places: -1 is the first.
                    self.live = LongLines(n) if self.maps else []
                h = len(self.authors)
                self.authors.append(author)
                self.times.append(when)
                if closes:
                    yield from self._closed(h)
                else:
                    self.bad += apply_hunk(self.live, start, ops, h, self.gone)
                if len(self.gone) > len(self.by):
                    self.by += [h] * (len(self.gone) - len(self.by))
                if len(self.gone) > FLUSH_ROWS:
                    self._removed()
                    yield from self.flush(False)
            if self.out.size > FLUSH_ROWS:
                yield from self.flush(False)
        yield from self.end()
        yield from self.flush(True)

    def _closed(self, h: int) -> Iterator[pa.Table]:
        """The file is deleted by ``h``: its lines go, in steps, and it begins anew."""
        if not self.maps:
            self.gone, self.live = self.gone + self.live, []
            return
        self._removed()
        code, n = self.live.runs()
        old = code < 0
        self.lost.append((-1 - code[old], np.full(old.sum(), h), n[old]))
        own = code[~old]  # lines of this segment, one by one
        for at in range(0, len(own), FLUSH_ROWS):
            some = own[at : at + FLUSH_ROWS]
            self.out.add(self.key[0], some, np.full(len(some), h))
            yield from self.flush(False)
        self.live = LongLines(0)

    def _removed(self) -> None:
        """Move removed lines out: those of this segment as rows, older ones to the position map."""
        made, by = np.asarray(self.gone, dtype=np.int64), np.asarray(self.by, dtype=np.int64)
        own = made >= 0
        if self.key:
            self.out.add(self.key[0], made[own], by[own])
        if not own.all():
            self.lost.append((-1 - made[~own], by[~own], np.ones(len(by) - own.sum(), dtype=np.int64)))
        self.gone, self.by = [], []

    def _columns(self) -> tuple[pa.Array, pa.Array]:
        return pa.array(self.authors, pa.string()), pa.array(self.times, pa.int64()).cast(_TIME)

    def end(self) -> Iterator[pa.Table]:
        """The file (or segment) is through."""
        if self.key is None:
            return
        self._removed()
        if self.bad:
            self.errors.append((self.key[0], self.bad))
        if self.maps:
            authors, times = self._columns()
            place, by, n = [np.concatenate(x) for x in zip(*self.lost)] if self.lost else [np.zeros(0, dtype=np.int64)] * 3
            code, size = self.live.runs()
            yield _node(self.key[0], self.key[1], pack_runs(code, authors, times, size), pack_lost(place, by, authors, times, n))
            self.lost = []
        else:
            self.out.add(self.key[0], self.live, None)
        self.key, self.live, self.bad = None, [], 0
        if self.maps or self.out.size > FLUSH_ROWS:
            yield from self.flush(True)

    def flush(self, between: bool) -> Iterator[pa.Table]:
        """Rows so far; ``between`` files, when no line refers to a hunk any more, hunks are forgotten."""
        if self.out.size:
            table = self.out.batch(*self._columns())
            yield _with_map(table) if self.maps else table
        if self.errors:
            table = _error_rows(self.errors)
            yield _with_map(table) if self.maps else table
            self.errors = []
        if between:
            self.authors, self.times = [], []


def _replayer(maps: bool):
    def run(batches):
        for table in _Replay(maps).rows(batches):
            yield from table.combine_chunks().to_batches()

    return run


# ---------------------------------------------------------------- a sorted stream of files


FILE_SCHEMA = SCHEMA + ", path STRING, file_removed TIMESTAMP_NTZ"
_FILE_ARROW = pa.schema([*_ARROW, ("path", pa.string()), ("file_removed", _TIME)])


class _Files:
    """Replays a stream of files: a row with the file's path and removal, then its diffs in log order."""

    def __init__(self):
        self.file, self.live, self.gone, self.by, self.bad = None, [], [], [], 0
        self.files, self.counts, self.made, self.closed, self.errors = [], [], [], [], []
        self.authors: list = []
        self.times: list = []

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        authors, times = self.authors, self.times
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("file_id", "path", "author", "starts", "ops", "closes")}
            whens = batch.column("committed").cast(_TIME).cast(pa.int64()).to_pylist()
            for f, path, author, when, starts, ops, closes in zip(cols["file_id"], cols["path"], cols["author"], whens, cols["starts"], cols["ops"], cols["closes"]):
                if closes is None:  # the next file
                    self.end()
                    if len(self.made) > FLUSH_ROWS:
                        yield from self.flush(True)
                    self.file = (f, path, when)
                    continue
                live, gone, h = self.live, self.gone, len(authors)
                authors.append(author)
                times.append(when)
                if starts:
                    for start, op in zip(starts, ops):
                        self.bad += apply_hunk(live, start, op, h, gone)
                if closes:
                    gone += live
                    self.live = []
                if len(gone) > len(self.by):
                    self.by += [h] * (len(gone) - len(self.by))
                    if len(gone) > FLUSH_ROWS:
                        self.closes()
                        yield from self.flush(False)
        self.end()
        yield from self.flush(True)

    def closes(self) -> None:
        """Move removed lines out."""
        if self.gone:
            self.files.append(self.file)
            self.counts.append(len(self.gone))
            self.made += self.gone
            self.closed += self.by
            self.gone, self.by = [], []

    def end(self) -> None:
        """The file is through."""
        if self.live:
            self.gone += self.live
            self.by += [-1] * len(self.live)
        self.closes()
        if self.bad:
            self.errors.append((self.file, self.bad))
        self.live, self.bad = [], 0

    def flush(self, between: bool) -> Iterator[pa.Table]:
        """Rows so far; ``between`` files, when no line refers to a diff any more, diffs are forgotten."""
        if self.made:
            authors, times = pa.array(self.authors, pa.string()), pa.array(self.times, pa.int64()).cast(_TIME)
            made, closed = pa.array(self.made, pa.int64()), np.asarray(self.closed, dtype=np.int64)
            by, of = pa.array(closed, mask=closed < 0), pa.array(np.repeat(np.arange(len(self.files)), self.counts))
            names, paths, removed = zip(*self.files)
            yield pa.table(
                [
                    pa.array(names, pa.string()).take(of), authors.take(made), times.take(made), authors.take(by), times.take(by), pa.array(closed >= 0),
                    pa.nulls(len(made), pa.int32()), pa.array(paths, pa.string()).take(of), pa.array(removed, pa.int64()).cast(_TIME).take(of),
                ],
                schema=_FILE_ARROW,
            )
            self.files, self.counts, self.made, self.closed = [], [], [], []
        if self.errors:
            n = len(self.errors)
            names, paths, removed = zip(*(file for file, _ in self.errors))
            counts = [pa.nulls(n, f.type) for f in list(_ARROW)[1:-1]] + [pa.array([bad for _, bad in self.errors], pa.int32())]
            yield pa.table([pa.array(names, pa.string()), *counts, pa.array(paths, pa.string()), pa.array(removed, pa.int64()).cast(_TIME)], schema=_FILE_ARROW)
            self.errors = []
        if between:
            self.authors.clear()
            self.times.clear()


def _replay_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _Files().rows(batches):
        yield from table.combine_chunks().to_batches()


# ---------------------------------------------------------------- position maps

# Runs of lines: from place ``first`` on of the file before (null: new lines), ``n`` lines; new or
# lost ones with who wrote or removed them, and when.  Neighbouring runs of one author and time are one.
_RUN = pa.schema([("first", pa.int64()), ("n", pa.int64()), ("author", pa.dictionary(pa.int32(), pa.string())), ("at", _TIME)])


def _names(authors: pa.Array) -> pa.DictionaryArray:
    return authors if pa.types.is_dictionary(authors.type) else authors.dictionary_encode()


def _equal(who: np.ndarray, authors: pa.DictionaryArray, times: pa.Array) -> np.ndarray:
    """Does each hunk of ``who`` have the author and time of the one before it?"""
    name = pc.fill_null(authors.indices, -1).to_numpy(zero_copy_only=False)[who]
    at = pc.fill_null(times.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)[who]
    return (name[1:] == name[:-1]) & (at[1:] == at[:-1])


def _packed(first: np.ndarray, n: np.ndarray, who: np.ndarray, authors: pa.DictionaryArray, times: pa.Array) -> bytes:
    by = pa.array(who, mask=who < 0)
    table = pa.table([pa.array(first, mask=first < 0), pa.array(n), authors.take(by), times.take(by)], schema=_RUN)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def unpack_runs(blob: bytes) -> pa.Table:
    """Runs with their authors as text."""
    runs = _unpacked(blob)
    return runs.set_column(2, "author", runs.column("author").cast(pa.string()))


def pack_runs(codes: np.ndarray, authors: pa.Array, times: pa.Array, n: np.ndarray | None = None) -> bytes:
    """A file as line codes (number of the hunk that wrote it, or -1 - place before) -> runs; with
    ``n``, a code stands for so many lines: of one hunk, or of the places from its own on."""
    authors, n = _names(authors), np.ones(len(codes), dtype=np.int64) if n is None else n
    if not len(codes):
        return _packed(codes, codes, codes, authors, times)
    new = codes >= 0
    same = ~new[1:] & ~new[:-1] & (codes[:-1] - n[:-1] == codes[1:])
    if new.any():
        same |= new[1:] & new[:-1] & _equal(np.where(new, codes, 0), authors, times)
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    code = codes[head]
    return _packed(np.where(code < 0, -1 - code, -1), np.add.reduceat(n, head), np.where(code < 0, -1, code), authors, times)


def pack_lost(place: np.ndarray, by: np.ndarray, authors: pa.Array, times: pa.Array, n: np.ndarray | None = None) -> bytes:
    """Removed places (from each one ``n``) and the hunks that removed them -> runs, by place."""
    authors, n = _names(authors), np.ones(len(place), dtype=np.int64) if n is None else n
    order = np.argsort(place, kind="stable")
    place, by, n = place[order], by[order], n[order]
    if not len(place):
        return _packed(place, place, place, authors, times)
    same = (place[:-1] + n[:-1] == place[1:]) & _equal(by, authors, times)
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    return _packed(place[head], np.add.reduceat(n, head), by[head], authors, times)


def _seen_through(first: np.ndarray, n: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of places (``first``, ``n``) of a file given as runs (``codes``, ``sizes``, as for
    :func:`pack_runs`) -> (number of the run of places, code, lines) of the pieces they consist of."""
    end = np.cumsum(sizes)
    begin = end - sizes
    left = np.searchsorted(end, first, side="right")
    count = np.searchsorted(begin, first + n, side="left") - left
    of = np.repeat(np.arange(len(first)), count)
    piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + left[of]
    lo = np.maximum(begin[piece], first[of])
    size = np.minimum(end[piece], (first + n)[of]) - lo
    code = codes[piece]
    return of, np.where(code < 0, code - (lo - begin[piece]), code), size


def _columns_of(runs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return pc.fill_null(runs.column("first"), -1).to_numpy(), runs.column("n").to_numpy()


def _node(file_id: str, seg: int, layout: bytes, lost: bytes) -> pa.Table:
    empty = [pa.nulls(1, f.type) for f in list(_ARROW)[1:]]
    return pa.table([pa.array([file_id], pa.string()), *empty, pa.array([seg], pa.int64()), pa.array([layout], pa.binary()), pa.array([lost], pa.binary())], schema=_MAP_ARROW)


def compose(file_id: str, left: dict, right: dict) -> tuple[pa.Table, bytes, bytes]:
    """Maps of two neighbouring segments -> (lines written in the left and removed in the right,
    layout and lost places of both together)."""
    lines, layout, lost = _composed(file_id, left, right)
    return pa.concat_tables([_ARROW.empty_table(), *lines]), layout, lost


def _composed(file_id: str, left: dict, right: dict) -> tuple[Iterator[pa.Table], bytes, bytes]:
    """:func:`compose` with the lines in tables of ``FLUSH_ROWS``.  Works on runs, however long they are."""
    # Authors and times of all runs in one numbering: those of a, b and the two lists of removals.
    tables = [_unpacked(x) for x in (left["layout"], right["layout"], left["lost"], right["lost"])]
    base = np.cumsum([0] + [t.num_rows for t in tables])
    names = pa.chunked_array([c for t in tables for c in t.column("author").chunks], type=_RUN.field("author").type).unify_dictionaries()
    authors = pa.concat_arrays(names.chunks) if names.num_chunks else pa.array([], pa.string()).dictionary_encode()
    times = pa.chunked_array([c for t in tables for c in t.column("at").chunks], type=_TIME).combine_chunks()
    (a_first, a_n), (b_first, b_n), (a_place, a_lost), (b_place, b_lost) = map(_columns_of, tables)
    del tables, names
    file = np.where(a_first < 0, np.arange(len(a_n)), -1 - a_first)
    # What the right one removed: lines of the left one, or places from before it.
    of, was, n = _seen_through(b_place, b_lost, file, a_n)
    by, own = of + base[3], was >= 0
    lines = _between(file_id, was[own], by[own], n[own], authors, times)
    old_by = np.arange(len(a_place)) + base[2]
    lost = pack_lost(np.concatenate([a_place, -1 - was[~own]]), np.concatenate([old_by, by[~own]]), authors, times, np.concatenate([a_lost, n[~own]]))
    # The right one's layout: its new lines, and between them what the left one had there.
    old = b_first >= 0
    of, code, n = _seen_through(b_first[old], b_n[old], file, a_n)
    run = np.concatenate([np.flatnonzero(~old), np.flatnonzero(old)[of]])
    code = np.concatenate([np.flatnonzero(~old) + base[1], code])
    order = np.argsort(run, kind="stable")
    return lines, pack_runs(code[order], authors, times, np.concatenate([b_n[~old], n])[order]), lost


def _between(file_id: str, made: np.ndarray, by: np.ndarray, n: np.ndarray, authors: pa.DictionaryArray, times: pa.Array) -> Iterator[pa.Table]:
    """Lines written by ``made`` and removed by ``by``, ``n`` of each."""
    run, out = np.repeat(np.arange(len(n)), n), _Lines()
    for at in range(0, len(run), FLUSH_ROWS):
        some = run[at : at + FLUSH_ROWS]
        out.add(file_id, made[some], by[some])
        yield out.batch(authors, times)


def _compose(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of (file, pair of segments)."""
    file_id, pair = key[0].as_py(), key[1].as_py()
    nodes = sorted((r for b in batches for r in b.select(["seg", "layout", "lost"]).to_pylist()), key=lambda r: r["seg"])
    if len(nodes) == 1:
        lines, layout, lost = (), nodes[0]["layout"], nodes[0]["lost"]
    else:
        lines, layout, lost = _composed(file_id, *nodes)
    for table in lines:
        yield from _with_map(table).combine_chunks().to_batches()
    yield from _node(file_id, pair, layout, lost).to_batches()


def _alive(batches):
    """Lines of the whole history's layout: those alive at its end."""
    for batch in batches:
        for file_id, layout in zip(batch.column("file_id").to_pylist(), batch.column("layout").to_pylist()):
            runs = _unpacked(layout).combine_chunks()
            n = pa.array(np.repeat(np.arange(runs.num_rows), runs.column("n").to_numpy()))
            for at in range(0, len(n), FLUSH_ROWS):
                some = n.slice(at, FLUSH_ROWS)
                m = len(some)
                columns = [pa.array([file_id] * m, pa.string()), runs.column("author").take(some).cast(pa.string()), runs.column("at").take(some)]
                rest = [pa.nulls(m, pa.string()), pa.nulls(m, _TIME), pa.array([False] * m), pa.nulls(m, pa.int32())]
                yield from pa.table([*columns, *rest], schema=_ARROW).combine_chunks().to_batches()


# ---------------------------------------------------------------- the jobs


_ORDER = ("seq", "dpos", "closes", "hpos")
_STREAM = ["file_id", "author", "committed", "start", "ops", "closes"]


def _streamed(rows: DataFrame, keys: list[str], partitions: int | None, extra: tuple[str, ...] = ()) -> DataFrame:
    rows = rows.repartition(partitions, *keys) if partitions else rows.repartition(*keys)
    return rows.sortWithinPartitions(*keys, *_ORDER).select(*_STREAM, *extra)


def segment_lengths(rows: DataFrame) -> DataFrame:
    """file_id, seq_bucket, seg (0, 1, ...), lines_before and ``fits`` for the segments of files.

    Inside a segment, running sums of lines added and removed give the length before each hunk
    up to what the segment starts with; a delete marker starts again from none.  ``need`` is the
    length that lets every removal of a hunk find its line.  ``fits`` tells whether all segments
    of the file start with as many lines as they need; if not, lengths are not known.
    """
    old = F.rtrim(F.regexp_replace("ops", r"\+", ""))  # context after the last removal asks for nothing
    minus = F.length(F.regexp_replace("ops", r"[^-]", "")).cast("bigint")
    plus = F.length(F.regexp_replace("ops", r"[^+]", "")).cast("bigint")
    zero = F.lit(0).cast("bigint")
    h = rows.select(
        "file_id", "seq_bucket", *_ORDER,
        (plus - minus).alias("d"), F.when(minus > 0, F.col("start") + F.length(old)).otherwise(zero).alias("need"),
    )
    segment = Window.partitionBy("file_id", "seq_bucket").orderBy(*_ORDER)
    h = h.withColumn("restarts", F.sum(F.col("closes").cast("int")).over(segment))
    since = Window.partitionBy("file_id", "seq_bucket", "restarts").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("ahead", F.coalesce(F.sum("d").over(since), zero))
    lacks = F.col("need") - F.col("ahead")
    s = h.groupBy("file_id", "seq_bucket").agg(
        F.max(F.when(F.col("restarts") == 0, lacks)).alias("need"),
        F.max(F.when(F.col("restarts") > 0, lacks)).alias("need_inside"),
        F.max("restarts").alias("restarts"),
        F.max_by(F.col("ahead") + F.col("d"), F.struct(*_ORDER)).alias("change"),
    )
    # One row per segment of a file from here on.
    file = Window.partitionBy("file_id").orderBy("seq_bucket")
    s = s.withColumn("part", F.sum((F.col("restarts") > 0).cast("int")).over(file))
    s = s.withColumn("after", F.sum("change").over(Window.partitionBy("file_id", "part").orderBy("seq_bucket")))
    s = s.withColumns({"lines_before": F.coalesce(F.lag("after").over(file), zero), "seg": F.row_number().over(file).cast("bigint") - 1})
    good = (F.coalesce("need", zero) <= F.col("lines_before")) & (F.coalesce("need_inside", zero) <= 0)
    s = s.withColumn("fits", F.min(good).over(Window.partitionBy("file_id")))
    return s.select("file_id", "seq_bucket", "seg", "lines_before", "fits")


def replay_segments(rows: DataFrame, segments: DataFrame, partitions: int | None = None) -> DataFrame:
    """Replay of files cut into ``segments`` (as :func:`segment_lengths` gives them)."""
    cut = rows.join(segments.select("file_id", "seq_bucket", "seg", "lines_before"), ["file_id", "seq_bucket"])
    stream = _streamed(cut, ["file_id", "seg"], partitions, ("seg", "lines_before"))
    nodes = stage(stream.mapInArrow(_replayer(True), MAP_SCHEMA), "replay-maps", compact=True)
    columns = [f.name for f in _ARROW]
    done = nodes.where("seg is null").select(*columns)
    last = segments.agg(F.max("seg")).first()[0] or 0
    for _ in range(int(last).bit_length()):
        pairs = nodes.where("seg is not null").withColumn("pair", F.shiftright("seg", 1))
        nodes = stage(pairs.groupBy("file_id", "pair").applyInArrow(_compose, MAP_SCHEMA), "replay-maps", compact=True)
        done = done.unionByName(nodes.where("seg is null").select(*columns))
    whole = nodes.where("seg is not null").select("file_id", "layout")
    return done.unionByName(whole.mapInArrow(_alive, SCHEMA))


def replay_rows(rows: DataFrame, partitions: int | None = None, split_above: int = 200_000) -> DataFrame:
    """Hunk and delete rows (file_id, seq_bucket, seq, dpos, closes, hpos, author, committed, start,
    ops) -> one row per line (and one with a count per file or segment with mismatches).

    Files with more than ``split_above`` hunks are replayed in segments.
    """
    rows = stage(rows, "replay-hunks", compact=True)  # read by the count, the lengths and the replay
    hot = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_above).select("file_id")
    segments = None
    if not hot.isEmpty():
        segments = stage(segment_lengths(rows.join(hot, "file_id", "left_semi")), "replay-segments", compact=True).where("fits")
        rest = rows.join(segments.where("seg = 0").select("file_id"), "file_id", "left_anti")
    else:
        rest = rows
    out = _streamed(rest, ["file_id"], partitions).mapInArrow(_replayer(False), SCHEMA)
    return out if segments is None else out.unionByName(replay_segments(rows, segments, partitions))


# Groups of files whose hunks are counted before those of single files are.
GROUPS = 1 << 20


def _hot_files(diffs: DataFrame, split_above: int) -> DataFrame | None:
    """Files with more than ``split_above`` hunks, or None.

    Hunks are counted by groups of files; only files of groups that have as many are counted each.
    """
    group = F.pmod(F.xxhash64("file_id"), F.lit(GROUPS))
    counted = diffs.select("file_id", group.alias("g"), (F.size("hunk_ops") + F.col("closes").cast("int")).alias("n"))
    groups = counted.groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") > split_above).select("g")
    groups = stage(groups, "hot-groups", compact=True)
    if groups.isEmpty():
        return None
    hot = counted.join(F.broadcast(groups), "g", "left_semi").groupBy("file_id").agg(F.sum("n").alias("n"))
    hot = stage(hot.where(F.col("n") > split_above).select("file_id"), "hot-files", compact=True)
    return None if hot.isEmpty() else hot


def replay_diffs(diffs: DataFrame, files: DataFrame, partitions: int | None = None, split_above: int = 200_000) -> DataFrame:
    """Diffs (file_id, seq_bucket, seq, dpos, author, committed, hunk_ops, ``closes``: it deletes its file) and
    files (file_id, path, removed) -> one row per line, and one with a count per file with mismatches.

    A file's row travels with its diffs and gives its lines path and removal; files with
    more than ``split_above`` hunks are replayed in segments by :func:`replay_rows`.
    """
    hot = _hot_files(diffs, split_above)
    rest, named = diffs, files.select("file_id", "path", F.col("removed").alias("file_removed"))
    listed = named
    if hot is not None:
        rest, listed = diffs.join(hot, "file_id", "left_anti"), named.join(hot, "file_id", "left_anti")
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    seq, dpos = diffs.schema["seq"].dataType, diffs.schema["dpos"].dataType
    rows = rest.select("file_id", "seq", "dpos", none("path", "string"), "author", "committed", F.col("hunk_ops.start").alias("starts"), F.col("hunk_ops.ops").alias("ops"), "closes")
    rows = rows.unionByName(
        listed.select(
            "file_id", none("seq", seq), none("dpos", dpos), "path", none("author", "string"), F.col("file_removed").alias("committed"),
            none("starts", "array<int>"), none("ops", "array<string>"), none("closes", "boolean"),
        )
    )
    rows = rows.repartition(partitions, "file_id") if partitions else rows.repartition("file_id")
    rows = rows.sortWithinPartitions("file_id", F.col("seq").asc_nulls_first(), F.col("dpos").asc_nulls_first())
    out = rows.select("file_id", "path", "author", "committed", "starts", "ops", "closes").mapInArrow(_replay_files, FILE_SCHEMA)
    if hot is None:
        return out
    some = diffs.join(hot, "file_id", "left_semi")
    place = ["file_id", "seq_bucket", "seq", "dpos"]
    hunks = some.select(*place, F.lit(False).alias("closes"), "author", "committed", F.posexplode("hunk_ops").alias("hpos", "h"))
    hunks = hunks.select(*place, "closes", "hpos", "author", "committed", F.col("h.start").alias("start"), F.col("h.ops").alias("ops"))
    closes = some.where("closes").select(
        *place, "closes", F.lit(0).alias("hpos"), "author", "committed", F.lit(0).alias("start"), F.lit("").alias("ops")
    )
    lines = replay_rows(hunks.unionByName(closes), partitions, split_above)
    return out.unionByName(lines.join(named.join(hot, "file_id", "left_semi"), "file_id"))
