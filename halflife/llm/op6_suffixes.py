"""Operator 6: remove repeated byte strings (suffix-array dedup).

Every byte covered by a ``length``-byte string that also starts anywhere else (same
document included, overlaps too) is removed; strings are judged on the input.

Method: a sparse suffix array, built by a distributed merge sort that knows common
prefixes.

* *Anchors.*  Equal strings contain equal anchors at equal places: the anchor of a
  window of ``length`` bytes is the leftmost smallest hash of its ``gram``-byte
  strings.  Consecutive windows share an anchor, so there is about one anchor per
  150 bytes.  A first exchange counts the anchors' hashes; windows whose anchor
  occurs once cannot repeat and drop out.
* *Runs.*  Of each remaining anchor a chunk takes the suffix to its right and the
  reversed prefix to its left, as far as its windows reach.  Equal pairs are one
  entry.  Both sides are sorted and sent to the anchor's bucket as front-coded
  runs: with each string only its common prefix length with the string before
  and the bytes after that.
* *Merge.*  A bucket merges the runs of all chunks with a loser tree whose entries
  carry the common prefix length with the last winner.  If two lengths differ, they
  decide; if not, bytes are compared from that length on.  So no known prefix is
  compared again, and the merge yields the common prefix lengths of the suffix
  array as it goes.
* *Windows.*  The window that begins o bytes left of an anchor repeats if another
  entry agrees on o bytes to the left and length - o bytes to the right.  For each o,
  the two arrays of common prefix lengths cut the entries into classes; an entry
  whose pair of classes holds another has a repeated window there.  Only hashes
  select candidates; what is removed is decided by bytes.

Entries that occur twice within a chunk are settled there and travel once, so a
passage copied into a third of all documents sends one entry per chunk.  An anchor
that is frequent all the same (many different neighbourhoods) sends its windows
singly to buckets of their own hash, which spreads them evenly.

Scale: one shuffle of the texts (shared by the three uses), one of 8 bytes per
anchor, one of the front-coded runs of repeated anchors.  Chunks and buckets grow in
number, not in size.

Edge cases: null text is the empty text.  Texts shorter than ``length`` keep all
bytes.  Matches never cross documents.  Repeated rows are separate places, so
their bytes repeat.  Null ids are carried through.  An empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halflife.llm import exchange as X
from halflife.llm import text as T
from halflife.llm.parcels import opened, parcelled

KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
ANCHORS, FLAGS, KNOWN = 0, 1, 2  # kinds of blobs that a chunk receives


# ---------------------------------------------------------------- sorted runs


def common(x: bytes, y: bytes, at: int) -> int:
    """Length of the common prefix of x and y, which agree on ``at`` bytes."""
    n = min(len(x), len(y))
    while at < n:
        to = min(n, at + 64)
        a, b = x[at:to], y[at:to]
        if a != b:
            differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
            return to - (differ.bit_length() + 7) // 8
        at = to
    return n


def front_code(strings: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Common prefix length of each sorted string with the one before, and the rest of it."""
    lcp, rest, last = [], [], b""
    for s in strings:
        h = common(last, s, 0)
        lcp.append(h)
        rest.append(s[h:])
        last = s
    return np.array(lcp, dtype=np.uint16), rest


def decode_run(lcp: list[int], sizes: list[int], rest: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for h, n in zip(lcp, sizes):
        last = last[:h] + rest[at : at + n]
        at += n
        out.append(last)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs (strings, common prefix lengths) with a loser tree.

    Returns for each string in sorted order its run, its place in the run, and its
    common prefix length with the string before it.
    """
    k = len(runs)
    place = [0] * k
    now = [r[0][0] if r[0] else None for r in runs]
    known = [0] * k  # common prefix length with the last winner
    size = 1 << max(0, k - 1).bit_length()

    def play(a: int, b: int) -> tuple[int, int]:
        if b < 0 or now[b] is None:
            return a, b
        if a < 0 or now[a] is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = now[a], now[b]
        h = common(x, y, known[a])
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    losers = [-1] * size
    up = [i if i < k else -1 for i in range(size)]
    level = size
    while level > 1:
        level //= 2
        winners = []
        for i in range(level):
            w, losers[level + i] = play(up[2 * i], up[2 * i + 1])
            winners.append(w)
        up = winners
    winner = up[0] if k else -1
    out_run, out_place, out_lcp = [], [], []
    while winner >= 0 and now[winner] is not None:
        strings, lcps = runs[winner]
        i = place[winner]
        out_run.append(winner)
        out_place.append(i)
        out_lcp.append(known[winner])
        place[winner] = i = i + 1
        if i < len(strings):
            now[winner] = strings[i]
            known[winner] = lcps[i]
        else:
            now[winner] = None
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
    return out_run, out_place, out_lcp


# ---------------------------------------------------------------- chunks


class _Bytes:
    def __init__(self, table: pa.Table):
        self.data, self.offsets = T.flat(table.column("text"))


def find_anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(place, first window, last window, hash) of the anchors of all windows inside documents."""
    v = T.gram_hashes(data, gram)
    span = length - gram + 1
    least = T.sliding_min(v, span)
    inside = np.zeros(len(least), dtype=bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        inside[a : max(a, b - length + 1)] = True
    at = np.flatnonzero(inside)
    if not len(at):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, v[:0]
    begin = np.searchsorted(at, offsets)  # a run never crosses a document
    fresh = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])])
    fresh[begin[begin < len(at)]] = True
    head = np.flatnonzero(fresh)
    first, last = at[head], at[np.append(head[1:], len(at)) - 1]
    places, firsts, lasts = [], [], []
    window = np.arange(span)
    while len(first):
        place = np.empty(len(first), dtype=np.int64)
        for i in range(0, len(first), 4096):
            f = first[i : i + 4096]
            place[i : i + 4096] = f + v[f[:, None] + window].argmin(axis=1)
        places.append(place)
        firsts.append(first)
        lasts.append(np.minimum(last, place))
        more = last > place  # the same hash again, further right
        first, last = place[more] + 1, last[more]
    place, first, last = map(np.concatenate, (places, firsts, lasts))
    order = np.argsort(first, kind="stable")
    return place[order], first[order], last[order], v[place[order]]


def _kind(n: int) -> np.ndarray:
    return np.array([n], dtype=np.int64)


def _bucket(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    return (T.mix(hashes, 43) % np.uint64(n_buckets)).astype(np.int64)


def _count_anchors(length: int, gram: int, n_buckets: int):
    def run(key, table):
        chunk = key[0].as_py()
        b = _Bytes(opened(table))
        place, first, last, hashes = find_anchors(b.data, b.offsets, length, gram)
        if not len(place):
            return X.mail([])
        rows = [(-1 - chunk, X.pack(_kind(ANCHORS), place.astype(np.int32), first.astype(np.int32), last.astype(np.int32), hashes))]
        distinct, count = np.unique(hashes, return_counts=True)
        for to, rank in X.split_by(_bucket(distinct, n_buckets)):
            rows.append((to, X.pack(np.array([chunk, to]), distinct[rank], count[rank].astype(np.int32))))
        return X.mail(rows)

    return run


def _answer_counts(often: int):
    """Per anchor hash: 0 occurs once, 1 repeats, 2 is so frequent that windows travel singly."""

    def run(key, table):
        if key[0].as_py() < 0:
            return table.select(["key", "blob"])
        who, hashes, counts = [], [], []
        for w, h, c in X.blobs(table):
            who.append(np.frombuffer(w, dtype=np.int64))
            hashes.append(np.frombuffer(h, dtype=np.uint64))
            counts.append(np.frombuffer(c, dtype=np.int32))
        _, number = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(number, weights=np.concatenate(counts))[number]
        code = ((total > 1).astype(np.uint8) + (total > often)).astype(np.uint8)
        rows, at = [], 0
        for (chunk, bucket), h in zip(who, hashes):
            rows.append((-1 - int(chunk), X.pack(_kind(FLAGS), np.array([bucket]), code[at : at + len(h)])))
            at += len(h)
        return X.mail(rows)

    return run


def _window_runs(positions: np.ndarray) -> bytes:
    start, n = X.runs(np.unique(positions))
    return X.pack(_kind(KNOWN), start.astype(np.int32), n.astype(np.int32))


def _send_runs(length: int, n_buckets: int):
    def run(key, table, answers):
        if table.num_rows == 0 or answers.num_rows == 0:
            return X.mail([])
        chunk, data = key[0].as_py(), _Bytes(opened(table)).data.tobytes()
        codes = {}
        for kind, *rest in X.blobs(answers):
            if np.frombuffer(kind, dtype=np.int64)[0] == ANCHORS:
                place, first, last = (np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in rest[:3])
                hashes = np.frombuffer(rest[3], dtype=np.uint64)
            else:
                codes[int(np.frombuffer(rest[0], dtype=np.int64)[0])] = np.frombuffer(rest[1], dtype=np.uint8)
        distinct = np.unique(hashes)
        code = np.zeros(len(distinct), dtype=np.uint8)
        for to, rank in X.split_by(_bucket(distinct, n_buckets)):
            code[rank] = codes[to]
        code = code[np.searchsorted(distinct, hashes)]

        # Entries: (bucket, left bytes reversed, right bytes, first window, windows known to repeat).
        entries: dict[int, list[tuple[bytes, bytes, int, bool]]] = {}
        known = []

        def take(groups: dict, bucket_of, part_of) -> None:
            for what, members in groups.items():
                if len(members) > 1:  # twice in this chunk: settled, but others may need to see it
                    known.extend(members)
                entries.setdefault(bucket_of(what, members), []).append((*part_of(what), members[0][0], len(members) > 1))

        normal = np.flatnonzero(code == 1)
        alike: dict[tuple[bytes, int], list] = {}
        for p, f, t, h in zip(place[normal].tolist(), first[normal].tolist(), last[normal].tolist(), _bucket(hashes[normal], n_buckets).tolist()):
            alike.setdefault((data[f : t + length], p - f), []).append((f, t, h))
        take(alike, lambda what, members: members[0][2], lambda what: (what[0][: what[1]][::-1], what[0][what[1] :]))
        single: dict[bytes, list] = {}
        for f, t in zip(first[code == 2].tolist(), last[code == 2].tolist()):
            for i in range(f, t + 1):
                single.setdefault(data[i : i + length], []).append((i, i))
        take(single, lambda what, members: n_buckets + xxhash.xxh64_intdigest(what) % n_buckets, lambda what: (b"", what))

        rows = []
        if known:
            rows.append((-1 - chunk, _window_runs(np.concatenate([np.arange(m[0], m[1] + 1) for m in known]))))
        for to, part in entries.items():
            part.sort(key=lambda e: e[1])
            back = sorted(range(len(part)), key=lambda i: part[i][0])
            right_lcp, right = front_code([e[1] for e in part])
            left_lcp, left = front_code([part[i][0] for i in back])
            sizes = [np.array([len(x) for x in side], dtype=np.uint16) for side in (right, left)]
            rows.append(
                (
                    to,
                    X.pack(
                        np.array([chunk]),
                        np.array([e[2] for e in part], dtype=np.int32),
                        np.array([e[3] for e in part], dtype=np.uint8),
                        np.array(back, dtype=np.int32),
                        right_lcp,
                        sizes[0],
                        b"".join(right),
                        left_lcp,
                        sizes[1],
                        b"".join(left),
                    ),
                )
            )
        return X.mail(rows)

    return run


# ---------------------------------------------------------------- buckets


def _sorted_side(runs: list[tuple[list[bytes], list[int]]], base: np.ndarray, number: list[np.ndarray]):
    """(rank of every entry, common prefix length of the entry at each rank with the one before)."""
    run, place, lcp = merge_runs(runs)
    run, place = np.array(run, dtype=np.int64), np.array(place, dtype=np.int64)
    entry = np.concatenate(number)[base[run] + place] + base[run]
    rank = np.empty(len(entry), dtype=np.int64)
    rank[entry] = np.arange(len(entry))
    lcp = np.array(lcp, dtype=np.int64)
    if len(lcp):
        lcp[0] = 0
    return rank, lcp


def repeated_windows(length: int, left_rank, left_lcp, right_rank, right_lcp, n_left, n_right, settled):
    """(entry, o) of the windows, o bytes left of an entry's anchor, that another entry has too."""
    out_entry, out_o = [], []
    lowest = length - n_right  # an entry's windows: lowest <= o <= n_left
    open_ = ~settled
    if not open_.any() or len(n_left) < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for o in range(int(lowest[open_].min()), int(n_left[open_].max()) + 1):
        there = np.flatnonzero((lowest <= o) & (o <= n_left))
        if len(there) < 2:
            continue
        left = np.cumsum(left_lcp < o)[left_rank[there]]
        right = np.cumsum(right_lcp < length - o)[right_rank[there]]
        both = left * (len(n_left) + 1) + right
        order = np.argsort(both, kind="stable")
        s = both[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = there[order[twice]]
        hit = hit[open_[hit]]
        out_entry.append(hit)
        out_o.append(np.full(len(hit), o, dtype=np.int64))
    if not out_entry:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(out_entry), np.concatenate(out_o)


def _merge_bucket(length: int):
    def run(key, table):
        if key[0].as_py() < 0:
            return table.select(["key", "blob"])
        chunk, first, settled, right_runs, left_runs, back, n_left, n_right = [], [], [], [], [], [], [], []
        for c, f, s, b, r_lcp, r_size, r_rest, l_lcp, l_size, l_rest in X.blobs(table):
            f = np.frombuffer(f, dtype=np.int32).astype(np.int64)
            chunk.append(np.repeat(np.frombuffer(c, dtype=np.int64), len(f)))
            first.append(f)
            settled.append(np.frombuffer(s, dtype=np.uint8) > 0)
            back.append(np.frombuffer(b, dtype=np.int32).astype(np.int64))
            for runs, lcp, size, rest in ((right_runs, r_lcp, r_size, r_rest), (left_runs, l_lcp, l_size, l_rest)):
                lcp = np.frombuffer(lcp, dtype=np.uint16).tolist()
                runs.append((decode_run(lcp, np.frombuffer(size, dtype=np.uint16).tolist(), rest), lcp))
            n_right.append(np.array([len(x) for x in right_runs[-1][0]], dtype=np.int64))
            left_size = np.empty(len(f), dtype=np.int64)
            left_size[back[-1]] = [len(x) for x in left_runs[-1][0]]
            n_left.append(left_size)
        counts = np.array([len(f) for f in first])
        base = np.cumsum(counts) - counts
        chunk, first, settled, n_left, n_right = map(np.concatenate, (chunk, first, settled, n_left, n_right))
        right_rank, right_lcp = _sorted_side(right_runs, base, [np.arange(n) for n in counts])
        left_rank, left_lcp = _sorted_side(left_runs, base, back)
        del right_runs, left_runs
        entry, o = repeated_windows(length, left_rank, left_lcp, right_rank, right_lcp, n_left, n_right, settled)
        position = first[entry] + n_left[entry] - o
        return X.mail([(-1 - c, _window_runs(position[rank])) for c, rank in X.split_by(chunk[entry])])

    return run


def _finish(length: int):
    def run(key, table, answers):
        table = opened(table)
        b = _Bytes(table)
        known = [[np.frombuffer(x, dtype=np.int32) for x in rest] for _, *rest in X.blobs(answers)]
        start = np.concatenate([x[0] for x in known] or [np.zeros(0, dtype=np.int64)]).astype(np.int64)
        n = np.concatenate([x[1] for x in known] or [np.zeros(0, dtype=np.int64)])
        gone = T.cover(len(b.data), start, start + n - 1 + length)
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = b.offsets[1:-1]
        inner = inner[inner < len(gone)]
        opens[inner] = gone[inner]  # a span ends with its document
        removed = np.concatenate([[0], np.cumsum(gone)])
        spans = np.concatenate([[0], np.cumsum(opens)])
        n_bytes = np.diff(b.offsets)
        n_removed, n_spans = np.diff(removed[b.offsets]), np.diff(spans[b.offsets])
        plain, cut = b.data[~gone].tobytes(), (b.offsets - removed[b.offsets]).tolist()
        kept = [plain[x:y] for x, y in zip(cut[:-1], cut[1:])]
        return pa.table(
            [table.column("doc_id").cast(pa.int64()), pa.array(n_bytes), pa.array(n_removed), pa.array(n_spans), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )

    return run


def remove_repeated_strings(
    docs: DataFrame, length: int = 400, gram: int = 100, bucket_bytes: int = 6 << 20, chunk_bytes: int = X.CHUNK_BYTES, often: int = 20_000
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) of every row of ``docs`` (doc_id, text)."""
    total = X.text_bytes(docs)
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    parts = parcelled(docs, total, chunk_bytes)

    def answered(sent: DataFrame, serve) -> DataFrame:
        return sent.groupBy("key").applyInArrow(serve, X.MAIL).select((-1 - F.col("key")).alias("chunk"), "blob")

    counted = answered(parts.groupBy("chunk").applyInArrow(_count_anchors(length, gram, n_buckets), X.MAIL), _answer_counts(often))
    sent = parts.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(_send_runs(length, n_buckets), X.MAIL)
    known = answered(sent, _merge_bucket(length))
    return parts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_finish(length), KEPT)


def query(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeated_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
