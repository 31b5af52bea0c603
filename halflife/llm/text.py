"""Numpy helpers on Arrow string columns: whole batches as one byte array.

Words are ``[^\\x20\\x09-\\x0D]+``; in UTF-8 those white-space characters are
single bytes that occur nowhere else, so words are cut on bytes.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

WORD_PATTERN = r"[^\x20\x09-\x0D]+"

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def trim() -> None:
    """Give freed memory back to the system: workers live on, and the next stage needs it elsewhere."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def trimmed(run):
    """``run`` over Arrow batches, which gives its memory back after the last one: a worker that waits keeps it otherwise."""

    def whole(batches):
        yield from run(batches)
        trim()

    return whole


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift): spreads every input bit."""
    h = h + np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


BYTE_CODE = mix(np.arange(256, dtype=np.uint64), 7)
_POWERS = {}


def powers(n: int) -> np.ndarray:
    """1, p, p^2, ... mod 2^64."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = 1 << max(12, int(n).bit_length())
        out = np.empty(size, dtype=np.uint64)
        out[0] = 1
        filled = 1
        with np.errstate(over="ignore"):
            step = _ODD
            while filled < size:
                take = min(filled, size - filled)
                out[filled : filled + take] = out[:take] * step
                step = step * step
                filled += take
        have = _POWERS["p"] = out
    return have[:n]


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd numbers without a pattern, one per place: sums of values times these do not cancel
    for texts that repeat or alternate, as sums with powers of one base can."""
    have = _POWERS.get(seed)
    if have is None or len(have) < n:
        have = _POWERS[seed] = mix(np.arange(1 << max(12, int(n).bit_length()), dtype=np.uint64), seed) | np.uint64(1)
    return have[:n]


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, off - off[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of every document and one past the last)."""
    if len(data) == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(offsets), dtype=np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid
    end[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


_AT_PLACE = {}
PLACES = 24


def _at_place(lower: bool) -> np.ndarray:
    """What a byte adds to the hash of its word, by place in the word and byte."""
    if lower not in _AT_PLACE:
        _AT_PLACE[lower] = multipliers(PLACES, 71)[:, None] * (BYTE_CODE[LOWER] if lower else BYTE_CODE)
    return _AT_PLACE[lower]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, in slices so that memory stays small.

    Place by place over the words that are long enough, shortest first; words of over
    ``PLACES`` bytes are summed by themselves.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    table, part = _at_place(lower), 1 << 17
    for at in range(0, len(starts), part):
        start = starts[at : at + part]
        length = np.minimum(ends[at : at + part] - start, PLACES + 1).astype(np.uint8)
        order = np.argsort(length, kind="stable")
        start, total = start[order], np.zeros(len(order), dtype=np.uint64)
        shorter = np.cumsum(np.bincount(length, minlength=PLACES + 2))
        for place in range(PLACES):
            k = shorter[place]
            if k == len(order):
                break
            total[k:] += table[place][data[start[k:] + place]]
        long = order[shorter[PLACES] :] + at
        total[shorter[PLACES] :] = _long_words(data, starts[long], ends[long], lower)
        out[at : at + part][order] = total
    return mix(out, 1)


def _long_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool, part: int = 1 << 20) -> np.ndarray:
    """Sums of the given words (not mixed), about ``part`` bytes at a time."""
    code = BYTE_CODE[LOWER] if lower else BYTE_CODE
    size, out, at = ends - starts, np.empty(len(starts), dtype=np.uint64), 0
    upto = np.cumsum(size)
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] - size[at] + part)))
        n = size[at:to]
        begin = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(begin, n)
        out[at:to] = np.add.reduceat(code[data[inside + np.repeat(starts[at:to], n)]] * multipliers(int(n.max()), 71)[inside], begin)
        at = to
    return out


def windows(h: np.ndarray, k: int, seed: int = 2) -> np.ndarray:
    """Hash of every k consecutive values (across documents too; mask those)."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    n = len(h) - k + 1
    scale = mix(np.arange(k, dtype=np.uint64), seed) | np.uint64(1)
    out = h[:n] * scale[0]
    for j in range(1, k):
        out += h[j : n + j] * scale[j]
    return mix(out, seed)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    if w > 24:  # two running minima over blocks of w
        pad = -len(v) % w
        top = np.iinfo(v.dtype).max
        b = np.concatenate([v, np.full(pad, top, dtype=v.dtype)]).reshape(-1, w)
        left = np.minimum.accumulate(b, axis=1).ravel()
        right = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(right[:n], left[w - 1 : w - 1 + n])
    out, have = v, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[:n], out[w - have : w - have + n])
    return out[:n]


def exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
    """An id per word, equal exactly where the bytes are: the hash groups, bytes decide."""
    n = len(h)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    ids = np.empty(n, dtype=np.int64)
    ids[order] = group
    head = order[new][ids]
    length = ends - starts
    differ = length != length[head]
    rows = np.flatnonzero((head != np.arange(n)) & ~differ)
    p = 0
    while len(rows):
        differ[rows] |= data[starts[rows] + p] != data[starts[head[rows]] + p]
        p += 1
        rows = rows[length[rows] > p]
    if differ.any():  # two words share a hash: tell them apart by their bytes
        extra: dict[bytes, int] = {}
        for i in np.flatnonzero(differ):
            word = data[starts[i] : ends[i]].tobytes()
            ids[i] = extra.setdefault(word, n + len(extra))
    return ids


def group_windows(ids: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the windows ids[a:a+k], a in ``at``: (order, True where a new window begins).

    Sorting is by hash; runs of one hash are compared by their ids, and a run with
    two different windows is sorted by them.
    """
    n = len(at)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    codes = mix(ids.astype(np.uint64), 5)
    h = windows(codes, k, 6)[at]
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = s[1:] != s[:-1]
    same = np.flatnonzero(~new)
    bad = np.zeros(len(same), dtype=bool)
    a, b = at[order[same]], at[order[same - 1]]
    for j in range(k):
        bad |= ids[a + j] != ids[b + j]
    if bad.any():
        for run in np.unique(s[same[bad]]):
            lo, hi = np.searchsorted(s, run), np.searchsorted(s, run, "right")
            part = sorted(order[lo:hi], key=lambda i: (tuple(ids[at[i] : at[i] + k]), i))
            order[lo:hi] = part
            for q in range(lo + 1, hi):
                x, y = at[order[q]], at[order[q - 1]]
                new[q] = bool((ids[x : x + k] != ids[y : y + k]).any())
    return order, new


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of length n: True inside any [start, end)."""
    depth = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(depth[:-1]) > 0


_INVERSE = pow(int(_ODD), -1, 1 << 64)


def _inverse_powers(n: int) -> np.ndarray:
    have = _POWERS.get("i")
    if have is None or len(have) < n:
        out = np.ones(1 << max(12, int(n).bit_length()), dtype=np.uint64)
        filled, step = 1, _INVERSE
        while filled < len(out):
            take = min(filled, len(out) - filled)
            out[filled : filled + take] = out[:take] * np.uint64(step)
            filled += take
            step = step * step % (1 << 64)
        have = _POWERS["i"] = out
    return have[:n]


def gram_hashes(data: np.ndarray, k: int, part: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of every k consecutive bytes, in slices so that memory stays small."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(n, dtype=np.uint64)
    for at in range(0, n, part):
        to = min(n, at + part)
        piece = BYTE_CODE[data[at : to + k - 1]] * powers(to - at + k - 1)
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(piece)])
        out[at:to] = mix((total[k:] - total[:-k]) * _inverse_powers(to - at), 41)
    return out
