"""F8: hot files whose lines from before stand for millions, edited in chunks and composed in runs."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from halflife.operators import replay as R


@pytest.mark.parametrize("seed", range(6))
def test_chunks_are_a_list(seed, monkeypatch):
    monkeypatch.setattr(R.LongLines, "CHUNK", 4)
    monkeypatch.setattr(R.LongLines, "BLOCK", 3)
    rng = random.Random(seed)
    before = rng.choice([0, 1, 40, 500])
    plain, long = list(range(-1, -before - 1, -1)), R.LongLines(before)
    for mark in range(600):
        start = rng.choice([0, rng.randint(0, len(plain) + 5), len(plain)])
        ops = "".join(rng.choice("+++-- " if mark % 200 < 120 else "+---- ") for _ in range(rng.choice([1, 3, 12, 60])))
        lost, gone = [], []
        assert R.apply_hunk(long, start, ops, mark, gone) == R.apply_hunk(plain, start, ops, mark, lost)
        assert gone == lost and len(long) == len(plain)
    assert list(long) == plain
    code, n = long.runs()
    assert [c - (k if c < 0 else 0) for c, m in zip(code.tolist(), n.tolist()) for k in range(m)] == plain


def test_edits_of_a_long_file_move_little():
    """A queue of ten million lines: on top one line more, at the bottom one less (a list moves 80 MB a hunk)."""
    live, gone, began = R.LongLines(10_000_000), [], time.process_time()
    for mark in range(20_000):
        R.apply_hunk(live, 0, "+", mark, gone)
        R.apply_hunk(live, len(live) - 1, "-", mark, gone)
        R.apply_hunk(live, mark * 397, "-+", mark, gone)
    assert time.process_time() - began < 20 and len(live) == 10_000_000
    code, n = live.runs()
    assert n.sum() == 10_000_000 and len(code) < 200_000


def test_maps_of_ranges_are_small_and_composed_as_runs():
    authors, times = pa.array(["a", "b"]), pa.array([1, 2], pa.timestamp("us"))
    n = 10**12
    none = np.zeros(0, dtype=np.int64)
    cut = R.pack_runs(np.array([0, -1, -n - 1 - 5]), authors, times, np.array([3, n, n]))  # three new lines, all old ones but five
    lost = R.pack_lost(np.array([n]), np.array([1]), authors, times, np.array([5]))
    later = {"layout": R.pack_runs(np.array([-1 - 2]), authors, times, np.array([2 * n + 1])), "lost": R.pack_lost(np.array([0]), np.array([1]), authors, times, np.array([2]))}
    lines, layout, gone = R.compose("f", {"layout": cut, "lost": lost}, later)
    assert [(r["creator"], r["remover"]) for r in lines.to_pylist()] == [("a", "b")] * 2
    assert R.unpack_runs(layout).to_pydict()["n"] == [1, n, n] and R.unpack_runs(layout).to_pydict()["first"] == [None, 0, n + 5]
    assert R.unpack_runs(gone).to_pydict() == R.unpack_runs(lost).to_pydict()
    assert R.unpack_runs(R.pack_runs(none, authors, times)).num_rows == 0


def test_neighbouring_runs_of_one_hunk_are_one():
    """Two places with a new line between them, removed by one hunk (seed 372 of test_composing_two_maps)."""
    authors, times = pa.array(["a", "b"]), pa.array([1, 2], pa.timestamp("us"))
    none = R.pack_lost(*[np.zeros(0, dtype=np.int64)] * 2, authors, times)
    left = {"layout": R.pack_runs(np.array([-1, 0, -2]), authors, times), "lost": none}
    right = {"layout": R.pack_runs(np.array([-2]), authors, times), "lost": R.pack_lost(np.array([0, 2]), np.array([1, 1]), authors, times)}
    _, layout, lost = R.compose("f", left, right)
    assert R.unpack_runs(lost).to_pydict() == {"first": [0], "n": [2], "author": ["b"], "at": R.unpack_runs(lost).column("at").to_pylist()}
    assert R.unpack_runs(layout).column("author").to_pylist() == ["a"]
