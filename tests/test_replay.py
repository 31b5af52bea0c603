"""The replay of a file against a line-by-line list, whole and in segments composed pairwise."""

import datetime as dt
import random
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from halflife.operators import replay as R

ops_strategy = st.lists(
    st.tuples(st.integers(0, 60), st.text(alphabet="+- ", min_size=0, max_size=25)), min_size=1, max_size=40
)


def _plain(hunks, initial):
    """Line by line: one cursor, one list."""
    live, out, errors = list(initial), [], 0
    for k, (start, ops) in enumerate(hunks):
        cur = min(start, len(live))
        for ch in ops:
            if ch == " ":
                errors += cur >= len(live)
                cur = min(cur + 1, len(live))
            elif ch == "+":
                live.insert(cur, k)
                cur += 1
            elif cur < len(live):
                out.append((live.pop(cur), k))
            else:
                errors += 1
    return live, sorted(out), errors


def _sliced(hunks, initial):
    live, gone, by, errors = list(initial), [], [], 0
    for k, (start, ops) in enumerate(hunks):
        errors += R.apply_hunk(live, start, ops, k, gone)
        by += [k] * (len(gone) - len(by))
    return live, sorted(zip(gone, by)), errors


@settings(max_examples=400, deadline=None)
@given(hunks=ops_strategy, n0=st.integers(0, 50))
def test_hunks_as_slices_match_a_list(hunks, n0):
    initial = list(range(-1, -n0 - 1, -1))
    assert _sliced(hunks, initial) == _plain(hunks, initial)


def test_long_file():
    rng = random.Random(7)
    hunks = [(rng.randint(0, 5000), "".join(rng.choice("+- ") for _ in range(rng.randint(1, 40)))) for _ in range(3000)]
    initial = list(range(-1, -4001, -1))
    assert _sliced(hunks, initial) == _plain(hunks, initial)


def _history(seed, n, faults=0):
    """Hunks that fit, with deletes of the whole file now and then (None)."""
    rng, length, out = random.Random(seed), 0, []
    for _ in range(n):
        if rng.random() < 0.02:
            out.append(None)
            length = 0
            continue
        start = rng.randint(0, length)
        room, ops = length - start, ""
        for _ in range(rng.randint(1, 12)):
            c = rng.choice("++- ")
            if c != "+":
                if not room:
                    continue
                room -= 1
            ops += c
        if ops and faults and rng.random() < faults:
            start += rng.randint(1, 9)
        length += ops.count("+") - ops.count("-")
        out.append((start, ops))
    return out


T0 = dt.datetime(2020, 1, 1)


def _rows(spark, histories, bucket):
    rows = []
    for name, history in histories.items():
        for i, hunk in enumerate(history):
            start, ops = hunk or (0, "")
            rows.append((name, bucket(i), i, 0, hunk is None, 0, f"a{i % 7}", T0 + dt.timedelta(minutes=i), start, ops))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "file_id string, seq_bucket int, seq int, dpos int, closes boolean, hpos int, author string, committed timestamp_ntz, start int, ops string")


def _truth(histories):
    out = Counter()
    for name, history in histories.items():
        live, errors, who = [], 0, lambda i: (f"a{i % 7}", T0 + dt.timedelta(minutes=i))
        for i, hunk in enumerate(history):
            gone = []
            if hunk is None:
                live, gone = [], live
            else:
                live, removed, bad = _plain_step(live, hunk, i)
                gone, errors = removed, errors + bad
            out.update((name, *who(c), *who(i), True, None) for c in gone)
        out.update((name, *who(c), None, None, False, None) for c in live)
        if errors:
            out[name, None, None, None, None, None, errors] += 1
    return out


def _plain_step(live, hunk, i):
    names = list(range(len(live)))
    rest, removed, errors = _plain([hunk], [("old", x) for x in names])
    lines = [live[x[1]] if isinstance(x, tuple) else i for x in rest]
    return lines, [live[x[0][1]] for x in removed], errors


def _got(df):
    rows = Counter()
    errors = Counter()
    for r in df.collect():
        if r["replay_errors"] is not None:
            errors[r["file_id"]] += r["replay_errors"]
        else:
            rows[tuple(r)] += 1
    rows.update((name, None, None, None, None, None, n) for name, n in errors.items())
    return rows


@pytest.mark.parametrize("faults", [0, 0.01])
@pytest.mark.parametrize("width", [1, 13, 100, 1000])
def test_segments_equal_the_plain_replay(spark, faults, width):
    histories = {f"f{k}": _history(k, n, faults) for k, n in enumerate([900, 700, 1, 40, 333])}
    rows = _rows(spark, histories, lambda i: i // width)
    want = _truth(histories)
    assert _got(R.replay_rows(rows, partitions=3)) == want
    assert _got(R.replay_rows(rows, partitions=3, split_above=100)) == want


def test_segments_are_used_and_spread(spark):
    histories = {"hot": _history(11, 2000), "cold": _history(12, 50)}
    rows = _rows(spark, histories, lambda i: i // 90)
    s = R.segment_lengths(rows.where("file_id = 'hot'")).orderBy("seg").collect()
    assert [r["seg"] for r in s] == list(range(23)) and all(r["fits"] for r in s)
    length, at = [], 0
    live = []
    for i, hunk in enumerate(histories["hot"]):
        if i % 90 == 0:
            length.append(len(live))
        live = [] if hunk is None else _plain_step(live, hunk, i)[0]
    assert [r["lines_before"] for r in s] == length


def test_a_faulty_history_is_told(spark):
    rows = _rows(spark, {"bad": [(0, "++"), (9, "-"), (0, " +")]}, lambda i: i)
    assert not R.segment_lengths(rows).first()["fits"]


def test_empty(spark):
    rows = _rows(spark, {"x": [(0, "+")]}, lambda i: 0).where("false")
    assert R.replay_rows(rows).count() == 0


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10_000), n=st.integers(2, 60), cut=st.integers(0, 60))
def test_composing_two_maps(seed, n, cut):
    """Two segments composed are the segment of both."""
    history = [h for h in _history(seed, n) if h]
    authors, times = pa.array([f"h{i}" for i in range(n)]), pa.array([T0] * n, pa.timestamp("us"))

    def segment(first, hunks, n0):
        live, gone, by = list(range(-1, -n0 - 1, -1)), [], []
        for k, (start, ops) in enumerate(hunks, first):
            R.apply_hunk(live, start, ops, k, gone)
            by += [k] * (len(gone) - len(by))
        import numpy as np

        old = [(-1 - g, b) for g, b in zip(gone, by) if g < 0]
        lost = R.pack_lost(np.array([x[0] for x in old], dtype=np.int64), np.array([x[1] for x in old], dtype=np.int64), authors, times)
        return live, [(g, b) for g, b in zip(gone, by) if g >= 0], {"layout": R.pack_runs(np.array(live, dtype=np.int64), authors, times), "lost": lost}

    cut = min(cut, len(history))
    a_live, a_gone, a = segment(0, history[:cut], 5)
    b_live, b_gone, b = segment(cut, history[cut:], len(a_live))
    live, gone, both = segment(0, history, 5)
    lines, layout, lost = R.compose("f", a, b)
    assert R.unpack_runs(layout).equals(R.unpack_runs(both["layout"])) and R.unpack_runs(lost).equals(R.unpack_runs(both["lost"]))
    across = Counter((r["creator"], r["remover"]) for r in lines.to_pylist())
    assert across == Counter((f"h{c}", f"h{r}") for c, r in gone) - Counter((f"h{c}", f"h{r}") for c, r in a_gone + b_gone)
