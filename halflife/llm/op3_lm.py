"""Operator 3: language-model scoring by a hierarchical Pitman-Yor bigram model.

The model.  Every context word u has a restaurant; a customer is a token after u,
a dish is a word w.  A customer joins a table of its dish with weight (customers
there - d) or opens a new one with weight (theta + d * tables) * P1(w); each new
table is a customer of the parent, the restaurant of all words, which all contexts
share, and whose own new tables draw from the uniform base over the V words and
one unknown.  The predictive probability is

    P(w|u) = (c_uw - d t_uw + (theta + d T_u) P1(w)) / (theta + c_u),
    P1(w)  = (c_w - d0 t_w + (theta0 + d0 T0) / (V + 1)) / (theta0 + C0),

and a context never seen gives P1(w).

Seating is sampled by Gibbs: remove a customer, seat it again, for every customer in
turn; t_uw and T_u enter the predictive probability as averages over the samples
after the burn-in.  Restaurants are sampled in blocks, in turn: the parent given the
tables of all contexts, then the contexts given the parent's P1(w), starting with
one table for each dish.  The seating of the contexts goes on from round to round.
Dishes with over ``CROWD`` customers in one restaurant seat them in growing groups,
each with one binomial draw, so a frequent pair costs the logarithm of its count.

How it runs.  Documents are packed into chunks; a chunk sends its distinct pairs
(u, w) with their training counts to the bucket of u.  A bucket holds whole
restaurants and writes them down once.  In every round the buckets send their tables
by word to word buckets, which seat the parent and answer with its customers and
tables of each word; the totals C0, T0 and V are summed over all of them.  A context
so frequent that it would fill a bucket is split by pairs over all buckets; its
number of tables is summed over its parts every round and follows the own part
within a round.  After the last round buckets answer chunks with c_uw and t_uw, word
buckets with the counts.  Everything gathered from the corpus - pairs, words,
tables - grows with the input; the driver sees a few totals a round.

Words are identified by a 64-bit hash.  The results do not depend on partitioning:
random numbers are drawn per bucket from a fixed seed over sorted pairs.

Edge cases: null and empty texts have one token, the end.  Rows with a null id
teach and are not held out.  Repeated rows teach as often as they occur and score
alike.  With no training rows N and V are 0 and all words have the base
probability.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halflife.llm import exchange as X
from halflife.llm import text as T
from halflife.llm.op1_passages import slices
from halflife.llm.parcels import opened, parcelled
from halflife.session import release_staged, stage

END, START = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0x57A2757A2757A271)  # not words: hashes of two marks
PAIRS, WORDS = 0, 1  # kinds of answers to a chunk
TABLES, ASKED = 0, 1  # kinds of blobs in a word bucket
SEATED = 2  # a bucket's own seating, kept for its next round
PARENT_SAMPLES = 2  # of the parent in a round, after one sweep of burn-in
CROWD = 64
SCORED = "doc_id long, n_tokens long, n_known long, base_sum double, score double"


class _Tokens:
    """Tokens of a chunk in reading order, each with its context."""

    def __init__(self, table: pa.Table, folds: int, fold: int):
        data, offsets = T.flat(table.column("text"))
        starts, ends, first = T.word_spans(data, offsets)
        h = T.word_hashes(data, starts, ends, lower=True)
        n_docs = table.num_rows
        self.first = first + np.arange(n_docs + 1)  # every document has an end besides its words
        self.token = np.empty(len(h) + n_docs, dtype=np.uint64)
        self.token[np.arange(len(h)) + np.repeat(np.arange(n_docs), np.diff(first))] = h
        self.token[self.first[1:] - 1] = END
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[self.first[:-1]] = START
        ids = table.column("doc_id").to_pylist()
        teaches = np.array([i is None or zlib.crc32(str(i).encode()) % folds != fold for i in ids], dtype=bool)
        self.teaches = np.repeat(teaches, np.diff(self.first))

    def pairs(self):
        """(context, token, training count, number of the pair at every token) of distinct pairs."""
        key = T.mix(self.context * np.uint64(0x9E3779B97F4A7C15) + self.token, 51)
        key, at, number = np.unique(key, return_index=True, return_inverse=True)
        return key, self.context[at], self.token[at], np.bincount(number, weights=self.teaches, minlength=len(key)).astype(np.int64), number

    def words(self):
        """(word, training count, number of the word at every token) of distinct words; START is one of them."""
        word, number = np.unique(np.append(self.token, START), return_inverse=True)
        count = np.bincount(number[:-1], weights=self.teaches, minlength=len(word)).astype(np.int64)
        return word, count, number[:-1]


def _of(h: np.ndarray, n: int, seed: int) -> np.ndarray:
    return (T.mix(h, seed) % np.uint64(n)).astype(np.int64)


def _pair_bucket(key, context, n_buckets: int, bins: int, hot: np.ndarray) -> np.ndarray:
    out = _of(context, n_buckets, 52)
    if len(hot):
        out = np.where(np.isin(_of(context, bins, 53), hot), n_buckets + _of(key, n_buckets, 54), out)
    return out


def _survey(docs: DataFrame, bins: int, folds: int, fold: int) -> DataFrame:
    """(key, n): tokens by bin of their context, as partial counts."""

    def run(batches):
        count = np.zeros(bins, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 4 << 20):
                t = _Tokens(part, folds, fold)
                count += np.bincount(_of(t.context, bins, 53), minlength=bins)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(count[full], pa.int64())], names=["key", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, n long")


# ---------------------------------------------------------------- seating


class Seating:
    """Customers of some dishes; ``tables`` is the number of tables of each dish."""

    def __init__(self, customers: np.ndarray, discount: float, rng: np.random.Generator):
        self.c, self.d, self.rng = customers, discount, rng
        self.tables = np.ones(len(customers), dtype=np.int64)
        self.small = np.flatnonzero((customers > 1) & (customers <= CROWD))
        self.small = self.small[np.argsort(-customers[self.small], kind="stable")]
        self.large = np.flatnonzero(customers > CROWD)
        n = customers[self.small]
        self.base = np.cumsum(n) - n
        self.at = np.zeros(int(n.sum()), dtype=np.int32)  # table of every customer of a small dish
        self.size = np.zeros(int(n.sum()), dtype=np.int32)  # customers of each of its possible tables
        self.size[self.base] = n

    def resume(self, at: np.ndarray) -> None:
        """Go on from the tables ``at`` of the customers of small dishes."""
        n = self.c[self.small]
        self.at = at.astype(np.int32)
        self.size = np.bincount(np.repeat(self.base, n) + self.at, minlength=len(self.at)).astype(np.int32)
        if len(n):
            self.tables[self.small] = np.add.reduceat((self.size > 0).astype(np.int64), self.base)

    def sweep(self, opening: np.ndarray) -> None:
        """Seat everybody again; ``opening``: each dish's weight of a new table."""
        rng, d, n = self.rng, self.d, self.c[self.small]
        for turn in range(int(n[0]) if len(n) else 0):
            active = int(np.searchsorted(-n, -turn, side="left"))  # dishes with over ``turn`` customers
            dish, base, count = self.small[:active], self.base[:active], n[:active]
            j = base + turn
            table = self.at[j]
            self.size[base + table] -= 1
            t = self.tables[dish] - (self.size[base + table] == 0)
            weight = opening[dish]
            new = rng.random(active) * (weight + (count - 1) - d * t) < weight
            chosen = np.where(new, -1, 0).astype(np.int64)
            todo = np.flatnonzero(~new)
            while len(todo):  # the table of a random other customer, kept with chance (size - d) / size
                other = base[todo] + (turn + 1 + (rng.random(len(todo)) * (count[todo] - 1)).astype(np.int64)) % count[todo]
                seat = self.at[other]
                size = self.size[base[todo] + seat]
                good = rng.random(len(todo)) * size < size - d
                chosen[todo[good]] = seat[good]
                todo = todo[~good]
            todo = np.flatnonzero(new)
            while len(todo):  # any table that is free now
                seat = (rng.random(len(todo)) * count[todo]).astype(np.int64)
                free = self.size[base[todo] + seat] == 0
                chosen[todo[free]] = seat[free]
                todo = todo[~free]
            self.at[j] = chosen
            self.size[base + chosen] += 1
            self.tables[dish] = t + new
        if len(self.large):
            self._sweep_large(opening[self.large])

    def _sweep_large(self, weight: np.ndarray) -> None:
        c, t = self.c[self.large].astype(np.float64), np.ones(len(self.large))
        seated, step = 1.0, 1.0
        while seated < c.max(initial=0):
            step = max(1.0, math.floor(seated / 8))
            group = np.clip(c - seated, 0, step)
            middle = seated + group / 2
            p = np.clip(weight / (weight + np.maximum(middle - self.d * t, 1e-9)), 0, 1)
            t += self.rng.binomial(group.astype(np.int64), p)
            seated += step
        self.tables[self.large] = t.astype(np.int64)


# ---------------------------------------------------------------- rounds


def _send_pairs(n_buckets: int, bins: int, hot: np.ndarray, folds: int, fold: int):
    def run(key, table):
        chunk = key[0].as_py()
        pair, context, token, count, _ = _Tokens(opened(table), folds, fold).pairs()
        rows = []
        for to, rank in X.split_by(_pair_bucket(pair, context, n_buckets, bins, hot)):
            u, ui = np.unique(context[rank], return_inverse=True)
            w, wi = np.unique(token[rank], return_inverse=True)
            rows.append((to, X.pack(np.array([chunk, to]), _shuffled(u), _shuffled(w), ui.astype(np.int32), wi.astype(np.int32), count[rank].astype(np.int32))))
        return X.mail(rows)

    return run


def _shuffled(ascending: np.ndarray) -> np.ndarray:
    """Ascending 64-bit numbers as planes of the bytes of their steps: the upper planes are mostly zero."""
    return np.ascontiguousarray(np.diff(ascending, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)


def _unshuffled(planes: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64)


def _bytes(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on as planes of the bytes of the shortest unsigned numbers that hold them."""
    kind = np.min_scalar_type(int(values.max(initial=0))).type
    return np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), kind().itemsize).T)


def _numbers(planes: bytes, n: int) -> np.ndarray:
    width = len(planes) // max(n, 1) or 1
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(width, n).T).view(f"u{width}").ravel().astype(np.int64)


def _told(bucket: int, names: np.ndarray, customers: np.ndarray, tables: np.ndarray, n_word_buckets: int) -> list[tuple[int, bytes]]:
    """Letters to word buckets: per name the tables that serve it, and the tables of the context so called."""
    return [
        (to, X.pack(np.array([TABLES, bucket]), _shuffled(names[rank]), _bytes(customers[rank]), _bytes(tables[rank])))
        for to, rank in X.split_by(_of(names, n_word_buckets, 55))
    ]


class _Restaurants:
    """The restaurants of a bucket: dishes by context and word, and which dish each chunk's pairs ask for."""

    def __init__(self, state: bytes):
        head, self.asks, self.seen, names, words, contexts, ui, wi, c = X.unpack(state)
        self.bucket, self.pairs, n = (int(x) for x in np.frombuffer(head, dtype=np.int64))
        self.names = _unshuffled(names)
        self.words, self.contexts = np.frombuffer(words, dtype=np.int32), np.frombuffer(contexts, dtype=np.int32)  # places among the names
        self.ui, self.wi, self.c = (_numbers(x, n) for x in (ui, wi, c))

    def answers(self, values: list[np.ndarray]):
        """(chunk, the values of its pairs' dishes, 0 for pairs not in training) of every chunk."""
        seen = np.unpackbits(np.frombuffer(self.seen, dtype=np.uint8), count=self.pairs) > 0
        full = [np.zeros(self.pairs, dtype=np.int64) for _ in values]
        for f, v in zip(full, values):
            f[seen] = v
        asks = X.unpack(self.asks)
        for head, steps in zip(asks[::2], asks[1::2]):
            chunk, size = (int(x) for x in np.frombuffer(head, dtype=np.int64))
            pair = np.cumsum(_numbers(steps, size))
            yield chunk, [f[pair] for f in full]

    def sums(self, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By name: the tables that serve it, the tables of the context."""
        served, held = (np.zeros(len(self.names), dtype=np.int64) for _ in range(2))
        served[self.words] = np.bincount(self.wi, weights=tables, minlength=len(self.words))
        held[self.contexts] = np.bincount(self.ui, weights=tables, minlength=len(self.contexts))
        return served, held


def _open_contexts(n_word_buckets: int):
    """A bucket's pairs of all chunks as restaurants, written down for the rounds; every dish has one table."""

    def run(key, table):
        T.trim()
        bucket = key[0].as_py()
        who, us, ws, ns = [], [], [], []
        for head, u, w, ui, wi, n in X.blobs(table):
            who.append(np.frombuffer(head, dtype=np.int64)[0])
            us.append(_unshuffled(u)[np.frombuffer(ui, dtype=np.int32)])
            ws.append(_unshuffled(w)[np.frombuffer(wi, dtype=np.int32)])
            ns.append(np.frombuffer(n, dtype=np.int32))
        sizes = [len(n) for n in ns]
        u, w, n = np.concatenate(us), np.concatenate(ws), np.concatenate(ns)
        del us, ws, ns
        _, at, number = np.unique(T.mix(u * np.uint64(0x9E3779B97F4A7C15) + w, 51), return_index=True, return_inverse=True)
        count = np.bincount(number, weights=n, minlength=len(at)).astype(np.int64)
        seen = np.flatnonzero(count > 0)
        contexts, ui = np.unique(u[at[seen]], return_inverse=True)
        words, wi = np.unique(w[at[seen]], return_inverse=True)
        del u, w
        asks, begin = [], 0
        for chunk, size in zip(who, sizes):  # a chunk's pairs stand in the order of the bucket's
            asks += [np.array([chunk, size]), _bytes(np.diff(number[begin : begin + size], prepend=0))]
            begin += size
        names, both = np.unique(np.concatenate([words, contexts]), return_inverse=True)
        in_names, of_context = both[: len(words)].astype(np.int32), both[len(words) :].astype(np.int32)
        head = np.array([bucket, len(at), len(seen)])
        asks, bits = X.pack(*asks), np.packbits(count > 0)
        state = X.pack(head, asks, bits, _shuffled(names), in_names, of_context, _bytes(ui), _bytes(wi), _bytes(count[seen]))
        served, held = (np.zeros(len(names), dtype=np.int64) for _ in range(2))
        served[in_names], held[of_context] = np.bincount(wi, minlength=len(words)), np.bincount(ui, minlength=len(contexts))
        return X.mail([(-1 - bucket, state), *_told(bucket, names, served, held, n_word_buckets)])

    return run


def _p1(customers, tables, totals, model):
    """The parent's predictive probability of words with so many customers at so many tables (their mean)."""
    _, _, discount0, strength0 = model
    v_all, c0, t0 = totals
    return (customers - discount0 * tables + (strength0 + discount0 * t0) / (v_all + 1)) / (strength0 + c0)


def _seat_contexts(n_word_buckets: int, totals, model, sweeps: int, last: bool, turn: int, seed: int):
    """A round: seat every context's customers again, given the parent; the last one answers the chunks."""
    discount, strength, _, _ = model

    def run(key, table, letters):
        T.trim()
        r = _Restaurants(table.column("blob")[0].as_py())
        seats = Seating(r.c, discount, np.random.default_rng([seed, r.bucket, turn]))
        customers, parent_tables, held = (np.zeros(len(r.names)) for _ in range(3))
        of_word = dict(X.split_by(_of(r.names, n_word_buckets, 55)))
        for head, *rest in X.blobs(letters):
            kind, sender = (int(x) for x in np.frombuffer(head, dtype=np.int64))
            if kind == SEATED:
                seats.resume(np.frombuffer(rest[0], dtype=np.uint8))
                seats.tables[seats.large] = np.frombuffer(rest[1], dtype=np.int64)
            else:
                rank = of_word[sender]
                customers[rank], parent_tables[rank], held[rank] = (_numbers(x, len(rank)) for x in rest)
        p1 = _p1(customers, parent_tables / PARENT_SAMPLES, totals, model)[r.words][r.wi]
        n = len(r.contexts)
        # Tables of the whole context for each table here: 1, but for the parts of a split context.
        share = held[r.contexts] / np.maximum(np.bincount(r.ui, weights=seats.tables, minlength=n), 1)
        total_t = np.zeros(len(r.c), dtype=np.int64)
        for _ in range(sweeps):
            total = share * np.bincount(r.ui, weights=seats.tables, minlength=n)
            seats.sweep((strength + discount * total[r.ui]) * p1)
            total_t += seats.tables
        served, _ = r.sums(seats.tables)
        rows = []
        if last:
            for chunk, (c, t) in r.answers([r.c, total_t]):
                rows.append((-1 - chunk, X.pack(np.array([PAIRS, r.bucket]), _bytes(c), _bytes(t))))
            _, held_now = r.sums(total_t)  # of all samples: for the predictive probability
        else:
            _, held_now = r.sums(seats.tables)
            rows.append((-1 - r.bucket, X.pack(np.array([SEATED, 0]), seats.at.astype(np.uint8), seats.tables[seats.large])))
        return X.mail(rows + _told(r.bucket, r.names, served, held_now, n_word_buckets))

    return run


def _ask_words(n_word_buckets: int, folds: int, fold: int):
    def run(key, table):
        chunk = key[0].as_py()
        word, count, _ = _Tokens(opened(table), folds, fold).words()
        rows = [
            (to, X.pack(np.array([ASKED, chunk]), _shuffled(word[rank]), count[rank].astype(np.int32)))
            for to, rank in X.split_by(_of(word, n_word_buckets, 55))
        ]
        return X.mail(rows)

    return run


ANSWER = "key long, blob binary, n long, v long, served long, c0 long, t0 double"


def _seat_parent(model, n_word_buckets: int, v_all: int | None, turn: int, seed: int):
    """Seat the parent, given the tables of all contexts; answers whoever told or asked."""
    _, _, discount0, strength0 = model

    def run(key, table):
        bucket = key[0].as_py()
        asked, told = [], []
        for head, word, *rest in X.blobs(table):
            kind, who = (int(x) for x in np.frombuffer(head, dtype=np.int64))
            word = _unshuffled(word)
            if kind == ASKED:
                asked.append((who, word, np.frombuffer(rest[0], dtype=np.int32)))
            else:
                told.append((who, word, *(_numbers(x, len(word)) for x in rest)))
        words, number = np.unique(np.concatenate([x[1] for x in asked] + [x[1] for x in told]), return_inverse=True)
        n_asked = sum(len(x[1]) for x in asked)
        summed = lambda x, of: np.bincount(of, weights=np.concatenate(x or [np.zeros(0)]), minlength=len(words)).astype(np.int64)
        count = summed([x[2] for x in asked], number[:n_asked])
        customers = summed([x[2] for x in told], number[n_asked:])
        held = summed([x[3] for x in told], number[n_asked:])
        served = np.flatnonzero(customers > 0)
        seats = Seating(customers[served], discount0, np.random.default_rng([seed, bucket, 1, turn]))
        # The uniform base; before the first answer V is known from this bucket's share of words only.
        base = 1.0 / ((max(1, len(served)) * n_word_buckets if v_all is None else v_all) + 1)
        total_t = np.zeros(len(words), dtype=np.int64)
        for sweep in range(1 + PARENT_SAMPLES):
            total = float(seats.tables.sum()) * n_word_buckets  # words are dealt at random
            seats.sweep(np.full(len(served), (strength0 + discount0 * total) * base))
            if sweep:
                total_t[served] += seats.tables
        keys, out, begin = [], [], 0
        for who, word, *_ in asked or told:
            mine = number[begin : begin + len(word)]
            begin += len(word)
            answer = (_bytes(customers[mine]), _bytes(total_t[mine]), _bytes(held[mine]))
            keys.append(-1 - who)
            out.append(X.pack(np.array([WORDS, bucket]), *([_bytes(count[mine])] if asked else []), *answer))
        n = len(keys)
        first = lambda x: [x] + [0] * n  # noqa: E731  the bucket's totals stand in a row of their own
        return pa.table(
            [
                pa.array([0, *keys], pa.int64()),
                pa.array([b"", *out], pa.binary()),
                pa.array(first(int(count.sum())), pa.int64()),
                pa.array(first(int((count > 0).sum())), pa.int64()),
                pa.array(first(len(served)), pa.int64()),
                pa.array(first(int(customers.sum())), pa.int64()),
                pa.array([float(total_t.sum()) / PARENT_SAMPLES] + [0.0] * n, pa.float64()),
            ],
            names=["key", "blob", "n", "v", "served", "c0", "t0"],
        )

    return run


def _totals(parent: DataFrame):
    return parent.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", "v", "served", "c0", "t0")]).first()


def _score(n_buckets, bins, hot, n_word_buckets, folds, fold, totals, model, samples):
    n_all, v_all, c0, t0 = totals
    discount, strength, _, _ = model

    def run(key, table, answers):
        table = opened(table)
        t = _Tokens(table, folds, fold)
        pair, context, token, _, number = t.pairs()
        word, _, word_number = t.words()
        pair_mass = np.zeros(len(pair))
        count, customers, seated, tables = (np.zeros(len(word), dtype=np.int64) for _ in range(4))
        of_pair = dict(X.split_by(_pair_bucket(pair, context, n_buckets, bins, hot)))
        of_word = dict(X.split_by(_of(word, n_word_buckets, 55)))
        for head, *rest in X.blobs(answers):
            kind, bucket = (int(x) for x in np.frombuffer(head, dtype=np.int64))
            rank = (of_pair if kind == PAIRS else of_word)[bucket]
            got = [_numbers(x, len(rank)) for x in rest]
            if kind == PAIRS:
                pair_mass[rank] = got[0] - discount * (got[1] / samples)
            else:
                count[rank], customers[rank], seated[rank], tables[rank] = got
        p1 = _p1(customers, seated / PARENT_SAMPLES, (v_all, c0, t0), model)
        after = count.copy()  # tokens that follow the word in training
        after[np.searchsorted(word, START)] = count[np.searchsorted(word, END)]
        u, w = np.searchsorted(word, context), np.searchsorted(word, token)
        seen = after[u] > 0
        p = np.where(seen, (pair_mass + (strength + discount * (tables[u] / samples)) * p1[w]) / (strength + after[u]), p1[w])
        logs = np.log10(p)[number]
        base = np.log10((count + 1.0) / (n_all + v_all + 1.0))[word_number]
        known = (count > 0)[word_number]
        begin = t.first[:-1]
        return pa.table(
            [
                table.column("doc_id"),
                pa.array(np.diff(t.first)),
                pa.array(np.add.reduceat(known.astype(np.int64), begin)),
                pa.array(np.add.reduceat(base, begin)),
                pa.array(np.add.reduceat(logs, begin)),
            ],
            names=["doc_id", "n_tokens", "n_known", "base_sum", "score"],
        )

    return run


def score_corpus(
    docs: DataFrame,
    discount: float = 0.85,
    strength: float = 1.0,
    discount0: float = 0.5,
    strength0: float = 1.0,
    burn: int = 1,
    samples: int = 2,
    folds: int = 7,
    fold: int = 2,
    seed: int = 3,
    bucket_bytes: int = 16 << 20,
    chunk_bytes: int = X.CHUNK_BYTES,
) -> DataFrame:
    """doc_id, n_tokens, n_known, base_sum, score, train_tokens, perplexity of every row of ``docs``.

    The model learns from rows whose crc32(doc_id as text) mod ``folds`` is not ``fold``.
    """
    total = X.text_bytes(docs)
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    n_word_buckets = n_buckets
    bins = max(4096, 16 * n_buckets)
    # A bin of contexts that would fill half a bucket is split (few: their shares add up to 1).
    counts = _survey(docs, bins, folds, fold)
    hot = np.array(sorted(X.hot_buckets(counts, n_buckets, factor=0.5, least=20_000)), dtype=np.int64)
    parts = parcelled(docs, total, chunk_bytes)
    model = (discount, strength, discount0, strength0)
    spark = docs.sparkSession
    name = f"lm-contexts-{uuid.uuid4().hex}"
    pairs = parts.groupBy("chunk").applyInArrow(_send_pairs(n_buckets, bins, hot, folds, fold), X.MAIL)
    restaurants = stage(pairs.groupBy("key").applyInArrow(_open_contexts(n_word_buckets), X.MAIL), name)
    del pairs
    X.freed(spark)
    contexts, seated, v_all = restaurants.where("key < 0"), restaurants.where("key >= 0"), None
    letters = None  # the seating of the round before
    for turn in range(burn + 1):
        seat = _seat_parent(model, n_word_buckets, v_all, turn, seed)
        parent = stage(seated.where("key >= 0").groupBy("key").applyInArrow(seat, ANSWER), "lm-parent")
        sums = _totals(parent)
        v_all = int(sums["served"])
        told = parent.where("key < 0").select("key", "blob")
        told = told if letters is None else told.unionByName(letters)
        last = turn == burn
        seat = _seat_contexts(n_word_buckets, (v_all, int(sums["c0"]), float(sums["t0"])), model, samples if last else 1, last, turn, seed)
        seated = stage(contexts.groupBy("key").cogroup(told.groupBy("key")).applyInArrow(seat, X.MAIL), "lm-seated")
        letters = seated.where("key < 0")
        del told
        X.freed(spark)
    release_staged(spark, name)  # read by the rounds only
    asked = parts.groupBy("chunk").applyInArrow(_ask_words(n_word_buckets, folds, fold), X.MAIL)
    seat = _seat_parent(model, n_word_buckets, v_all, burn + 1, seed)
    parent = stage(asked.unionByName(seated.where("key >= 0")).groupBy("key").applyInArrow(seat, ANSWER), "lm-parent")
    del asked
    X.freed(spark)
    sums = _totals(parent)
    totals = (int(sums["n"]), int(sums["v"]), int(sums["c0"]), float(sums["t0"]))
    answers = seated.where("key < 0").unionByName(parent.where("key < 0").select("key", "blob")).select((-1 - F.col("key")).alias("chunk"), "blob")
    finish = _score(n_buckets, bins, hot, n_word_buckets, folds, fold, totals, model, samples)
    scored = parts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, SCORED)
    return scored.select("*", F.lit(totals[0]).cast("bigint").alias("train_tokens"), F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def held_out(folds: int = 7, fold: int = 2):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    scored = score_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", F.col("base_sum").alias("base_score"), "score")
