"""Operator 2: remove repeated lines by a deletion-neighbourhood join.

A line is what stands between line feeds, read as its words.  A line goes if an
earlier line (smaller document id, or same id and smaller line number) has the same
words, or - for lines of at least ``near_words`` words - words at edit distance 1: one
word changed, put in or left out.  Lines are judged on the input, so the earliest
of a group stays and nothing depends on any order of work.  Lines of fewer than
``least_words`` words (blank ones too) always stay.

Method:

1. *Copies.*  Each chunk of documents sends the 128-bit digests of its distinct lines,
   with their first occurrence, to buckets; later occurrences are removed.
2. *Candidates.*  Two lines at distance 1 share their first or their last four
   words (one edit cannot touch both).  Lines that share neither with another
   line drop out here; this loses nothing.
3. *Deletion neighbourhood.*  The first occurrence of each remaining line sends hashed
   keys of all its variants with one word left out.  Two kinds of keys: variant
   and place (equal for two lines that differ in that word only), and variant as a
   whole line (equal for a line and one that has a word more).  With these keys
   every two lines that meet are at distance 1, so the earliest of a key is a
   witness against all others of it: a star, not all pairs.
4. *Verification.*  Each line and its witness are compared by edit distance on their
   words; only confirmed pairs count.

Scale: texts cross the network once, packed; digests and keys travel packed, one
row per bucket and chunk; a very frequent line or beginning sends one entry per
chunk.  Only lines with a proposed witness are joined as rows.

Edge cases: null text is the empty text (one blank line).  Null ids come last in the
order.  Repeated rows (same id and text) do not remove each other, as neither is
earlier.  An empty table gives an empty result.  Other columns are not read by
``repeated_lines``; ``drop_repeated_lines`` passes them through.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halflife.llm import exchange as X
from halflife.llm import text as T
from halflife.llm.parcels import opened, parcelled
from halflife.session import release_staged, stage

KEPT = "doc_id long, th long, n_lines long, n_words long, n_removed long, kept_text string"
COPIES, FIRST_WORDS, LAST_WORDS = 0, 1, 2
SELF, SHORTER, CHANGED = 0, 1, 2
EDGE = 4


class _Lines:
    """Lines of a chunk with their words; numbered through the chunk."""

    def __init__(self, table: pa.Table):
        self.ids = X.ids_of(table)
        self.data, offsets = T.flat(table.column("text"))
        self.starts, self.ends, _ = T.word_spans(self.data, offsets)
        feeds = np.flatnonzero(self.data == 10)
        n_docs = table.num_rows
        self.n_lines = np.diff(np.searchsorted(feeds, offsets)) + 1
        self.base = np.concatenate([[0], np.cumsum(self.n_lines)])
        # A line begins where its text does or after a feed; lines without words share the place of the next one.
        begins = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
        cut = np.append(np.searchsorted(self.starts, begins), len(self.starts))
        self.first, self.size = cut[:-1], np.diff(cut)  # first word and number of words
        self.doc = np.repeat(np.arange(n_docs), self.n_lines)
        self.number = np.arange(self.base[-1]) - self.base[self.doc]
        h = T.word_hashes(self.data, self.starts, self.ends)
        self.h = h
        # Running sums of words times a number of their place in the line, and of the place before: the
        # hash of any line, with or without one of its words.  Two digests with numbers of their own.
        self.place = np.arange(len(h)) - np.repeat(self.first, self.size)
        self.sums = [np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self._value(seed) * self._by(seed)[self.place])]) for seed in (61, 62)]

    def _value(self, seed: int) -> np.ndarray:
        return T.mix(self.h, seed)

    def _by(self, seed: int) -> np.ndarray:
        return T.multipliers(int(self.place.max()) + 2 if len(self.h) else 1, 80 + seed)

    def digest(self, lines: np.ndarray, which: int) -> np.ndarray:
        a, b = self.first[lines], self.first[lines] + self.size[lines]
        return T.mix(self.sums[which][b] - self.sums[which][a] + self.size[lines].astype(np.uint64), 63)

    def without(self, lines: np.ndarray):
        """(line, place, digest of the line without the word there) for every word of the lines."""
        n = self.size[lines]
        line = np.repeat(lines, n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        a, b = self.first[line], self.first[line] + self.size[line]
        left = self.sums[0][a + place] - self.sums[0][a]
        moved = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self._value(61) * self._by(61)[self.place - 1])])
        right = moved[b] - moved[a + place + 1]
        return line, place, T.mix(left + right + (self.size[line] - 1).astype(np.uint64), 63)

    def words(self, line: int) -> str:
        a = self.first[line]
        b = a + self.size[line]
        return b" ".join(self.data[self.starts[a] : self.ends[b - 1]].tobytes().split()).decode() if a < b else ""


def _earliest(keys: list[np.ndarray], doc: np.ndarray, number: np.ndarray):
    """(order, True where a group of equal keys begins); a group's first entry is its earliest."""
    order = np.lexsort((number, doc, *reversed(keys)))
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, new


def _distinct(c: _Lines, least_words: int):
    """(lines that stand for a distinct line here, all lines with words, the one that stands for each)."""
    lines = np.flatnonzero(c.size >= least_words)
    keys = [c.digest(lines, 0), c.digest(lines, 1)]
    order, new = _earliest(keys, c.ids[c.doc[lines]], c.number[lines])
    head = order[new][np.cumsum(new) - 1] if len(order) else order
    return np.sort(lines[order[new]]), lines[order], lines[head]


def _near_lines(c: _Lines, lines: np.ndarray, near_words: int):
    """Lines that can have near copies, with the hashes of their first and last words."""
    near = lines[c.size[lines] >= near_words]
    four = T.windows(c.h, EDGE, 64)
    return near, T.mix(four[c.first[near]], 65), T.mix(four[c.first[near] + c.size[near] - EDGE], 66)


def _of(h: np.ndarray, n: int) -> np.ndarray:
    return (T.mix(h, 67) % np.uint64(n)).astype(np.int64)


def _send_digests(n_buckets: int, least_words: int, near_words: int):
    def run(key, table):
        chunk, c = key[0].as_py(), _Lines(opened(table))
        lines, _, _ = _distinct(c, least_words)
        h1, h2 = c.digest(lines, 0), c.digest(lines, 1)
        rows = []
        for to, rank in X.split_by(_of(h1, n_buckets)):
            rows.append((to, X.pack(np.array([COPIES, chunk, to]), h1[rank], h2[rank], c.ids[c.doc[lines[rank]]], c.number[lines[rank]])))
        near, first, last = _near_lines(c, lines, near_words)
        d = c.digest(near, 0)
        for kind, edge in ((FIRST_WORDS, first), (LAST_WORDS, last)):
            for to, rank in X.split_by(_of(edge, n_buckets)):
                rows.append((to, X.pack(np.array([kind, chunk, to]), edge[rank], d[rank])))
        return X.mail(rows)

    return run


def _answer_digests(key, table):
    """Per line sent: is it the first of its copies?  Does another line share its edge?"""
    by_kind: dict[int, list] = {}
    for head, *rest in X.blobs(table):
        kind, chunk, bucket = (int(x) for x in np.frombuffer(head, dtype=np.int64))
        by_kind.setdefault(kind, []).append((chunk, bucket, rest))
    rows = []
    for kind, sent in by_kind.items():
        columns = [np.concatenate([np.frombuffer(r[i], dtype=np.uint64 if i < 2 else np.int64) for _, _, r in sent]) for i in range(len(sent[0][2]))]
        if kind == COPIES:
            order, new = _earliest(columns[:2], columns[2], columns[3])
            head = order[new][np.cumsum(new) - 1]
            flag = np.zeros(len(order), dtype=np.uint8)  # 1: earliest of all copies; 0: a later one
            flag[order] = (columns[2][order] == columns[2][head]) & (columns[3][order] == columns[3][head])
        else:
            _, number = np.unique(columns[0], return_inverse=True)
            pairs = np.unique(np.stack([number.astype(np.uint64), columns[1]]), axis=1)
            flag = (np.bincount(pairs[0].astype(np.int64), minlength=number.max() + 1)[number] > 1).astype(np.uint8)
        at = 0
        for chunk, bucket, rest in sent:
            n = len(rest[0]) // 8
            rows.append((-1 - chunk, X.pack(np.array([kind, bucket]), flag[at : at + n])))
            at += n
    return X.mail(rows)


def _read_answers(answers: pa.Table):
    out = {}
    for head, flag, *_ in X.blobs(answers):
        kind, bucket = (int(x) for x in np.frombuffer(head, dtype=np.int64))
        out.setdefault(kind, {})[bucket] = np.frombuffer(flag, dtype=np.uint8)
    return out


def _is_first(c: _Lines, lines: np.ndarray, n_buckets: int, flags: dict) -> np.ndarray:
    first = np.ones(len(lines), dtype=bool)
    for to, rank in X.split_by(_of(c.digest(lines, 0), n_buckets)):
        first[rank] = flags[COPIES][to] > 0
    return first


VARIANTS = "key long, blob binary, chunk long, line long, words string"


def _send_variants(n_buckets: int, least_words: int, near_words: int):
    def run(key, table, answers):
        chunk, c = key[0].as_py(), _Lines(opened(table))
        flags = _read_answers(answers)
        lines, _, _ = _distinct(c, least_words)
        first = set(lines[_is_first(c, lines, n_buckets, flags)].tolist())
        near, head, tail = _near_lines(c, lines, near_words)
        shares = np.zeros(len(near), dtype=bool)
        for kind, edge in ((FIRST_WORDS, head), (LAST_WORDS, tail)):
            for to, rank in X.split_by(_of(edge, n_buckets)):
                shares[rank] |= flags[kind][to] > 0
        # Copies of one line share its edges too; only first occurrences send variants.
        mine = np.array([x for x in near[shares].tolist() if x in first], dtype=np.int64)
        line, place, short = c.without(mine)
        keys = np.concatenate([T.mix(c.digest(mine, 0), 68), T.mix(short, 68), T.mix(short + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 69)])
        role = np.repeat(np.array([SELF, SHORTER, CHANGED], dtype=np.uint8), [len(mine), len(line), len(line)])
        owner = np.concatenate([mine, line, line])
        rows = []
        for to, rank in X.split_by(_of(keys, n_buckets)):
            # Lines once, keys by steps through them (mostly 0 and 1).
            who, place = np.unique(owner[rank], return_inverse=True)
            steps = np.diff(place, prepend=0).astype(np.int32)
            rows.append((to, X.pack(np.array([chunk]), keys[rank], role[rank], steps, c.ids[c.doc[who]], c.number[who].astype(np.int32), who.astype(np.int32))))
        n, m = len(rows), len(mine)
        return pa.table(
            [
                pa.array([r[0] for r in rows] + [None] * m, pa.int64()),
                pa.array([r[1] for r in rows] + [None] * m, pa.binary()),
                pa.array([None] * n + [chunk] * m, pa.int64()),
                pa.array([None] * n + mine.tolist(), pa.int64()),
                pa.array([None] * n + [c.words(x) for x in mine.tolist()], pa.string()),
            ],
            names=["key", "blob", "chunk", "line", "words"],
        )

    return run


PAIRS = "chunk long, line long, w_chunk long, w_line long"


def _witnesses(key, table):
    """For every line the earliest line that shares a key and is at distance 1."""
    chunk, keys, role, doc, number, line = [], [], [], [], [], []
    for c, k, r, steps, d, n, x in X.blobs(table):
        place = np.cumsum(np.frombuffer(steps, dtype=np.int32))
        keys.append(np.frombuffer(k, dtype=np.uint64))
        chunk.append(np.repeat(np.frombuffer(c, dtype=np.int64), len(keys[-1])))
        role.append(np.frombuffer(r, dtype=np.uint8))
        doc.append(np.frombuffer(d, dtype=np.int64)[place])
        number.append(np.frombuffer(n, dtype=np.int32).astype(np.int64)[place])
        line.append(np.frombuffer(x, dtype=np.int32).astype(np.int64)[place])
    chunk, keys, role, doc, number, line = map(np.concatenate, (chunk, keys, role, doc, number, line))
    found = []
    # A line against its shorter neighbours' longer forms: SELF meets SHORTER, both ways.  CHANGED meets CHANGED.
    for mine, theirs in ((SELF, SHORTER), (SHORTER, SELF), (CHANGED, CHANGED)):
        b = np.flatnonzero(role == theirs)
        a = np.flatnonzero(role == mine)
        if not len(a) or not len(b):
            continue
        order, new = _earliest([keys[b]], doc[b], number[b])
        head = b[order[new]]
        at = np.searchsorted(keys[head], keys[a])
        at = np.minimum(at, len(head) - 1)
        w = head[at]
        later = (keys[w] == keys[a]) & ((doc[w] < doc[a]) | ((doc[w] == doc[a]) & (number[w] < number[a])))
        found.append(np.stack([chunk[a[later]], line[a[later]], chunk[w[later]], line[w[later]]]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((4, 0), dtype=np.int64)
    return pa.table([pa.array(p) for p in pairs], names=["chunk", "line", "w_chunk", "w_line"])


def edit_distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def within_one(a: list[str], b: list[str]) -> bool:
    """Edit distance at most 1: what common ends leave over is compared."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return edit_distance(a[i : len(a) - j], b[i : len(b) - j]) <= 1


def _verified(batches):
    for batch in batches:
        ok = [within_one(x.split(" "), y.split(" ")) for x, y in zip(batch.column("words").to_pylist(), batch.column("w_words").to_pylist())]
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("chunk").filter(keep), batch.column("line").filter(keep)], names=["chunk", "line"])


def _gather(key, table):
    """The lines of a chunk that are near copies, as one blob."""
    lines = np.unique(table.column("line").to_numpy())
    return X.mail([(-1 - key[0].as_py(), X.pack(np.array([-1, -1]), np.zeros(0, dtype=np.uint8), lines))])


def _finish(n_buckets: int, least_words: int):
    def run(key, table, answers):
        table = opened(table)
        c = _Lines(table)
        flags = _read_answers(answers)
        lines, copy, original = _distinct(c, least_words)
        gone = np.zeros(len(c.size), dtype=bool)
        gone[lines[~_is_first(c, lines, n_buckets, flags)]] = True
        for head, _, *near in X.blobs(answers):
            if near:
                gone[np.frombuffer(near[0], dtype=np.int64)] = True
        # A copy goes if it is later, or with the line that stands for it (a repeated row's line).
        later = (c.ids[c.doc[copy]] != c.ids[c.doc[original]]) | (c.number[copy] != c.number[original])
        gone[copy] |= later | gone[original]
        texts = [t.decode() if t is not None else "" for t in table.column("text").to_pylist()]
        removed = np.add.reduceat(gone.astype(np.int64), c.base[:-1])
        kept = []
        for i, text in enumerate(texts):
            if removed[i]:
                text = "\n".join(x for x, g in zip(text.split("\n"), gone[c.base[i] : c.base[i + 1]].tolist()) if not g)
            kept.append(text)
        # The same number as Spark's xxhash64(text): with the id it names the row.
        th = [xxhash.xxh64_intdigest(t.encode(), seed=42) for t in texts]
        n_words = np.add.reduceat(np.where(gone, 0, c.size), c.base[:-1])
        return pa.table(
            [table.column("doc_id"), pa.array(np.array(th, dtype=np.uint64).astype(np.int64)), pa.array(c.n_lines), pa.array(n_words), pa.array(removed), pa.array(kept, pa.string())],
            names=["doc_id", "th", "n_lines", "n_words", "n_removed", "kept_text"],
        )

    return run


def repeated_lines(
    docs: DataFrame, least_words: int = 3, near_words: int = 8, bucket_bytes: int = 8 << 20, chunk_bytes: int = 3 << 20
) -> DataFrame:
    """doc_id, th (xxhash64 of the text), n_lines, n_words (kept ones), n_removed, kept_text of every row of ``docs``."""
    if near_words < 2 * EDGE:
        raise ValueError(f"near_words must be at least {2 * EDGE}")
    total = X.text_bytes(docs)
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    parts = parcelled(docs, total, chunk_bytes)
    sent = parts.groupBy("chunk").applyInArrow(_send_digests(n_buckets, least_words, near_words), X.MAIL)
    answers = stage(sent.groupBy("key").applyInArrow(_answer_digests, X.MAIL), "line-copies")
    del sent
    X.freed(docs.sparkSession)
    to_chunk = answers.select((-1 - F.col("key")).alias("chunk"), "blob")
    variants = parts.groupBy("chunk").cogroup(to_chunk.groupBy("chunk")).applyInArrow(_send_variants(n_buckets, least_words, near_words), VARIANTS)
    name = f"line-variants-{uuid.uuid4().hex}"
    variants = stage(variants, name)
    X.freed(docs.sparkSession)
    pairs = variants.where("key is not null").select("key", "blob").groupBy("key").applyInArrow(_witnesses, PAIRS).distinct()
    texts = variants.where("key is null").select("chunk", "line", "words")
    of_witness = texts.select(F.col("chunk").alias("w_chunk"), F.col("line").alias("w_line"), F.col("words").alias("w_words"))
    near = pairs.join(texts, ["chunk", "line"]).join(of_witness, ["w_chunk", "w_line"]).select("chunk", "line", "words", "w_words")
    near = near.mapInArrow(_verified, "chunk long, line long").groupBy("chunk").applyInArrow(_gather, X.MAIL)
    # Written down, so that variants and their shuffles are gone before the texts travel once more.
    near = stage(near, "line-near")
    release_staged(docs.sparkSession, name)
    del variants, pairs, texts, of_witness
    X.freed(docs.sparkSession)
    known = answers.unionByName(near).select((-1 - F.col("key")).alias("chunk"), "blob")
    return parts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_finish(n_buckets, least_words), KEPT)


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without repeated lines; all columns pass through, n_chars (if there) follows the text.

    Documents that lose all their words this way are copies line by line, and go;
    documents that had no words stay as they are.
    """
    found = repeated_lines(docs, **options).where("n_removed > 0").dropDuplicates(["doc_id", "th"])
    found = found.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("n_words").alias("__left"), F.col("kept_text").alias("__kept"))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    out = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (key == F.col("__th")), "left")
    out = out.where(F.col("__th").isNull() | (F.col("__left") > 0))
    text = F.coalesce("__kept", "text")
    new = {"text": text} | ({"n_chars": F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("__kept").cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return out.withColumns(new).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    out = repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS no FROM d),
w AS (SELECT doc_id, no, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM l),
s AS (SELECT doc_id, no, w, len(w) AS n, row_number() OVER (ORDER BY doc_id, no) AS o FROM w WHERE len(w) >= 3),
u AS (SELECT w, any_value(n) AS n, min(o) AS o FROM s GROUP BY w),
c AS (SELECT * FROM u WHERE n >= 8),
e AS (SELECT a.w, a.o FROM c a JOIN c b ON a.w[1:4] = b.w[1:4] AND b.o < a.o AND abs(a.n - b.n) <= 1
      AND len(list_filter(range(1, greatest(a.n, b.n) + 1), lambda p:
        (a.n >= b.n AND a.w[1:p - 1] = b.w[1:p - 1] AND a.w[p + 1:a.n] = b.w[p + CASE WHEN a.n = b.n THEN 1 ELSE 0 END:b.n])
        OR (a.n < b.n AND a.w[1:p - 1] = b.w[1:p - 1] AND a.w[p:a.n] = b.w[p + 1:b.n]))) > 0
      UNION
      SELECT a.w, a.o FROM c a JOIN c b ON a.w[-4:] = b.w[-4:] AND b.o < a.o AND abs(a.n - b.n) <= 1
      AND len(list_filter(range(1, greatest(a.n, b.n) + 1), lambda p:
        (a.n >= b.n AND a.w[1:p - 1] = b.w[1:p - 1] AND a.w[p + 1:a.n] = b.w[p + CASE WHEN a.n = b.n THEN 1 ELSE 0 END:b.n])
        OR (a.n < b.n AND a.w[1:p - 1] = b.w[1:p - 1] AND a.w[p:a.n] = b.w[p + 1:b.n]))) > 0),
g AS (SELECT s.doc_id, s.no FROM s JOIN u USING (w) WHERE s.o > u.o UNION SELECT s.doc_id, s.no FROM s JOIN e ON s.o = e.o),
k AS (SELECT w.doc_id, w.no, w.line, g.no IS NOT NULL AS gone FROM w LEFT JOIN g ON w.doc_id = g.doc_id AND w.no = g.no)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
