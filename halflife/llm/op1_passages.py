"""Operator 1: remove repeated word passages (substring dedup) by super-k-mers.

A window is ``k`` consecutive words of a document.  Every word covered by a
window whose word sequence also starts in a document with a smaller id is removed;
windows are judged on the input, so the result does not depend on any order.

Method: the *minimiser* of a window is the smallest hash among its ``m``-word
runs.  Consecutive windows sharing their minimiser travel together as one packed
string of words (a super-k-mer) to the bucket of the minimiser, so every
occurrence of a window meets the others in one bucket.  There the words get
exact numbers, the windows are sorted, and each group of equal windows knows its
smallest document.  Hashes only order: equality is decided on the words' bytes.

Before anything travels, a chunk of documents settles what it can see itself: a
window that also starts in a smaller document of the same chunk is repeated, and only
the others travel.  So a passage copied into a third of all documents sends at
most one window per chunk.  Minimisers that are hot all the same (many
different windows around one frequent run of words) are found by a count over
all windows; their windows travel singly to buckets of their own hash, which
spreads them evenly.

Scale: one shuffle of the texts (shared by both uses), one of the packed strings
(about three times the text before compression), one of small answers.  Chunks
and buckets grow in number, not in size.

Edge cases: null and empty texts have no words and nothing to remove.  Texts
shorter than k words have no window.  White space between words does not count, nor
is it kept: kept words are joined by one space.  A null id is larger than every other
and equal to other nulls.  Repeated rows (same id) do not remove each other, as
neither id is smaller.  An empty table gives an empty result.  Other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halflife.llm import exchange as X
from halflife.llm import text as T
from halflife.llm.parcels import opened, parcelled

KEPT = "doc_id long, n_words long, n_removed long, kept_text string"


class _Chunk:
    """Words and windows of some documents."""

    def __init__(self, table: pa.Table, k: int):
        self.data, offsets = T.flat(table.column("text"))
        self.starts, self.ends, self.first = T.word_spans(self.data, offsets)
        self.doc = np.repeat(np.arange(table.num_rows), np.diff(self.first))
        n = len(self.starts)
        # Windows are named by the number of their first word.
        self.at = np.flatnonzero(self.doc[: max(0, n - k + 1)] == self.doc[k - 1 :]) if n >= k else np.zeros(0, dtype=np.int64)


def _minimisers(h: np.ndarray, k: int, m: int) -> np.ndarray:
    """For every k-word window, the smallest hash of its m-word runs."""
    return T.sliding_min(T.windows(h, m, 3), k - m + 1)


def _bucket(minimiser: np.ndarray, n_buckets: int) -> np.ndarray:
    return (T.mix(minimiser, 4) % np.uint64(n_buckets)).astype(np.int64)


def _buckets(window_hash, minimiser, n_buckets: int, hot: np.ndarray) -> np.ndarray:
    """Bucket of each window; windows of hot minimisers go by their own hash."""
    out = _bucket(minimiser, n_buckets)
    if len(hot):
        out = np.where(np.isin(out, hot), n_buckets + (T.mix(window_hash, 8) % np.uint64(n_buckets)).astype(np.int64), out)
    return out


def _count_windows(docs: DataFrame, k: int, m: int, n_buckets: int) -> DataFrame:
    """(key, n): windows per bucket, as partial counts."""

    def run(batches):
        count = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 4 << 20):
                c = _Chunk(part, k)
                if len(c.at):
                    h = T.word_hashes(c.data, c.starts, c.ends)
                    count += np.bincount(_bucket(_minimisers(h, k, m)[c.at], n_buckets), minlength=n_buckets)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(count[full], pa.int64())], names=["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long")


def slices(batch, limit: int):
    """Parts of a batch with about ``limit`` bytes of text each."""
    at, size = 0, 0
    for i, n in enumerate(batch.column("text").to_pandas().str.len().fillna(0).to_numpy()):
        size += n
        if size >= limit:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def _emit(k: int, m: int, n_buckets: int, hot: np.ndarray):
    def run(key, table):
        chunk, table = key[0].as_py(), opened(table)
        c, ids = _Chunk(table, k), X.ids_of(table)
        if not len(c.at):
            return X.mail([])
        h = T.word_hashes(c.data, c.starts, c.ends)
        words = T.exact_ids(c.data, c.starts, c.ends, h)
        # Settled here: windows that a smaller document of this chunk has too.
        order, new = T.group_windows(words, c.at, k)
        owner = ids[c.doc[c.at]]
        least = np.minimum.reduceat(owner[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        repeated = np.zeros(len(c.at), dtype=bool)
        repeated[order] = owner[order] > least
        rows = [(-1 - chunk, _flags(c.at[repeated]))]
        # Of each further group one window travels; equal ids share the answer.
        travels = ~repeated
        codes, minimiser = T.windows(h, k, 2)[c.at], _minimisers(h, k, m)[c.at]
        bucket = _buckets(codes, minimiser, n_buckets, hot)
        at, bucket, minimiser = c.at[travels], bucket[travels], minimiser[travels]
        if len(at):
            joins = (at[1:] == at[:-1] + 1) & (bucket[1:] == bucket[:-1]) & (minimiser[1:] == minimiser[:-1])
            head = np.flatnonzero(np.concatenate([[True], ~joins]))
            n_windows = np.diff(np.append(head, len(at)))
            begin = at[head]
            plain = _joined(c)
            offset = np.concatenate([[0], np.cumsum(c.ends - c.starts + 1)])
            a, b = offset[begin], offset[begin + n_windows + k - 1]
            owners = ids[c.doc[begin]]
            for to, rank in X.split_by(bucket[head]):
                text = b"".join([plain[x:y] for x, y in zip(a[rank].tolist(), b[rank].tolist())])
                rows.append((to, X.pack(np.int64(chunk), owners[rank], begin[rank].astype(np.int32), n_windows[rank].astype(np.int32), text)))
        return X.mail(rows)

    return run


def _joined(c: _Chunk) -> bytes:
    """All words of the chunk, each with one space after it."""
    length = c.ends - c.starts + 1
    offset = np.cumsum(length) - length
    out = c.data[np.minimum(np.repeat(c.starts - offset, length) + np.arange(int(length.sum())), len(c.data) - 1)]
    out[offset + length - 1] = 32
    return out.tobytes()


def _flags(windows: np.ndarray) -> bytes:
    start, length = X.runs(np.unique(windows))
    return X.pack(start.astype(np.int32), length.astype(np.int32))


def _serve(k: int):
    def run(key, table):
        if key[0].as_py() < 0:
            return table.select(["key", "blob"])
        chunk, owner, begin, n_windows, texts = [], [], [], [], []
        for c, o, b, n, text in X.blobs(table):
            o = np.frombuffer(o, dtype=np.int64)
            chunk.append(np.repeat(np.frombuffer(c, dtype=np.int64), len(o)))
            owner.append(o)
            begin.append(np.frombuffer(b, dtype=np.int32))
            n_windows.append(np.frombuffer(n, dtype=np.int32))
            texts.append(text)
        chunk, owner, begin, n_windows = map(np.concatenate, (chunk, owner, begin, n_windows))
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        del texts
        starts, ends, _ = T.word_spans(data, np.array([0, len(data)]))
        words = T.exact_ids(data, starts, ends, T.word_hashes(data, starts, ends))
        n_words = n_windows.astype(np.int64) + k - 1
        base = np.cumsum(n_words) - n_words
        string = np.repeat(np.arange(len(begin)), n_windows)
        inside = np.arange(len(string)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        order, new = T.group_windows(words, base[string] + inside, k)
        least = np.minimum.reduceat(owner[string][order], np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = order[owner[string][order] > least]
        where, window = chunk[string[hit]], begin[string[hit]] + inside[hit]
        return X.mail([(-1 - c, _flags(window[rank])) for c, rank in X.split_by(where)])

    return run


def _finish(k: int):
    def run(key, table, answers):
        table = opened(table)
        c = _Chunk(table, k)
        known = [[np.frombuffer(x, dtype=np.int32) for x in blob] for blob in X.blobs(answers)]
        start = np.concatenate([x[0] for x in known] or [np.zeros(0, dtype=np.int64)]).astype(np.int64)
        length = np.concatenate([x[1] for x in known] or [np.zeros(0, dtype=np.int64)])
        gone = T.cover(len(c.starts), start, start + length + k - 1)
        n_words = np.diff(c.first)
        n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[c.first])
        kept = ~gone
        length = np.where(kept, c.ends - c.starts + 1, 0)
        c.starts, c.ends = c.starts[kept], c.ends[kept]
        plain = _joined(c) if kept.any() else b""
        cut = np.concatenate([[0], np.cumsum(length)])[c.first]
        texts = [plain[a : max(a, b - 1)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return pa.table(
            [table.column("doc_id").cast(pa.int64()), pa.array(n_words), pa.array(n_removed), pa.array(texts, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_text"],
        )

    return run


def remove_repeated_passages(docs: DataFrame, k: int = 13, m: int = 3, bucket_bytes: int = 3 << 20, chunk_bytes: int = X.CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every row of ``docs`` (doc_id, text)."""
    total = X.text_bytes(docs)
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    hot = np.array(sorted(X.hot_buckets(_count_windows(docs, k, m, n_buckets), n_buckets)), dtype=np.int64)
    parts = parcelled(docs, total, chunk_bytes)
    sent = parts.groupBy("chunk").applyInArrow(_emit(k, m, n_buckets, hot), X.MAIL)
    answers = sent.groupBy("key").applyInArrow(_serve(k), X.MAIL).select((-1 - F.col("key")).alias("chunk"), "blob")
    return parts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_finish(k), KEPT)


def query(spark, sf_dir: str) -> DataFrame:
    kept = remove_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
x AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13
),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM x),
f AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS least FROM g) WHERE doc_id > least),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM f),
r AS (SELECT doc_id, count(*) AS n, list(p) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
    list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(gone, p)), lambda p: w[p]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
