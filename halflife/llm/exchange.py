"""Chunks of documents that ask buckets, and buckets that answer chunks.

Several operators compare every piece of every text with all others.  They share
this shape, in which no text meets another text and no row is made per piece:

* documents are dealt by hash into *chunks* of a few MB; a grouped map sees one
  chunk at a time as Arrow and works on it with numpy;
* a chunk sends packed *blobs* to buckets, one row per bucket and chunk; a bucket
  is a group of blobs and answers with blobs addressed to chunks (or buckets of
  a further round);
* a cogrouped map joins a chunk with its answers.

All uses of one chunked frame share a single shuffle of the texts, because their
exchanges are equal and Spark reuses them.
"""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# key: a bucket, or -1 - chunk for what goes straight back to a chunk.
MAIL = "key long, blob binary"
MAIL_ARROW = pa.schema([("key", pa.int64()), ("blob", pa.binary())])
CHUNK_BYTES = 6 << 20


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts (one number; it sizes chunks and buckets)."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def chunked(docs: DataFrame, total: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, text, chunk): documents dealt by hash, about ``chunk_bytes`` each.

    Copies of a text under other ids go to other chunks; a document longer than a
    chunk is a chunk of its own size.
    """
    n = max(1, math.ceil(total / chunk_bytes))
    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("chunk"))


def in_order(table: pa.Table) -> pa.Table:
    """The chunk's documents in one fixed order, whatever order they arrived in."""
    return table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def ids_of(table: pa.Table, null_id: int = np.iinfo(np.int64).max) -> np.ndarray:
    """doc_id as int64; null comes last."""
    return pc.fill_null(table.column("doc_id").cast(pa.int64()), null_id).to_numpy()


def mail(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table([pa.array([k for k, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], schema=MAIL_ARROW)


def pack(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    """Arrays (or bytes) as one compressed blob."""
    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(raw), *map(len, raw)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(raw))


def unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, dtype=np.int64, count=1)[0])
    sizes = np.frombuffer(raw, dtype=np.int64, count=n, offset=8)
    out, at = [], 8 * (n + 1)
    for size in sizes:
        out.append(raw[at : at + size])
        at += int(size)
    return out


def blobs(table: pa.Table, column: str = "blob"):
    """Unpacked blobs of a group, in a fixed order."""
    return [unpack(b) for b in sorted(table.column(column).to_pylist())]


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct integers as (start, length) runs."""
    if len(sorted_values) == 0:
        return sorted_values, sorted_values
    cut = np.flatnonzero(np.diff(sorted_values) != 1) + 1
    start = sorted_values[np.concatenate([[0], cut])]
    return start, np.diff(np.concatenate([[0], cut, [len(sorted_values)]]))


def split_by(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(key, positions) for every distinct key; positions ascend."""
    if len(keys) == 0:
        return []
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    cuts = np.flatnonzero(s[1:] != s[:-1]) + 1
    return [(int(keys[part[0]]), part) for part in np.split(order, cuts)]


def freed(spark) -> None:
    """Let Spark's cleaner drop the shuffles of frames that a written table has replaced.

    It drops them when the driver's garbage is collected; waiting for that to happen by
    itself would keep every round's shuffle on disk at once.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hot_buckets(counts: DataFrame, n_buckets: int, factor: float = 8.0, least: int = 50_000) -> set[int]:
    """Buckets holding over ``factor`` times the mean, from (key, n) partial counts.

    At most n_buckets / factor numbers reach the driver, whatever the data are.
    """
    total = counts.groupBy("key").agg(F.sum("n").alias("n"))
    bar = total.agg(F.sum("n").cast("double") / n_buckets * factor).scalar()
    return {r["key"] for r in total.where((F.col("n") > bar) & (F.col("n") > least)).select("key").collect()}
