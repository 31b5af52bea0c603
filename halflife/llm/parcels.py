"""Texts packed for the trip to their chunk.

``parcelled(docs)`` deals documents by hash into chunks, as ``exchange.chunked``
does, but the map side packs what one task sends to one chunk into a compressed
parcel.  The texts then cross the network and the disk about three times smaller,
and no row is handled singly.  Operators that read a chunk more than once share the
one shuffle of the parcels.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halflife.llm import exchange as X
from halflife.llm import text as T

PARCELS = "chunk long, parcel binary"


def parcelled(docs: DataFrame, total: int, chunk_bytes: int = X.CHUNK_BYTES, hold_bytes: int = 8 << 20) -> DataFrame:
    """(chunk, parcel): the columns doc_id and text of ``docs``, about ``chunk_bytes`` of text a chunk."""
    n = max(1, math.ceil(total / chunk_bytes))

    def wrap(held: dict[int, list]):
        keys = list(held)
        out = [pa.array(keys, pa.int64()), pa.array([_close(pa.concat_tables(held[k])) for k in keys], pa.binary())]
        return pa.RecordBatch.from_arrays(out, names=["chunk", "parcel"])

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = pa.Table.from_batches([batch.slice(at, 2000)])
                size += int(pc.sum(pc.binary_length(part.column("text"))).as_py() or 0) + 16 * part.num_rows
                chunk = part.column("chunk").to_numpy()
                body = part.select(["doc_id", "text"])
                for key, rows in X.split_by(chunk):
                    held.setdefault(key, []).append(body.take(pa.array(rows)))
                if size > hold_bytes:
                    yield wrap(held)
                    held, size = {}, 0
                    T.trim()
        if held:
            yield wrap(held)

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("chunk"))
    return keyed.mapInArrow(run, PARCELS)


def _close(table: pa.Table) -> bytes:
    data, offsets = T.flat(table.column("text"))
    ids = table.column("doc_id")
    return X.pack(
        pc.fill_null(ids, 0).to_numpy(),
        pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.uint8),
        pc.is_null(table.column("text")).to_numpy(zero_copy_only=False).astype(np.uint8),
        np.diff(offsets),
        data,
    )


def opened(table: pa.Table) -> pa.Table:
    """(doc_id, text as bytes) of a chunk's parcels, in one fixed order."""
    T.trim()  # what the chunk before needed
    parts = []
    for ids, no_id, no_text, sizes, data in (X.unpack(b) for b in table.column("parcel").to_pylist()):
        mask = np.frombuffer(no_id, dtype=np.uint8) > 0
        offsets = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, dtype=np.int64))]).astype(np.int64)
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(mask), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
        gone = np.frombuffer(no_text, dtype=np.uint8) > 0
        if gone.any():
            text = pc.if_else(pa.array(gone), pa.scalar(None, pa.large_binary()), text)
        parts.append(pa.table([pa.array(np.frombuffer(ids, dtype=np.int64), mask=mask), text], names=["doc_id", "text"]))
    return X.in_order(pa.concat_tables(parts))
