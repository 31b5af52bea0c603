"""Operator 8: byte-level BPE encoding and decoding as a monoid tree reduction.

A piece (one match of the split pattern) is encoded by halves: encode the left
and the right half, then join the two token lists.  A join first asks whether
the tokens at the seam are *compatible*, that is, whether the bytes of the two
together encode to just these two.  If not, a window around the seam is
encoded anew and grown on the side whose border token changed, until both
borders are compatible with their outer neighbours.  A token list in which every
neighbouring pair is compatible is the BPE encoding of its bytes, so nothing
outside the window can change: the join is exact, not a heuristic.  Decoding
concatenates the tokens' bytes, halves first, up the same kind of tree.

Joining is associative, so a piece of any length costs n log n and no piece
needs one long merge loop.  Results of short pieces are cached per worker in a
table of bounded size (a cache, not a limit: what is not in it is encoded).

Scale: a narrow map over the rows, no shuffle; a worker holds one slice of a
batch at a time.  A lost executor's rows are simply mapped again.

Edge cases: null text is the empty text (no tokens, empty bytes).  Whole texts
are encoded, never a prefix.  A null doc_id and repeated rows pass through row by
row.  An empty table gives an empty result.  Other columns are passed through,
unless they are called like an output, in which case the output replaces them.
"""

from __future__ import annotations

import base64
import heapq
import struct

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

# White space as the rank files' library counts it (Unicode White_Space).
_SPACE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def split_pattern(pattern: str) -> str:
    """The pattern with every \\s spelled out, inside and outside of classes."""
    return pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


_NONE = 1 << 62


class TreeBpe:
    """Encoder and decoder for one table of ranks (token bytes -> id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 400_000):
        import regex

        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.pieces = regex.compile(split_pattern(pattern)).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.halves: dict[bytes, list[int]] = {}
        self.packed = _Packed(self, cache)

    # ---- joins

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE of a short window: always the lowest-ranked neighbouring pair, leftmost first."""
        ranks, n = self.ranks, len(data)
        if n <= 16:  # few parts: look at all pairs each time
            parts = [data[i : i + 1] for i in range(n)]
            while len(parts) > 1:
                found = [ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
                least = min(found)
                if least == _NONE:
                    break
                i = found.index(least)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            return [ranks[x] for x in parts]
        end = list(range(1, n + 1))  # end[i]: where the part that begins at i ends
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] - i != size or ranks.get(data[i : end[j]]) != r:
                continue
            alive[j] = False
            end[i] = e = end[j]
            if e < n:
                before[e] = i
                if (r := ranks.get(data[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e] - i))
            if (b := before[i]) >= 0 and (r := ranks.get(data[b:e])) is not None:
                heapq.heappush(heap, (r, b, e - b))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def compatible(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            known = self.fits[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        if self.compatible(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            window = b"".join([self.tokens[t] for t in left[-a:]] + [self.tokens[t] for t in right[:b]])
            middle = self.merge(window)
            holds_left = a == len(left) or self.compatible(left[-a - 1], middle[0])
            holds_right = b == len(right) or self.compatible(middle[-1], right[b])
            if holds_left and holds_right:
                return left[: len(left) - a] + middle + right[b:]
            a = a if holds_left else min(len(left), 2 * a)
            b = b if holds_right else min(len(right), 2 * b)

    def tree(self, data: bytes) -> list[int]:
        if len(data) == 1:
            return [self.ranks[data]]
        known = self.halves.get(data)
        if known is None:
            half = len(data) // 2
            known = self.join(self.tree(data[:half]), self.tree(data[half:]))
            if len(data) <= 8:  # short halves come back in many words
                if len(self.halves) > 300_000:
                    self.halves.clear()
                self.halves[data] = known
        return known

    # ---- texts

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.tree(data)

    def encode_packed(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> list[int]:
        ids = self.encode_packed(text)
        return list(struct.unpack(f"<{len(ids) // 4}I", ids))

    def decode(self, ids) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Packed(dict):
    """Piece -> its ids as bytes; filled on demand, emptied when full."""

    def __init__(self, coder: TreeBpe, limit: int):
        super().__init__()
        self.coder, self.limit = coder, limit

    def __missing__(self, piece: str) -> bytes:
        ids = self.coder.encode_piece(piece.encode())
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 40:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = out
        return out


_CODERS: dict[tuple[str, str], TreeBpe] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def coder(path: str, pattern: str) -> TreeBpe:
    """The worker's coder for a rank file (read once per worker)."""
    key = (path, pattern)
    if key not in _CODERS:
        _CODERS[key] = TreeBpe(read_ranks(path), pattern)
    return _CODERS[key]


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20):
    """Slices of a batch with about ``limit`` characters of text each."""
    at, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        size += n or 0
        if size >= limit:
            yield batch.slice(at, i + 1 - at)
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def _mapped(df: DataFrame, reads: str, adds: list[StructField], work) -> DataFrame:
    """``df`` with ``adds`` computed slice by slice from the column ``reads``."""
    names = {f.name for f in adds}
    keep = [f for f in df.schema.fields if f.name not in names]
    kept = [f.name for f in keep]

    def run(batches):
        for batch in batches:
            for part in _slices(batch, reads):
                new = work(part.column(reads).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + new, names=kept + [f.name for f in adds])

    return df.mapInArrow(run, StructType(keep + adds))


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``out``: the text's ids, packed as little-endian unsigned 32-bit integers."""
    path, pattern = (path, pattern) if path else default_ranks()

    def work(texts):
        bpe = coder(path, pattern)
        return [pa.array([bpe.encode_packed(t) if t else b"" for t in texts], pa.binary())]

    return _mapped(df, text, [StructField(out, BinaryType())], work)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``out``: the bytes that the packed ids stand for."""
    path, pattern = (path, pattern) if path else default_ranks()

    def work(packed):
        bpe = coder(path, pattern)
        return [pa.array([bpe.decode(struct.unpack(f"<{len(p) // 4}I", p)) if p else b"" for p in packed], pa.binary())]

    return _mapped(df, ids, [StructField(out, BinaryType())], work)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    both = decode(encode(docs.select("doc_id", "text")).drop("text"))
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast(LongType()).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
