"""Operator 4: exact top-k inner products by norm-bucketed retrieval.

Vectors are compared as integers floor(scale * x).  Method:

1. *Buckets.*  Candidates are grouped by length (norm classes of ratio ``ratio``); a
   class with many vectors is dealt by hash into buckets of about ``bucket_rows``.
   A bucket is one packed matrix, longest vectors first.
2. *Seed thresholds.*  Each query block meets buckets of the longest classes, as many
   as it takes to hold one bucket's worth of vectors (k + 1 at least); a query's k-th best score there is a lower bound of
   its final k-th score.  These meetings count: seed buckets are not met again.
3. *Pruning.*  A bucket is not sent to a query block at all if length alone shows
   that nothing in it reaches any of the block's bounds; this is settled on a table
   of lengths and bounds before any matrix moves.  Where they meet, each query
   has a local cosine threshold t = bound / (|q| * longest in the bucket).  Above 1 the
   bucket is skipped.  From ``coordinate_at`` on, coordinate pruning looks at the
   query's largest coordinates: a unit vector with cosine >= t can only lie between
   q_f t -+ sqrt((1 - t^2)(1 - q_f^2)) there; the upper bound holds for q_f < t only,
   the lower one for q_f > -t only.  Below, length pruning takes the bucket's
   prefix of vectors long enough to reach the bound.
4. *Verification.*  The products of what is left are computed exactly; each meeting
   returns its best k, and the final ranking takes the best k over all buckets.

The query set is a stated part of the rows (ids divisible by ``every``), met in
blocks; no pair of rows is made.  Both sides grow in number of blocks, not in size.

Edge cases: null vectors, vectors with null or non-finite components and rows without
an id take no part; an empty vector is the zero vector.  Vectors of different
dimension are compared as if padded with zeros.  Ties go to the smaller id.  An id
stands for one vector: repeated rows of an id count once (if they differ, the
smallest vector counts), so a query never meets its own copies under its own id.
With fewer than k other rows all are returned; an empty table gives an empty
result.  Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halflife.llm import exchange as X
from halflife.session import stage

BLOCK = "block long, longest double, rows long, blob binary"
SLACK = 1e-9  # bounds are doubles; products are whole numbers


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """(vec_id, v, norm) of the rows that take part, one per id."""
    x = F.col(embedding)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & finite)
    v = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("bigint"))
    one = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))
    return one.withColumn("norm", F.sqrt(square))


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Lists of whole numbers as rows of one matrix, padded with zeros."""
    column = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max()) if len(sizes) else 0), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def _pack(rows: pa.Table, order: np.ndarray, *more: np.ndarray) -> bytes:
    m = _matrix(rows.column("v"))[order]
    kind = np.int16 if m.size == 0 or np.abs(m).max() < 2**15 else np.int64
    head = np.array([m.shape[0], m.shape[1], np.dtype(kind).itemsize], dtype=np.int64)
    return X.pack(head, rows.column("vec_id").to_numpy()[order], rows.column("norm").to_numpy()[order], m.astype(kind), *more)


def _unpack(blob: bytes):
    head, ids, norms, m, *more = X.unpack(blob)
    n, d, width = np.frombuffer(head, dtype=np.int64)
    matrix = np.frombuffer(m, dtype=np.int16 if width == 2 else np.int64).reshape(n, d)
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(norms), matrix, [np.frombuffer(x) for x in more]


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """One packed row per value of ``key``, longest vectors first; keeps ``bound`` if there is one."""
    bounded = "bound" in rows.columns

    def run(key, table):
        norms = table.column("norm").to_numpy()
        order = np.lexsort((table.column("vec_id").to_numpy(), -norms))
        more = [table.column("bound").to_numpy()[order]] if bounded else []
        columns = [pa.array([key[0].as_py()]), pa.array([float(norms.max())]), pa.array([len(norms)]), pa.array([_pack(table, order, *more)])]
        return pa.table(columns, names=["block", "longest", "rows", "blob"])

    return rows.groupBy(key).applyInArrow(run, BLOCK)


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    d = min(q.shape[1], p.shape[1])
    q, p = q[:, :d].astype(np.float64), p[:, :d].astype(np.float64)
    most = max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(p).max(initial=0)) * max(1, d)
    if most < 2**53:
        return np.rint(q @ p.T).astype(np.int64)
    return q.astype(np.int64) @ p.astype(np.int64).T


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: higher score first, then smaller id."""
    if len(scores) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= bar)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def meet(query, bucket, k: int, coordinate_at: float, focus: int, counted=None):
    """(query id, ids, scores) of the best k of a bucket for each query that it can still serve.

    ``counted``: called with the number of products of each step.
    """
    counted = counted or (lambda n: None)
    q_ids, q_norms, q, (bounds,) = query
    p_ids, p_norms, p, _ = bucket
    longest = p_norms[0] if len(p_norms) else 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_norms * longest > 0, bounds / (q_norms * longest), np.where(bounds > 0, np.inf, -np.inf))
    by_coordinate = (local >= coordinate_at) & (local <= 1 + SLACK) & np.isfinite(local)
    by_length = local < coordinate_at

    def result(i: int, rows: np.ndarray, scores: np.ndarray):
        other = p_ids[rows] != q_ids[i]
        rows, scores = rows[other], scores[other]
        near = scores >= bounds[i]
        rows, scores = rows[near], scores[near]
        top = _best(p_ids[rows], scores, k)
        return q_ids[i], p_ids[rows][top], scores[top]

    need = np.where(q_norms > 0, bounds / np.maximum(q_norms, 1e-300), -np.inf)
    length_rows = np.flatnonzero(by_length)
    length_rows = length_rows[np.argsort(-need[length_rows], kind="stable")]
    for at in range(0, len(length_rows), 64):
        some = length_rows[at : at + 64]
        # Vectors too short for the weakest bound of these queries are not multiplied.
        least = need[some].min()
        upto = int(np.searchsorted(-p_norms, -(least * (1 - SLACK)), side="right")) if least > 0 else len(p_norms)
        counted(len(some) * upto)
        scores = _products(q[some], p[:upto])
        for j, i in enumerate(some.tolist()):
            yield result(i, np.arange(upto), scores[j])
    unit = None
    for i in np.flatnonzero(by_coordinate).tolist():
        if unit is None:
            unit = p / np.maximum(p_norms, 1e-300)[:, None]
        t = min(1.0, local[i] * (1 - SLACK))
        qi = q[i] / q_norms[i]
        rows = np.arange(len(p_ids))
        for f in np.argsort(-np.abs(qi), kind="stable")[:focus]:
            if f >= unit.shape[1]:
                continue
            reach = math.sqrt(max(0.0, (1 - t * t) * (1 - qi[f] ** 2))) + SLACK
            x = unit[rows, f]
            # Where the cone around the query holds the axis (or its opposite) it has no bound on that side.
            rows = rows[((x >= qi[f] * t - reach) | (qi[f] <= -t)) & ((x <= qi[f] * t + reach) | (qi[f] >= t))]
        counted(len(rows))
        yield result(i, rows, _products(q[i : i + 1], p[rows])[0] if len(rows) else np.zeros(0, dtype=np.int64))


def _meetings(pairs: DataFrame, k: int, coordinate_at: float, focus: int, products=None) -> DataFrame:
    """(b_blob, q_blob) -> (query_id, vec_id, score), at most k rows per query and meeting."""
    counted = None if products is None else products.add

    def run(batches):
        for batch in batches:
            for b, q in zip(batch.column("b_blob"), batch.column("q_blob")):
                found = list(meet(_unpack(q.as_py()), _unpack(b.as_py()), k, coordinate_at, focus, counted))
                if found:
                    n = [len(x[1]) for x in found]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat([x[0] for x in found], n), pa.int64()),
                            pa.array(np.concatenate([x[1] for x in found]), pa.int64()),
                            pa.array(np.concatenate([x[2] for x in found]), pa.int64()),
                        ],
                        names=["query_id", "vec_id", "score"],
                    )

    return pairs.select("b_blob", "q_blob").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    scale: float = 64.0,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    ratio: float = 1.1,
    bucket_rows: int = 4096,
    block_rows: int = 1024,
    coordinate_at: float = 0.7,
    focus: int = 4,
    products=None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query.

    ``products``: an accumulator that counts the inner products computed.
    """
    rows = integer_vectors(vectors, vec_id, embedding, scale)
    length = F.when(F.col("norm") > 0, F.floor(F.log("norm") / math.log(ratio))).otherwise(F.lit(-(10**6))).cast("bigint")
    rows = stage(rows.withColumn("length", length), "topk-vectors")
    seed_rows = max(bucket_rows, k + 1)
    # Norm classes are few (ratio steps between the shortest and the longest vector).
    sizes = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    longer = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "length",
        F.ceil(F.col("n") / bucket_rows).cast("bigint").alias("n_buckets"),
        (F.coalesce(F.sum("n").over(longer), F.lit(0)) < seed_rows).alias("reached"),
    )
    placed = rows.join(sizes, "length").withColumn("sub", F.pmod(F.xxhash64("vec_id", F.lit(4)), F.col("n_buckets")))
    seed = F.col("reached") & (F.col("sub") < math.ceil(2 * seed_rows / bucket_rows))
    # One number for (class, bucket in class, seed or not); classes are whole numbers near zero.
    placed = placed.withColumn("key", (F.col("length") * (1 << 40) + F.col("sub")) * 2 + seed.cast("bigint"))
    buckets = stage(_blocks(placed.select("vec_id", "v", "norm", "key"), "key").select(F.col("block").alias("bucket"), F.col("longest").alias("b_longest"), F.col("blob").alias("b_blob")), "topk-buckets")
    is_seed = F.pmod("bucket", F.lit(2)) == 1

    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", "norm")
    n_blocks = max(1, math.ceil(asked.count() / block_rows))
    asked = asked.withColumn("q_block", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(n_blocks)))

    def blocks_of(queries: DataFrame) -> DataFrame:
        return _blocks(queries, "q_block").select(F.col("block").alias("q_block"), F.col("longest").alias("q_longest"), F.col("blob").alias("q_blob"))

    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("q_block")
    none = F.lit(float("-inf"))
    # Seed buckets are few: those of the longest classes up to seed_rows vectors, and two of the class that reaches them.
    seeds = buckets.where(is_seed).select("b_blob", each).join(blocks_of(asked.withColumn("bound", none)), "q_block")
    first = stage(_meetings(seeds, k, coordinate_at, focus, products), "topk-first")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    bounds = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("seen"))
    bounded = asked.join(bounds, F.col("vec_id") == F.col("query_id"), "left").withColumn("bound", F.coalesce("seen", none)).drop("seen", "query_id")
    blocks = stage(blocks_of(bounded), "topk-queries").join(bounded.groupBy("q_block").agg(F.min("bound").alias("q_least")), "q_block")

    rest = buckets.where(~is_seed)
    lengths = rest.select("bucket", "b_longest", each).join(blocks.select("q_block", "q_longest", "q_least"), "q_block")
    may = lengths.where(F.col("b_longest") * F.col("q_longest") * (1 + SLACK) >= F.col("q_least")).select("bucket", "q_block")
    pairs = may.join(rest.select("bucket", "b_blob"), "bucket").join(blocks.select("q_block", "q_blob"), "q_block")
    met = first.unionByName(_meetings(pairs, k, coordinate_at, focus, products))
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
