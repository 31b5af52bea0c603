"""Operator 12: what filters remove alone, together and in every order.

``audit(rows, names)`` takes one row per document with its *part*, the bit mask of the
filters it fails (bit i: filter i), whether it is good and whether it is toxic, and
tells for every part, every order of the filters and every step what is removed there.

Method: exact constrained least squares.

* Documents are counted per (part, mask) first; everything after that is
  arithmetic on one row per part.  For k filters, v(S) is the number of documents that
  the coalition S of filters removes together: all 2^k values are tabulated.
* A step that applies f after the filters P removes v(P + f) - v(P): coalition
  differences supply all step counts, for documents, good and toxic ones alike.
* Shapley values are the weights phi that minimise the sum over all proper coalitions of
  w(|S|) (v(S) - sum of phi in S)^2 with w(s) = (k - 1) / (C(k, s) s (k - s)), under the
  constraint that they add up to v of all filters.  The bordered normal equations do
  not depend on the data: they are solved once in rationals (``shapley_map``), which
  gives every phi as an exact integer combination of the 2^k values over k!.

Exact copies (filter E) need the smallest id of each text.  Texts travel as their
SHA-256; copies with one part and label are counted before they meet, so a text that a
third of all rows share is a few rows per task.

Scale: two shuffles of about 60 bytes a document (labels, digests), then tables of
parts.  No text is shuffled.  Orders are a literal of k! k entries, five filters make 600.

Edge cases: a null text is the empty text (no words: it fails A; of two the later is a
copy).  A null source is the part ''.  A null id is larger than every other id and equal
to other nulls, and has no label.  Repeated rows (same id, same text) count each and
are not copies of each other.  Several labels of one id: good or toxic if any says so.
An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
NAMES = "ABCDE"
NO_ID = (1 << 63) - 1


# ---------------------------------------------------------------- Shapley by least squares


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """The rows x with ``matrix x = right`` (several right sides), by elimination in rationals."""
    rows = [list(a) + list(b) for a, b in zip(matrix, right)]
    n = len(rows)
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        lead = rows[i][i]
        rows[i] = [x / lead for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i])]
    return [row[n:] for row in rows]


def shapley_map(k: int) -> list[list[int]]:
    """c with k! phi_i = sum over S of c[i][S] v(S): the least-squares solution as integers.

    Normal equations: sum over S of w(S) 1_S 1_S^T phi + lambda 1 = sum of w(S) 1_S v(S), and
    1^T phi = v(all).  The right side is linear in v, so one elimination with a column per
    coalition solves them for every v.
    """
    full = (1 << k) - 1
    a = [[Fraction(0)] * (k + 1) for _ in range(k + 1)]
    b = [[Fraction(0)] * (full + 1) for _ in range(k + 1)]
    for s in range(1, full):
        inside = [i for i in range(k) if s >> i & 1]
        weight = Fraction(k - 1, comb(k, len(inside)) * len(inside) * (k - len(inside)))
        for i in inside:
            b[i][s] += weight
            for j in inside:
                a[i][j] += weight
    for i in range(k):
        a[i][k] = a[k][i] = Fraction(1)
    b[k][full] = Fraction(1)
    scaled = [[factorial(k) * x for x in row] for row in solve(a, b)[:k]]
    if any(x.denominator != 1 for row in scaled for x in row):
        raise ArithmeticError("the solution is not a multiple of 1 / k!")
    return [[int(x) for x in row] for row in scaled]


# ---------------------------------------------------------------- the audit


def _literal(values: list, schema: str) -> Column:
    """A nested constant as one literal, not as an expression per entry."""
    return F.from_json(F.lit(json.dumps({"x": values})), f"struct<x:{schema}>")["x"]


def _coalitions(entries: Column, of: str, k: int) -> Column:
    """v(S) for every S: the documents whose mask meets S, from at most 2^k (mask, counts) entries."""

    def value(s: Column) -> Column:
        def add(total: Column, e: Column) -> Column:
            return total + F.when(e["mask"].bitwiseAND(s) > 0, e[of]).otherwise(F.lit(0))

        return F.aggregate(entries, F.lit(0).cast("bigint"), add)

    return F.transform(F.sequence(F.lit(0), F.lit((1 << k) - 1)), value)


STEPS = "array<struct<filter_order:string,step:int,f:int,before:int,after:int>>"


def steps(names: str) -> list[dict]:
    """Every order and step: order, step, filter, coalition before and after."""
    out = []
    for order in permutations(range(len(names))):
        text, before = "".join(names[i] for i in order), 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            out.append({"filter_order": text, "step": step, "f": f, "before": before, "after": after})
            before = after
    return out


def audit(rows: DataFrame, names: str = NAMES) -> DataFrame:
    """Rows (part, mask int, good, toxic boolean, n long: how many such documents) -> one row per
    part, filter_order and step, with kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley.
    """
    k = len(names)
    every = F.lit((1 << k) - 1)
    zero = F.lit(0).cast("bigint")
    counted = rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(zero)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(zero)).alias("toxic"),
    )
    # At most 2^k rows a part.
    table = counted.groupBy("part").agg(F.sum("n").alias("total"), F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("e"))
    table = table.select("part", "total", *[_coalitions(F.col("e"), c, k).alias(c) for c in ("n", "good", "toxic")])
    weighted = lambda row: F.aggregate(F.zip_with(row, F.col("n"), lambda c, v: c * v), zero, lambda a, x: a + x)
    table = table.withColumn("shapley", F.transform(_literal(shapley_map(k), "array<array<bigint>>"), weighted))
    out = table.select("*", F.explode(_literal(steps(names), STEPS)).alias("at"))
    before, after = F.col("at.before"), F.col("at.after")
    alone = F.call_function("shiftleft", F.lit(1), F.col("at.f"))
    removed = F.get("n", after) - F.get("n", before)
    return out.select(
        "part",
        F.col("at.filter_order").alias("filter_order"),
        F.col("at.step").alias("step"),
        (F.col("total") - F.get("n", after)).alias("kept"),
        removed.alias("removed"),
        (F.get("n", alone) - removed).alias("redundant"),
        (F.get("n", every) - F.get("n", every - alone)).alias("unique_fails"),
        (F.get("good", after) - F.get("good", before)).alias("good_lost"),
        (F.get("toxic", after) - F.get("toxic", before)).alias("toxic_lost"),
        F.get("shapley", F.col("at.f")).alias("shapley"),
    )


# ---------------------------------------------------------------- the five filters


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: fails A (short), B (few distinct words), C (capitals), D (a symbol)."""

    def of_words(w: Column) -> Column:
        short = F.when(F.size(w) < 50, 1).otherwise(0)
        poor = F.when(100 * F.size(F.array_distinct(w)).cast("bigint") < 65 * F.size(w).cast("bigint"), 2).otherwise(0)
        return short + poor

    # Bound once: both conditions read the same array of words.
    words = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), of_words)[0]
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("bigint")
    loud = F.when(100 * capitals > 5 * F.length(text).cast("bigint"), 4).otherwise(0)
    return words + loud + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def with_labels(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """``facts`` with good and toxic of their id; rows without an id stay out of the join."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    joined = facts.where(F.col("doc_id").isNotNull()).join(known, "doc_id", "left")
    no = F.lit(False)
    joined = joined.withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    return joined.unionByName(facts.where(F.col("doc_id").isNull()).withColumns({"good": no, "toxic": no}))


def mark_copies(facts: DataFrame, bit: int) -> DataFrame:
    """(doc_id, digest, part, mask, good, toxic) -> (part, mask, good, toxic, n), where ``bit`` is
    set in the mask of rows whose text a smaller id has too."""
    same = ["digest", "part", "mask", "good", "toxic"]
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("id")
    # Repeated rows of one id are one row; then the copies of a text in one part and label are.
    rows = facts.groupBy("doc_id", *same).agg(F.count(F.lit(1)).alias("n"))
    groups = rows.select(*same, key, "n").groupBy(*same).agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least")
    )
    first = groups.groupBy("digest").agg(F.min("least").alias("first"))
    met = groups.join(first, "digest")
    free = F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    failing = (F.col("mask") + bit).alias("mask")
    split = F.array(F.struct("mask", free.cast("bigint").alias("n")), F.struct(failing, (F.col("n") - free).alias("n")))
    return met.select("part", "good", "toxic", F.explode(split).alias("x")).select("part", "good", "toxic", "x.mask", "x.n").where("n > 0")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents and labels -> (part, mask, good, toxic, n) of the filters A to E."""
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.coalesce(F.col("source"), F.lit("")).alias("part"),
        text_mask(text).alias("mask"),
    )
    return mark_copies(with_labels(facts, labels), 16)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return audit(failures(docs, labels))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, coalesce(doc_id, 9223372036854775807) AS id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
x AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN id > min(id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l USING (doc_id)
),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM x GROUP BY part, mask),
o AS (
  SELECT '' AS filter_order, 0 AS step, 0 AS before, 0 AS f, 0 AS after
  UNION ALL
  SELECT filter_order || substr('ABCDE', i + 1, 1), step + 1, after, (1 << i)::INTEGER, (after + (1 << i))::INTEGER
  FROM o, (SELECT unnest(range(0, 5))::INTEGER AS i) WHERE step < 5 AND (after & (1 << i)) = 0
),
s AS (
  SELECT p.filter_order, o.step, o.before, o.f, o.after FROM o JOIN (SELECT filter_order FROM o WHERE step = 5) p
  ON starts_with(p.filter_order, o.filter_order) WHERE o.step > 0
),
r AS (
  SELECT part, filter_order, step, f,
    sum(n) FILTER ((mask & after) = 0) AS kept,
    sum(n) FILTER ((mask & f) > 0 AND (mask & before) = 0) AS removed,
    sum(n) FILTER ((mask & f) > 0 AND (mask & before) > 0) AS redundant,
    sum(n) FILTER (mask = f) AS unique_fails,
    sum(good) FILTER ((mask & f) > 0 AND (mask & before) = 0) AS good_lost,
    sum(toxic) FILTER ((mask & f) > 0 AND (mask & before) = 0) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM r
"""
