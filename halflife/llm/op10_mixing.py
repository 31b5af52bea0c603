"""Operator 10: mix sources to target weights by Sainte-Lague apportionment.

``mix_sources(docs)`` decides how many words a training mix takes from every
document.  Method:

1. *Targets.*  Sources, ordered by code point with null last, weigh
   ``WEIGHTS`` in turn and share ``budget`` times all words; a source's target
   stops at ``max_repeat`` times its own words and the excess is shared again by
   weight until no target is above (water level, found with one pass over the
   sources sorted by size per weight).
2. *Source quotas.*  The mix has ``round(sum(targets) / block)`` blocks of
   ``block`` words.  They go to the sources by highest quotients
   ``target / (2 * seats + 1)`` (Sainte-Lague).
3. *Shard quotas.*  The documents of a source are dealt by hash into shards of
   about ``shard_docs`` documents, and the source's blocks go to its shards by
   the same rule, weighted by shard words.
4. *Seeded selection.*  Inside a shard the documents lie end to end in seeded
   order, cut into blocks.  A quota of q over b blocks takes the whole shard
   ``q div b`` times and ``q mod b`` more blocks, starting at a seeded block.

The last step is arithmetic on running word totals, so blocks are never
materialised and the block size has no cost.  Highest quotients need no loop
either: the seats of every party are known up to a range whose widths sum to
about twice the number of parties (divisor bounds), so only that many quotients
are ranked.

Scale: one shuffle of (key, size, source) rows to the shards - texts are read
for their word count only and never move.  A hot source is spread over its
shards; its rows never meet in one task.  Tables of sources and shards are
aggregates; the rank over shards is per source and the one over sources runs on
one row per source.

Edge cases: null or empty text has size 0 and takes 0.  A null source is a
source of its own, last in order.  A null doc_id takes part like any other id.
Repeated rows are mixed as the separate documents they are (ties in the
seeded order are broken by size and otherwise interchangeable).  An empty table
gives an empty result.  Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halflife.session import stage

# Fixed values of the contract.
WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MAX_REPEAT = 2.0
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _seed(*parts) -> Column:
    """A 60-bit number from the text of the parts (md5, equal in any SQL engine)."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, max_repeat=MAX_REPEAT) -> DataFrame:
    """(source, source_size, ...) -> + source_no, target.  One row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("source_no", (F.row_number().over(by_name) - 1).cast("int")).withColumn("w", w)
    s = s.withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size"))
    # Sources fill up in order of cap per weight.  Before a source fills, the level
    # is (budget - caps filled so far) / (weight not filled so far).
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source_no").asc())
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns(
        {
            "total": F.lit(float(budget)) * F.sum("source_size").over(everything),
            "used": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "free": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        }
    )
    level = F.when((F.col("total") - F.col("used")) / F.col("free") < F.col("cap") / F.col("w"), (F.col("total") - F.col("used")) / F.col("free"))
    # The first source that does not fill sets the level; later rows take off caps that do not fill.
    s = s.withColumn("level", F.max(level).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))
    return s.select(*sizes.columns, "source_no", target.alias("target"))


def sainte_lague(parties: DataFrame, votes: str, seats: str, group: list[str], order: list[str], out: str) -> DataFrame:
    """Seats of each party by highest quotients votes / (2 s + 1).

    ``seats`` is a column constant within ``group``; ``order`` breaks ties.  If
    every party's votes are zero, nobody gets a seat.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy()
    p = parties.withColumns({"__n": F.count(F.lit(1)).over(g), "__v": F.sum(votes).over(g)})
    share = F.when(F.col("__v") > 0, F.col(votes) / F.col("__v")).otherwise(F.lit(0.0))
    low = F.greatest(F.floor(share * (F.col(seats) - F.col("__n") / 2.0) - 0.5) - 1, F.lit(0)).cast("bigint")
    high = F.least(F.ceil(share * (F.col(seats) + F.col("__n") / 2.0) + 0.5) + 1, F.col(seats)).cast("bigint")
    p = p.withColumns({"__low": low, "__high": F.when(F.col(votes) > 0, high).otherwise(F.lit(0).cast("bigint"))})
    p = p.withColumn("__sure", F.least(F.col("__low"), F.col("__high")))
    p = p.withColumn("__open", F.col(seats) - F.sum("__sure").over(g))
    rows = p.select("*", F.explode_outer(F.when(F.col("__high") > F.col("__sure"), F.sequence("__sure", F.col("__high") - 1))).alias("__s"))
    quotient = F.col(votes) / (2 * F.col("__s") + 1)
    ranked = rows.withColumn(
        "__rank",
        F.row_number().over(
            (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy(
                F.col("__s").isNull(), quotient.desc(), *[F.col(c).asc_nulls_last() for c in order], F.col("__s").asc()
            )
        ),
    )
    won = F.count(F.when(F.col("__s").isNotNull() & (F.col("__rank") <= F.col("__open")), 1))
    keep = [c for c in parties.columns]
    return ranked.groupBy(*keep, "__sure").agg(won.alias("__won")).select(*keep, (F.col("__sure") + F.col("__won")).alias(out))


def mix_sources(
    docs: DataFrame,
    weights=WEIGHTS,
    budget: float = BUDGET,
    max_repeat: float = MAX_REPEAT,
    block: int = 16,
    shard_docs: int = 2000,
    seed: int = 10,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, source, source_size, target, taken (and ``carry``) for every row of ``docs``.

    ``docs`` needs doc_id, text and source.  ``taken`` counts the words the mix
    takes from the row, repeats included, and is at most ``max_repeat * size``.
    """
    # Written once: three narrow columns, so that the texts are read a single time.
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carry), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    targets = source_targets(per_source, weights, budget, max_repeat)
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("bigint")
    quotas = sainte_lague(targets.withColumn("seats", seats), "target", "seats", [], ["source_no"], "source_blocks")
    # One row per source, a bound the source table itself sets; joined, not hinted.
    quotas = quotas.select(
        F.col("source").alias("__source"),
        "source_no",
        "source_size",
        "target",
        "source_blocks",
        F.ceil(F.col("n_docs") / shard_docs).cast("bigint").alias("n_shards"),
    )
    dealt = sized.join(quotas, F.col("source").eqNullSafe(F.col("__source")), "inner").drop("__source")
    dealt = dealt.withColumn("order_key", _seed(F.lit(seed), F.col("doc_id")))
    dealt = dealt.withColumn("shard", F.pmod(F.col("order_key"), F.col("n_shards")))

    shards = dealt.groupBy("source_no", "shard").agg(
        F.sum("size").cast("double").alias("shard_size"), F.first("source_blocks").alias("source_blocks")
    )
    shards = sainte_lague(shards, "shard_size", "source_blocks", ["source_no"], ["shard"], "quota").select(
        "source_no", "shard", "quota", "shard_size"
    )
    lain = Window.partitionBy("source_no", "shard").orderBy("order_key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("end", F.sum("size").over(lain))
    placed = placed.join(shards, ["source_no", "shard"], "inner")

    n_blocks = F.ceil(F.col("shard_size") / block).cast("bigint")
    limit = F.floor(F.lit(float(max_repeat))).cast("bigint")
    quota = F.least(F.col("quota"), n_blocks * limit)
    placed = placed.withColumns({"n_blocks": n_blocks, "quota": quota, "start": F.col("end") - F.col("size")})
    placed = placed.withColumns(
        {
            "full": F.when(F.col("n_blocks") > 0, F.floor(F.col("quota") / F.col("n_blocks"))).otherwise(F.lit(0)).cast("bigint"),
            "rest": F.when(F.col("n_blocks") > 0, F.col("quota") % F.col("n_blocks")).otherwise(F.lit(0)).cast("bigint"),
            "first": F.when(F.col("n_blocks") > 0, F.pmod(_seed(F.lit(seed), F.col("source_no"), F.col("shard")), F.col("n_blocks"))).otherwise(F.lit(0)),
        }
    )

    def overlap(a: Column, b: Column) -> Column:
        """Words of [start, end) in the blocks [a, b)."""
        return F.greatest(F.least(F.col("end"), b * block) - F.greatest(F.col("start"), a * block), F.lit(0))

    stop = F.col("first") + F.col("rest")
    extra = overlap(F.col("first"), F.least(stop, F.col("n_blocks"))) + F.when(
        stop > F.col("n_blocks"), overlap(F.lit(0).cast("bigint"), stop - F.col("n_blocks"))
    ).otherwise(F.lit(0))
    taken = F.col("full") * F.col("size") + F.when(F.col("rest") > 0, extra).otherwise(F.lit(0))
    return placed.select("doc_id", "size", "source", "source_size", "target", taken.cast("bigint").alias("taken"), *carry)


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each row as often as the mix takes it, rounded to whole texts (0, 1, 2, ...).

    Only the document at either end of a shard's selection is taken in part, so
    rounding moves each shard by less than two documents.
    """
    named = docs.withColumn("__th", F.xxhash64("text"))
    mix = mix_sources(named, carry=("__th",), **options).where("taken > 0")
    times = mix.groupBy("doc_id", "__th").agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("__n")).where("__n > 0")
    times = times.select(F.col("doc_id").alias("__id"), F.col("__th").alias("__key"), "__n")
    out = named.join(times, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__key")))
    return out.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source),
s1 AS (
  SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1)::INTEGER AS source_no FROM s0
),
s2 AS (SELECT *, [3.0, 1.0, 2.0][source_no % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s1),
s3 AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s2) AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS used,
    (SELECT sum(w) FROM s2) - coalesce(sum(w) OVER (ORDER BY cap / w, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS free
  FROM s2
),
lv AS (SELECT max((total - used) / free) AS level FROM s3 WHERE (total - used) / free < cap / w),
s AS (SELECT s3.source, source_no, source_size, n_docs, least(cap, coalesce(level * w, cap)) AS target FROM s3, lv),
m AS (SELECT round(sum(target) / 16)::BIGINT AS seats FROM s),
q AS (
  SELECT source_no, target / (2 * k + 1) AS quotient, k FROM s, m, range(0, m.seats) r(k)
  WHERE target > 0 AND k <= target / (SELECT sum(target) FROM s) * (m.seats + 40) + 4
),
qr AS (SELECT source_no, row_number() OVER (ORDER BY quotient DESC, source_no, k) AS rk FROM q),
sb AS (SELECT source_no, count(*) AS source_blocks FROM qr, m WHERE rk <= m.seats GROUP BY 1),
e AS (
  SELECT d.*, s.source_no, s.source_size, s.target, coalesce(sb.source_blocks, 0) AS source_blocks,
    ('0x' || substr(md5('10|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS order_key,
    ceil(n_docs / 2000.0)::BIGINT AS n_shards
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN sb USING (source_no)
),
f AS (
  SELECT *, order_key % n_shards AS shard FROM e
),
sh AS (SELECT source_no, shard, sum(size)::DOUBLE AS shard_size, any_value(source_blocks) AS source_blocks FROM f GROUP BY 1, 2),
hq AS (
  SELECT source_no, shard, shard_size, k, source_blocks, shard_size / (2 * k + 1) AS quotient FROM sh, range(0, (SELECT max(source_blocks) FROM sb)) r(k)
  WHERE shard_size > 0 AND k < source_blocks
),
hr AS (SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY quotient DESC, shard, k) AS rk FROM hq),
hs AS (SELECT source_no, shard, count(*) AS quota FROM hr WHERE rk <= source_blocks GROUP BY 1, 2),
p AS (
  SELECT f.*, ceil(sh.shard_size / 16)::BIGINT AS n_blocks, coalesce(hs.quota, 0) AS quota0,
    (sum(size) OVER (PARTITION BY f.source_no, f.shard ORDER BY order_key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS stop_at
  FROM f JOIN sh ON f.source_no = sh.source_no AND f.shard = sh.shard LEFT JOIN hs ON f.source_no = hs.source_no AND f.shard = hs.shard
),
z AS (
  SELECT *, stop_at - size AS start_at, least(quota0, 2 * n_blocks) AS quota,
    CASE WHEN n_blocks > 0 THEN ('0x' || substr(md5('10|' || source_no || '|' || shard), 1, 15))::BIGINT % n_blocks ELSE 0 END AS fb
  FROM p
),
y AS (
  SELECT *, CASE WHEN n_blocks > 0 THEN quota // n_blocks ELSE 0 END AS full_, CASE WHEN n_blocks > 0 THEN quota % n_blocks ELSE 0 END AS rest
  FROM z
)
SELECT doc_id, size, source_size, target,
  (full_ * size + CASE WHEN rest > 0 THEN
     greatest(least(stop_at, least(fb + rest, n_blocks) * 16) - greatest(start_at, fb * 16), 0)
     + CASE WHEN fb + rest > n_blocks THEN greatest(least(stop_at, (fb + rest - n_blocks) * 16) - greatest(start_at, 0), 0) ELSE 0 END
   ELSE 0 END)::BIGINT AS taken
FROM y
"""
