"""Operator 5: quality rules as a short-circuit cascade.

A rule says when a document is rejected, from features of its whole text.
``quality_cascade(docs, rules)`` first looks at a bounded sample: which rules
reject which sampled documents, and what each rule costs there.  It then orders
the rules greedily by rejection per cost - the next rule is the one that rejects
most of the documents still standing for the work it needs - and evaluates them
in that order in one CASE expression, so that a document already rejected is not
looked at by dearer rules.  The order changes the work and the name of the
rejecting rule, never the verdict.

Cost is counted, not timed, so that reruns agree: the characters (or words) that
a rule's features pass over, times a weight per kind of expression, averaged
over the sample.

Everything is built-in SQL functions on the row of the document: no Python, no
shuffle.  Repeated 3-word windows are found by sorting an array of longs (hash
bits above, position bits below), so a very long text costs n log n.

Edge cases: null text counts as no words (all features 0); empty texts likewise.  A
null doc_id is kept as it is.  Repeated rows are judged one by one.  An empty
table gives an empty result.  Extra columns are passed through by
``quality_cascade``; features live in columns of the operator's own prefix, so
clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"

# ---------------------------------------------------------------- features


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def words() -> Column:
    return F.regexp_extract_all(_text(), F.lit(WORD), F.lit(0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(word_hashes: Column) -> Column:
    """Words that lie in 3-word windows found twice or more, first ones included."""
    # Bound once: a lambda evaluates what it captures anew for every element.
    return _let(word_hashes, _repeats_of)


def _repeats_of(word_hashes: Column) -> Column:
    n = F.size(word_hashes)

    def of_windows(tri: Column) -> Column:
        # Low bits: enough for a position; high bits: the window's hash.  Equal windows
        # become neighbours when sorted; the whole hash is compared there.
        low = F.length(F.bin(F.size(tri).cast("bigint")))
        place = F.expr("1L")

        def with_mask(mask: Column) -> Column:
            keys = F.sort_array(F.transform(tri, lambda h, i: F.bitwise_not(mask).bitwiseAND(h).bitwiseOR(i.cast("bigint"))))

            def with_keys(s: Column) -> Column:
                def same(a: Column, b: Column) -> Column:
                    return (F.get(tri, a.bitwiseAND(mask).cast("int")) == F.get(tri, b.bitwiseAND(mask).cast("int"))) & (
                        F.bitwise_not(mask).bitwiseAND(a) == F.bitwise_not(mask).bitwiseAND(b)
                    )

                twice = F.filter(
                    s,
                    lambda x, i: F.when(i > 0, same(x, F.get(s, i - 1))).otherwise(F.lit(False))
                    | F.when(i < F.size(s) - 1, same(x, F.get(s, i + 1))).otherwise(F.lit(False)),
                )
                at = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(mask)))
                # Each window adds the words that the one before it has not covered.
                start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).cast("bigint").alias("last"))
                return F.aggregate(
                    at,
                    start,
                    lambda acc, x: F.struct(
                        (acc["n"] + F.least(F.lit(3).cast("bigint"), x - acc["last"])).alias("n"), x.alias("last")
                    ),
                    lambda acc: acc["n"],
                )

            return _let(keys, with_keys)

        return _let(F.call_function("shiftleft", place, low.cast("int")) - 1, with_mask)

    tri = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(word_hashes, i), F.get(word_hashes, i + 1), F.get(word_hashes, i + 2)),
        ),
    )
    return F.when(n >= 4, _let(tri, of_windows)).otherwise(F.lit(0).cast("bigint"))


def _lines() -> Column:
    return F.filter(F.split(_text(), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


# Feature -> (expression on the text, work per character of text).
FEATURES: dict[str, tuple[Callable[[], Column], float]] = {
    "n_words": (lambda: F.regexp_count(_text(), F.lit(WORD)).cast("bigint"), 1.0),
    "word_chars": (lambda: F.length(F.array_join(words(), "")).cast("bigint"), 2.0),
    "n_symbols": (lambda: F.regexp_count(_text(), F.lit(SYMBOL)).cast("bigint"), 0.7),
    "n_shouts": (lambda: F.regexp_count(_text(), F.lit("!")).cast("bigint"), 0.7),
    "n_lines": (lambda: F.size(_lines()).cast("bigint"), 1.2),
    "n_dup_lines": (lambda: (F.size(_lines()) - F.size(F.array_distinct(_lines()))).cast("bigint"), 1.5),
    "n_repeat_words": (lambda: _repeat_words(F.transform(words(), lambda w: F.xxhash64(w))), 12.0),
}


# ---------------------------------------------------------------- rules


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the feature columns by name and says when to reject."""

    name: str
    uses: tuple[str, ...]
    rejects: Callable[[dict[str, Column]], Column]


BASE_RULES = (
    Rule("short", ("n_words",), lambda f: f["n_words"] < 50),
    Rule("repeats", ("n_repeat_words", "n_words"), lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
)
RULES = BASE_RULES + (
    Rule("word_length", ("word_chars", "n_words"), lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 15 * f["n_words"])),
    Rule("symbols", ("n_symbols", "n_words"), lambda f: 100 * f["n_symbols"] > 20 * f["n_words"]),
    Rule("shouting", ("n_shouts", "n_words"), lambda f: 100 * f["n_shouts"] > 30 * f["n_words"]),
    Rule("dup_lines", ("n_dup_lines", "n_lines"), lambda f: 100 * f["n_dup_lines"] > 50 * f["n_lines"]),
)


def plan_order(docs: DataFrame, rules=RULES, sample_rows: int = 2000, have: tuple[str, ...] = ()) -> list[str]:
    """Rule names in cascade order, from at most ``sample_rows`` sampled documents.

    Features in ``have`` cost nothing: they are columns already.

    The sample is the rows with the smallest hash of their id: a bounded,
    repeatable choice that only this estimate sees.  The hashes alone are ranked;
    texts are filtered by the last hash taken and never sorted.
    """
    key = F.xxhash64("doc_id", F.lit(5))
    lowest = docs.select(key.alias("key")).orderBy("key").limit(sample_rows).collect()
    last = lowest[-1]["key"] if lowest else 0
    sample = docs.where(key <= last).select("text").limit(sample_rows)
    uses = {u for r in rules for u in r.uses}
    sample = sample.select(F.length(_text()).alias("__chars"), *[FEATURES[u][0]().alias(u) for u in sorted(uses)])
    f = {u: F.col(u) for u in uses}
    bits = sum((F.when(r.rejects(f), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(rules)), F.lit(0))
    seen = sample.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"), F.sum("__chars").alias("chars")).collect()
    chars = sum(r["chars"] or 0 for r in seen) / max(1, sum(r["n"] for r in seen))
    standing, order, left, known = [(r["bits"], r["n"]) for r in seen], [], list(range(len(rules))), set(have)
    while left:

        def gain(i: int) -> tuple[float, int]:
            cost = 1.0 + sum(FEATURES[u][1] for u in rules[i].uses if u not in known) * chars
            return (sum(n for b, n in standing if b >> i & 1) / cost, -i)

        best = max(left, key=gain)
        left.remove(best)
        order.append(rules[best].name)
        known |= set(rules[best].uses)
        standing = [(b, n) for b, n in standing if not b >> best & 1]
    return order


def verdict(order: list[str], rules, feature: dict[str, Column]) -> Column:
    """Name of the first rule in ``order`` that rejects, null if none does."""
    by_name = {r.name: r for r in rules}
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(by_name[name].rejects(feature), F.lit(name)).otherwise(out)
    return out


def quality_cascade(
    docs: DataFrame,
    rules=RULES,
    sample_rows: int = 2000,
    out: str = "rejected_by",
    have: dict[str, str] | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """``docs`` with the name of the rejecting rule in ``out`` (null: kept).

    ``have`` names columns of ``docs`` that hold features already (feature -> column);
    all others are computed inside the CASE, for documents that got there.  ``order``:
    an order planned before.
    """
    have = have or {}
    order = plan_order(docs, rules, sample_rows, tuple(have)) if order is None else order
    lazy = {name: F.col(have[name]) if name in have else expression() for name, (expression, _) in FEATURES.items()}
    return docs.withColumn(out, verdict(order, rules, lazy))


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's columns are due for every document; what only rules use (``n_shouts``,
    ``n_lines``) is left to the cascade."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    due = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    features = docs.select(
        "doc_id",
        "text",
        words().alias("w"),
    ).select(
        "doc_id",
        "text",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        *[FEATURES[f][0]().alias(f) for f in ("n_symbols", "n_dup_lines")],
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
    )
    features = features.select("*", _repeat_words(F.col("h")).alias("n_repeat_words")).drop("h")
    judged = quality_cascade(features, have={f: f for f in due}, order=plan_order(docs, have=due))
    f = {name: F.col(name) for name in due}
    base = BASE_RULES[0].rejects(f) | BASE_RULES[1].rejects(f)
    return judged.select("doc_id", *due, base.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS tri FROM d),
t AS (SELECT row_number() OVER () AS rid, * FROM l),
x AS (SELECT rid, unnest(tri) AS tri, unnest(range(1, len(tri) + 1)) AS pos FROM t),
r AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, tri) AS n FROM x) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS p FROM r) GROUP BY rid),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '!'))::BIGINT AS n_shouts,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN c USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
       OR 100 * n_symbols > 20 * n_words OR 100 * n_shouts > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM f
"""
