"""Operator 13: secrets in texts, by patterns and by sliding-window entropy.

``scan(docs)`` adds to every document the spans of its secrets: an array of
(kind, start, end), in code points, end exclusive, by start and then kind.

* Base kinds are patterns: ``assign`` (a keyword, a separator, a value of 8 or more
  characters), ``access`` (key ids) and ``hex`` (32 or more digits).
* The method adds high-entropy stretches of strings that no pattern names.  Candidates
  are maximal runs of one character class (hexadecimal, base64) that are at least one
  window long.  A window of ``width`` characters slides along the run; its counts per
  character are kept incrementally (one enters, one leaves), and with them
  s = sum of c log2 c.  The Shannon entropy is log2(width) - s / width, so a window is
  hot when s is at most width (log2(width) - bits), bits being the bound of the
  class.  c log2 c is a table of integers in units of 2^-20, so sums are exact and
  reruns agree.  Hot windows that overlap or touch are one span, ``entropy_hex`` or
  ``entropy_base64``.
* Candidates that an allow-list pattern matches are suppressed: numbers, words, names in
  words, UUIDs, placeholders, alphabets.  Base spans always stay.

Everything is built-in SQL functions on the row of the document: no Python, no shuffle.
A pattern without a match costs one pass of its regular expression.  Counts of a window
are five bits each, twelve to a long, so a step changes two longs; one pass over a run is
linear.  Positions are running sums over the pieces between matches, in blocks, so
that a very long text with very many matches costs n * sqrt(n) copies of a reference, not n * n.

Edge cases: a null text has no spans; so has an empty one.  A null doc_id is kept as it
is.  Repeated rows are scanned one by one.  An empty table gives an empty result.  ``scan``
passes extra columns through, those with the names it uses inside included; only a column
named like its result (``spans``) is replaced.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values: patterns


def _either(word: str) -> str:
    """Letters in either case, ASCII only."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = (
    "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
    + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# Runs are maximal, so a bound inside the pattern drops the same matches as one applied afterwards.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

# Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

# Character classes of candidates: characters, symbols that are told apart, bits a window must reach.
CLASSES = {
    "entropy_hex": ("0-9a-fA-F", "0123456789abcdef", 3.0),
    "entropy_base64": ("A-Za-z0-9+/_-", string.ascii_letters + string.digits + "+/", 3.7),
}

ALLOWED = (
    r"^[0-9]+$",  # numbers
    r"^[^0-9]+$",  # letters only: words
    r"^([A-Za-z]+|[0-9]{1,4})([-_/+]+([A-Za-z]+|[0-9]{1,4}))*[-_/+]*$",  # names and paths made of words and short numbers
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",  # UUIDs
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Cc][Hh][Aa][Nn][Gg][Ee][Mm][Ee]",  # placeholders
    r"[Aa][Bb][Cc][Dd][Ee][Ff][Gg][Hh]|0123456789|1234567890",  # alphabets
)

UNIT = 1 << 20


def count_terms(width: int) -> list[int]:
    """c log2 c for c = 0 .. width, in units of 2^-20."""
    return [round(c * math.log2(c) * UNIT) if c else 0 for c in range(width + 1)]


def hot_bound(width: int, bits: float) -> int:
    """Largest s of a window with ``bits`` or more of entropy."""
    return math.floor(width * (math.log2(width) - bits) * UNIT)


# ---------------------------------------------------------------- positions of matches


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once (a lambda evaluates what it captures anew)."""
    return F.transform(F.array(value), body)[0]


def _appended(values: Column, start: Column) -> Column:
    """start, start + v0, start + v0 + v1, ... (one more than there are values)."""
    zero = F.struct(F.array(start).cast("array<bigint>").alias("out"), start.cast("bigint").alias("sum"))
    step = lambda a, v: F.struct(F.array_append(a["out"], a["sum"] + v).alias("out"), (a["sum"] + v).alias("sum"))
    return F.aggregate(values, zero, step, lambda a: a["out"])


def running_sums(values: Column, block: int = 512) -> Column:
    """Sum of the values before each place, in blocks of ``block``; an array of longs (bigint)."""

    def of_blocks(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda a, v: a + v))
        return _let(
            _appended(sums, F.lit(0)),
            lambda base: F.flatten(F.transform(parts, lambda p, i: F.slice(_appended(p, F.get(base, i)), F.lit(1), F.size(p)))),
        )

    def cut(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(v) - 1, F.lit(block))
        return _let(F.transform(starts, lambda s: F.slice(v, s + 1, F.lit(block))), of_blocks)

    return F.when(F.size(values) > 0, _let(values, cut)).otherwise(F.array().cast("array<bigint>"))


SPAN = "struct<start:bigint,kind:int,end:bigint>"
RUN = "struct<start:bigint,text:string>"


def _none(element: str) -> Column:
    return F.array().cast(f"array<{element}>")


def _places(text: Column, pattern: str, body: Callable[[Column, Column], Column]) -> Column:
    """``body(matches, starts)`` for the leftmost non-overlapping matches of ``pattern``."""
    rx = F.lit(pattern)
    matches = F.regexp_extract_all(text, rx, F.lit(0))

    def with_matches(found: Column) -> Column:
        # Between the matches lie the pieces: match i starts after pieces 0 .. i and matches 0 .. i - 1.
        pieces = F.split(text, pattern, -1)
        sizes = F.zip_with(pieces, found, lambda p, m: (F.length(p) + F.coalesce(F.length(m), F.lit(0))).cast("bigint"))
        return _let(
            sizes,
            lambda n: _let(
                running_sums(n),
                lambda before: body(found, F.transform(found, lambda m, i: F.get(before, i) + F.get(n, i) - F.length(m))),
            ),
        )

    return _let(matches, with_matches)


def _spans(text: Column, kind: str, pattern: str, value: int | None = None, least: int = 0) -> Column:
    """Spans of a pattern; with ``value``, only of matches whose group has ``least`` characters."""
    number = F.lit(KINDS.index(kind))

    def body(found: Column, starts: Column) -> Column:
        return F.transform(found, lambda m, i: F.struct(F.get(starts, i), number, F.get(starts, i) + F.length(m))).cast(f"array<{SPAN}>")

    out = _places(text, pattern, body)
    if value is not None:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
        out = _let(values, lambda v: F.filter(out, lambda s, i: F.length(F.get(v, i)) >= least))
    return F.when(text.rlike(pattern), out).otherwise(_none(SPAN))


# ---------------------------------------------------------------- entropy


_PER_LONG, _BITS = 12, 5  # counts up to 31, twelve to a long


def _symbols(alphabet: str) -> Column:
    """Number of each character code: 0 .. 127 -> the place in the alphabet (either case of hexadecimal digits; - and _ as + and /)."""
    table = []
    for code in range(128):
        c = chr(code)
        c = c.lower() if len(alphabet) == 16 else {"-": "+", "_": "/"}.get(c, c)
        table.append(max(alphabet.find(c), 0))
    return F.array(*[F.lit(x) for x in table])


def _hot(run: Column, kind: str, width: int) -> Column:
    """Spans of the hot windows of one run (start, text)."""
    _, alphabet, bits = CLASSES[kind]
    bound = F.lit(hot_bound(width, bits)).cast("bigint")
    number = F.lit(KINDS.index(kind))
    terms = F.array(*[F.lit(x).cast("bigint") for x in count_terms(width)])
    slots = -(-len(alphabet) // _PER_LONG)
    big = lambda x: F.lit(x).cast("bigint")
    none = F.lit(-1)

    def count_of(words: Column, symbol: Column) -> Column:
        word = F.get(words, (symbol / _PER_LONG).cast("int"))
        return F.call_function("shiftright", word, (symbol % _PER_LONG) * _BITS).bitwiseAND(big(31)).cast("int")

    def moved(words: Column, symbol: Column, sign: int) -> Column:
        one = F.call_function("shiftleft", big(1), (symbol % _PER_LONG) * _BITS)
        return F.transform(words, lambda w, j: F.when(j == (symbol / _PER_LONG).cast("int"), w + sign * one).otherwise(w))

    def step(codes: Column, at: Column) -> Callable[[Column, Column], Column]:
        def one(state: Column, i: Column) -> Column:
            enter, leave = F.get(codes, i), F.get(codes, i - width)
            # The character that leaves goes first, so no count passes the width.
            gone = F.when(leave.isNull(), state["words"]).otherwise(moved(state["words"], leave, -1))

            def with_gone(words: Column) -> Column:
                had, has = count_of(state["words"], leave), count_of(words, enter)
                lost = F.when(leave.isNull(), big(0)).otherwise(F.get(terms, had) - F.get(terms, had - 1))
                total = state["s"] - lost + F.get(terms, has + 1) - F.get(terms, has)
                return F.struct(moved(words, enter, 1).alias("words"), total.alias("s"))

            def with_window(now: Column) -> Column:
                first, end = i - (width - 1), i + 1
                hot = (first >= 0) & (now["s"] <= bound)
                joins = hot & (state["open"] >= 0) & (first <= state["close"])
                closes = hot & ~joins & (state["open"] >= 0)
                span = F.struct(at + state["open"], number, at + state["close"]).cast(SPAN)
                return F.struct(
                    now["words"].alias("words"),
                    now["s"].alias("s"),
                    F.when(hot & ~joins, first).otherwise(state["open"]).alias("open"),
                    F.when(hot, end).otherwise(state["close"]).alias("close"),
                    F.when(closes, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
                )

            return _let(_let(gone, with_gone), with_window)

        return one

    def of_codes(codes: Column) -> Column:
        start = F.struct(
            F.array(*[big(0)] * slots).alias("words"), big(0).alias("s"), none.alias("open"), none.alias("close"), _none(SPAN).alias("spans")
        )
        at = run["start"]
        done = lambda s: F.when(
            s["open"] >= 0, F.array_append(s["spans"], F.struct(at + s["open"], number, at + s["close"]).cast(SPAN))
        ).otherwise(s["spans"])
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step(codes, at), done)

    return _let(F.transform(F.split(run["text"], ""), lambda c: F.get(_symbols(alphabet), F.ascii(c))), of_codes)


def allowed(candidate: Column, patterns=ALLOWED) -> Column:
    """Is the candidate one that is known to be no secret?"""
    out = F.lit(False)
    for p in patterns:
        out = out | candidate.rlike(p)
    return out


def _entropy_spans(text: Column, kind: str, width: int, patterns) -> Column:
    pattern = f"[{CLASSES[kind][0]}]{{{width},}}"

    def body(found: Column, starts: Column) -> Column:
        runs = F.transform(found, lambda m, i: F.struct(F.get(starts, i), m)).cast(f"array<{RUN}>")
        suspects = F.filter(runs, lambda r: ~allowed(r["text"], patterns))
        return F.flatten(F.transform(suspects, lambda r: _hot(r, kind, width)))

    return F.when(text.rlike(pattern), _places(text, pattern, body)).otherwise(_none(SPAN))


# ---------------------------------------------------------------- the operator


def scan(docs: DataFrame, width: int = 20, patterns=ALLOWED) -> DataFrame:
    """``docs`` with ``spans``: array<struct<start, kind, end>>, kind as its number in KINDS, sorted."""
    if not 2 <= width <= 31:
        raise ValueError("a window holds 2 to 31 characters: counts have five bits")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = [
        _spans(text, "assign", ASSIGN, 2, 8),
        _spans(text, "access", ACCESS),
        _spans(text, "hex", HEX),
        *[_entropy_spans(text, kind, width, patterns) for kind in CLASSES],
    ]
    return docs.withColumn("spans", F.sort_array(F.concat(*found)))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def found(spans: Column, kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    # The array is bound once: every column below reads it.
    digest = scan(docs).select(
        "doc_id",
        _let(
            F.col("spans"),
            lambda spans: F.struct(
                *[found(spans, kind) for kind in range(3)],
                F.sha2(span_text(F.filter(spans, lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
                span_text(spans).alias("spans"),
            ),
        ).alias("x"),
    )
    return digest.select("doc_id", "x.*")


def _oracle(width: int = 20) -> str:
    def places(kind: int, pattern: str, group: int = 0) -> str:
        p = pattern.replace("'", "''")
        return f"""
  SELECT rid, {kind} AS kind, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(regexp_extract_all(text, '{p}', {group})) AS v,
    unnest(regexp_split_to_array(text, '{p}')[1:len(regexp_extract_all(text, '{p}'))]) AS piece,
    unnest(range(len(regexp_extract_all(text, '{p}')))) AS i FROM d WHERE regexp_matches(text, '{p}')"""

    def entropy(name: str) -> str:
        chars, alphabet, bits = CLASSES[name]
        fold = "lower(c)" if len(alphabet) == 16 else "translate(c, '-_', '+/')"
        kind = KINDS.index(name)
        return f"""
  SELECT rid, start, {kind} AS kind, wat, sum([{", ".join(map(str, count_terms(width)))}][n + 1]) <= {hot_bound(width, bits)} AS hot FROM (
    SELECT rid, start, wat, {fold} AS c, count(*) AS n FROM (
      SELECT rid, start, wat, unnest(string_split(substr(m, wat + 1, {width}), '')) AS c FROM (
        SELECT rid, start, m, unnest(range(length(m) - {width - 1})) AS wat FROM p WHERE kind = {kind} AND NOT allowed))
    GROUP BY ALL) GROUP BY ALL"""

    runs = [places(KINDS.index(k), f"[{c}]{{{width},}}") for k, (c, _, _) in CLASSES.items()]
    base = [places(0, ASSIGN, 2), places(1, ACCESS), places(2, HEX)]
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    allow = " OR ".join("regexp_matches(m, '{}')".format(p) for p in ALLOWED)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
q AS ({" UNION ALL ".join(base + runs)}),
p AS (SELECT *, ({allow}) AS allowed,
    sum(length(piece) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) - length(m) AS start FROM q),
h AS ({" UNION ALL ".join(entropy(k) for k in CLASSES)}),
g AS (SELECT *, CASE WHEN wat <= lag(wat) OVER (PARTITION BY rid, start, kind ORDER BY wat) + {width} THEN 0 ELSE 1 END AS new FROM h WHERE hot),
j AS (SELECT *, sum(new) OVER (PARTITION BY rid, start, kind ORDER BY wat) AS part FROM g),
s AS (
  SELECT rid, kind, start::BIGINT AS a, (start + length(m))::BIGINT AS b FROM p WHERE kind IN (1, 2) OR kind = 0 AND length(v) >= 8
  UNION ALL
  SELECT rid, kind, (start + min(wat))::BIGINT, (start + max(wat) + {width})::BIGINT FROM j GROUP BY rid, kind, start, part
),
t AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
    string_agg({names}[kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (kind < 3) AS base,
    string_agg({names}[kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind) AS spans
  FROM s GROUP BY rid
)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN t USING (rid)
"""


ORACLE = _oracle()
