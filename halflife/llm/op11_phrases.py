"""Operator 11: phrase collocations by SON partitioning.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into
words; phrases are 1 to ``longest`` words in a row within a piece, counted per language.
``frequent_phrases`` finds every phrase with ``support`` or more occurrences and its exact
count; ``collocations`` scores, thins and ranks them.

Method: SON partitioning (two passes).

1. Documents are dealt by hash into ``shards``.  A phrase with ``support`` occurrences has
   support / shards or more of them in some shard, so each shard is mined completely at
   the local support ceil(support / shards), and the union of the shards' phrases
   misses none.  A chunk of a shard counts its own phrases first (as exact tuples of
   word numbers) and sends a 32-bit code and a count of each, sorted and delta-coded, to
   a bucket of phrase codes.  There the shards are mined side by side.  Counts are cut off
   at the local support, which is all that is asked.  Two phrases with one code can only
   add candidates, never lose one.
2. The bucket answers every chunk of every shard with one bit per code it sent: candidate
   or not.  The chunk then sends its exact counts of the candidates, with their words, to
   buckets that add them up by language and bytes.

The score of a phrase needs the counts of its parts; those occur at least as often, so
they are in the same table, and two joins on (lang, phrase) find them.  A phrase is
dropped when a longer one around it is nearly as frequent; the phrase one word
longer is then as well, so only those are looked at.  The first ``top`` of a
language are taken in two steps, first per slice of the language's phrases.

Scale: one shuffle of the texts (packed), one of the codes (about 3 bytes for each
distinct phrase of a chunk), one of the candidates' words.  A phrase, however frequent,
is one entry per chunk; buckets are dealt by phrase, so neither a hot phrase nor a hot
language meets in one task.  The number of shards is fixed, so that the local support stays
above 1 and a shard grows with the input, spread over chunks and buckets.  A document is
worked on in one piece.

Edge cases: null text is empty and has no phrases; null lang counts as ``und``, as does a
lang of that name.  A language without words has no row, nor has one without candidates.
Repeated rows count each, whatever their id; a null id is no special case.  Words may hold
any other character; a very long one is a word.  An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from halflife.llm import exchange as X
from halflife.llm import text as T
from halflife.llm.parcels import opened, parcelled
from halflife.session import stage

SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9]] = True
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[10, 11, 12, 13, *b".,;:!?"]] = True

PHRASES = "lang string, phrase string, k int, n long"
PHRASES_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("n", pa.int64())])
_HEAD = 10  # digits in front of every text: the length of its language's name, which follows


# ---------------------------------------------------------------- the phrases of a chunk


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each value, place where each number occurs first, occurrences of each number)."""
    _, first, number, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return number, first, count


class _Phrases:
    """Distinct phrases of a chunk: ``at`` (first word of one occurrence), ``k``, ``count`` and ``code``."""

    def __init__(self, table: pa.Table, longest: int):
        raw, offsets = T.flat(table.column("text"))
        data = T.LOWER[raw]
        names, lang = [], []
        known: dict[str, int] = {}
        brk = BREAKS[data]
        for a in offsets[:-1].tolist():
            size = int(raw[a : a + _HEAD].tobytes())
            name = raw[a + _HEAD : a + _HEAD + size].tobytes().decode()
            if name not in known:
                known[name] = len(names)
                names.append(name)
            lang.append(known[name])
            brk[a : a + _HEAD + size] = True  # the language is no text
        self.langs, self.data = names, data
        solid = ~(SPACES[data] | brk)
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:-1]
        end[:-1] &= ~solid[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        n = len(self.starts)
        doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.lang = np.array(lang, dtype=np.int64)[doc] if n else np.zeros(0, dtype=np.int64)
        self.words = np.bincount(self.lang, minlength=len(names))
        if not n:
            self.at = self.k = self.count = np.zeros(0, dtype=np.int64)
            self.code = np.zeros(0, dtype=np.uint64)
            return
        # Every document begins with its head, which is a break, so pieces never join.
        piece = np.cumsum(brk)[self.starts]
        hashes = T.word_hashes(data, self.starts, self.ends)
        words = T.exact_ids(data, self.starts, self.ends, hashes)
        tongue = np.array([_name_hash(x) for x in names], dtype=np.uint64)
        codes = T.mix(hashes + tongue[self.lang], 51)
        one, first, count = _ranked(words * len(names) + self.lang)
        n_one = len(first)
        at, k, counts, code = [first], [np.ones(n_one, dtype=np.int64)], [count], [T.windows(codes, 1, 52)[first]]
        gram, places = one, np.arange(n)
        for size in range(2, longest + 1):
            # Phrases of one word more: those whose next word is in the same piece.
            room = places + size - 1 < n
            places, gram = places[room], gram[room]
            inside = piece[places + size - 1] == piece[places]
            places, gram = places[inside], gram[inside]
            if not len(places):
                break
            gram, first, count = _ranked(gram * n_one + one[places + size - 1])
            at.append(places[first])
            k.append(np.full(len(first), size, dtype=np.int64))
            counts.append(count)
            code.append(T.windows(codes, size, 51 + size)[places[first]])
        self.at, self.k, self.count, self.code = map(np.concatenate, (at, k, counts, code))

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """(all words of the chunk, each with one space after it; where each word begins)."""
        size = self.ends - self.starts + 1
        place = np.concatenate([[0], np.cumsum(size)])
        if not len(size):
            return np.zeros(0, dtype=np.uint8), place
        plain = self.data[np.minimum(np.repeat(self.starts - place[:-1], size) + np.arange(place[-1]), len(self.data) - 1)]
        plain[place[1:] - 1] = 32
        return plain, place


def _slices(plain: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.cumsum(length) - length
    return plain[np.repeat(begin - out, length) + np.arange(int(length.sum()))]


def _name_hash(name: str) -> int:
    raw = np.frombuffer(name.encode(), dtype=np.uint8)
    if not len(raw):
        return 0
    return int(T.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def _sorted_codes(p: _Phrases, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the phrases by bucket and short code, bucket, short code), the latter two in that order."""
    bucket = (p.code >> np.uint64(32)) % np.uint64(n_buckets)
    key = bucket << np.uint64(32) | p.code & np.uint64(0xFFFFFFFF)
    order = np.argsort(key, kind="stable")
    key = key[order]
    return order, (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)


# ---------------------------------------------------------------- pass 1: shards


def _send(longest: int, local: int, n_buckets: int):
    def run(key, table):
        p = _Phrases(opened(table), longest)
        order, bucket, short = _sorted_codes(p, n_buckets)
        count = np.minimum(p.count[order], local).astype(np.uint8)
        rows = []
        for to, part in X.split_by(bucket):
            a, b = int(part[0]), int(part[-1]) + 1
            gaps = np.diff(short[a:b], prepend=np.uint32(0)).astype("<u4")
            planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T)  # equal bytes together: mostly zeros
            rows.append((to, X.pack(np.int64(key[0].as_py()), planes, count[a:b])))
        return X.mail(rows)

    return run


def _mine(shards: int, local: int):
    def run(key, table):
        chunks, codes, counts = [], [], []
        for chunk, planes, count in X.blobs(table):
            gaps = np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel()
            chunks.append(int(np.frombuffer(chunk, dtype=np.int64)[0]))
            codes.append(np.cumsum(gaps, dtype=np.uint32))
            counts.append(np.frombuffer(count, dtype=np.uint8))
        # Each shard is mined by itself.
        found = []
        for shard in sorted({c % shards for c in chunks}):
            mine = [i for i, c in enumerate(chunks) if c % shards == shard]
            code = np.concatenate([codes[i] for i in mine])
            order = np.argsort(code, kind="stable")
            code = code[order]
            head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            total = np.add.reduceat(np.concatenate([counts[i] for i in mine])[order].astype(np.int64), head)
            found.append(code[head][total >= local])
        union = np.unique(np.concatenate(found))
        rows = []
        for chunk, code in zip(chunks, codes):
            place = np.minimum(np.searchsorted(union, code), max(len(union) - 1, 0))
            hit = union[place] == code if len(union) else np.zeros(len(code), dtype=bool)
            rows.append((-1 - chunk, X.pack(np.int64(key[0].as_py()), np.int64(len(code)), np.packbits(hit))))
        return X.mail(rows)

    return run


# ---------------------------------------------------------------- pass 2: exact counts


def _recount(longest: int, n_buckets: int, n_sums: int):
    def run(key, table, answers):
        p = _Phrases(opened(table), longest)
        order, bucket, _ = _sorted_codes(p, n_buckets)
        hit = np.zeros(len(order), dtype=bool)
        for to, n, bits in X.blobs(answers):
            to, n = (int(np.frombuffer(x, dtype=np.int64)[0]) for x in (to, n))
            a, b = np.searchsorted(bucket, [to, to + 1])
            if b - a != n:
                raise ValueError("a chunk did not count the same phrases in both passes")
            hit[a:b] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=n).astype(bool)
        rows = order[hit]
        names = json.dumps(p.langs).encode()
        out = [
            # All words of a language: the phrase of no words.
            (_name_hash(name) % n_sums, _counts(names, np.array([i]), np.zeros(1, dtype=np.int64), p.words[i : i + 1], np.zeros(1, dtype=np.int64), b""))
            for i, name in enumerate(p.langs)
            if p.words[i]
        ]
        plain, place = p.joined()
        begin = place[p.at[rows]]
        length = place[p.at[rows] + p.k[rows]] - 1 - begin
        lang, k, count = p.lang[p.at[rows]], p.k[rows], p.count[rows]
        to_sum = (T.mix(p.code[rows], 60) % np.uint64(n_sums)).astype(np.int64)
        del p
        for to, part in X.split_by(to_sum):
            out.append((to, _counts(names, lang[part], k[part], count[part], length[part], _slices(plain, begin[part], length[part]))))
        return X.mail(out)

    return run


def _counts(names: bytes, lang, k, count, length, data) -> bytes:
    return X.pack(names, lang.astype(np.int32), k.astype(np.int8), count.astype(np.int64), length.astype(np.int32), data)


def _sum(support: int):
    def run(key, table):
        parts = []
        for names, lang, k, count, length, data in X.blobs(table):
            names = pa.array(json.loads(names), pa.string())
            offsets = np.concatenate([[0], np.cumsum(np.frombuffer(length, dtype=np.int32), dtype=np.int64)])
            phrase = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
            columns = [names.take(pa.array(np.frombuffer(lang, dtype=np.int32))), phrase, pa.array(np.frombuffer(k, dtype=np.int8)).cast(pa.int32())]
            parts.append(pa.table([*columns, pa.array(np.frombuffer(count, dtype=np.int64))], names=["lang", "phrase", "k", "n"]))
        total = pa.concat_tables(parts).group_by(["lang", "phrase", "k"]).aggregate([("n", "sum")])
        enough = (total.column("n_sum").to_numpy() >= support) | (total.column("k").to_numpy() == 0)
        total = total.filter(pa.array(enough))
        out = [total.column("lang"), total.column("phrase").cast(pa.large_string()).cast(pa.string()), total.column("k"), total.column("n_sum")]
        T.trim()
        return pa.table(out, schema=PHRASES_ARROW)

    return run


def frequent_phrases(
    docs: DataFrame,
    support: int = 30,
    longest: int = 4,
    shards: int = 10,
    chunk_bytes: int = X.CHUNK_BYTES,
    bucket_bytes: int = 8 << 20,
    sum_bytes: int = 16 << 20,
) -> DataFrame:
    """lang, phrase, k (words), n (occurrences) of all phrases with ``support`` or more occurrences,
    and, as the phrase of no words, the number of words of each language."""
    local = -(-support // shards)
    if not 1 <= local <= 255:
        raise ValueError("the local support, support / shards, must be 1 to 255")
    lang = F.coalesce(F.col("lang"), F.lit("und"))
    headed = F.concat(F.lpad(F.octet_length(lang).cast("string"), _HEAD, "0"), lang, F.coalesce(F.col("text"), F.lit("")))
    texts = docs.select("doc_id", headed.alias("text"))
    total = X.text_bytes(docs)
    n_buckets, n_sums = max(1, math.ceil(total / bucket_bytes)), max(1, math.ceil(total / sum_bytes))
    parts = parcelled(texts, total, chunk_bytes)
    sent = parts.groupBy("chunk").applyInArrow(_send(longest, local, n_buckets), X.MAIL)
    answers = sent.groupBy("key").applyInArrow(_mine(shards, local), X.MAIL).select((-1 - F.col("key")).alias("chunk"), "blob")
    counted = parts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_recount(longest, n_buckets, n_sums), X.MAIL)
    return counted.groupBy("key").applyInArrow(_sum(support), PHRASES)


# ---------------------------------------------------------------- scores and ranks


def _exact(c) -> F.Column:
    return c.cast("decimal(19,0)")


def collocations(phrases: DataFrame, top: int = 2000, slices: int = 32) -> DataFrame:
    """``frequent_phrases`` -> lang, rank, phrase, a, l, r, n, score: the first ``top`` of each language."""
    counts = phrases.where("k > 0").select("lang", "phrase", "k", "n")
    w = F.split("phrase", " ")
    cuts = counts.where("k > 1").select("lang", "phrase", F.col("n").alias("a"), w.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.size("w")).alias("tail"))
    for side, count in (("head", "l"), ("tail", "r")):
        known = counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(count))
        cuts = cuts.join(known, ["lang", side])
    # Products may pass 64 bits: decimals, divided without a remainder.
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * _exact(F.col("a")), _exact(F.col("l")) + _exact(F.col("r")))
    cuts = cuts.withColumn("key", score * 8 + F.col("cut"))  # the least score, then the first cut
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min("key").alias("key"), F.min_by("l", "key").alias("l"), F.min_by("r", "key").alias("r"))
    scored = scored.withColumn("score", F.shiftright("key", 3))
    # The most frequent phrase of one word more around each phrase.
    inner = F.explode(F.array(F.array_join(F.slice(w, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("k") - 1), " ")))
    around = counts.where("k > 2").select("lang", inner.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = scored.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (_exact(F.col("longer")) * 100 < _exact(F.col("a")) * 80)
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    kept = kept.select("lang", "phrase", "a", "l", "r", "score", F.pmod(F.xxhash64("phrase"), F.lit(slices)).alias("slice"))
    best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    words = phrases.where("k = 0").select("lang", "n")
    return best.join(words, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return collocations(stage(frequent_phrases(docs), "phrases"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents
),
p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS c FROM g GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
s AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE c >= 30),
c AS (
  SELECT s.lang, s.phrase, s.k, s.c AS a, j, x.c AS l, y.c AS r, 2000000 * s.c::HUGEINT // (x.c + y.c) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM s WHERE k > 1) s
  JOIN f x ON x.lang = s.lang AND x.phrase = array_to_string(s.w[1:j], ' ')
  JOIN f y ON y.lang = s.lang AND y.phrase = array_to_string(s.w[j + 1:], ' ')
),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (
  SELECT DISTINCT v.lang, v.phrase FROM (
    SELECT lang, c, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (
      SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM s WHERE k > 2))
  ) u JOIN b v ON v.lang = u.lang AND v.phrase = u.phrase WHERE 100 * u.c::HUGEINT >= 80 * v.a::HUGEINT
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase) ASC) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM b JOIN n USING (lang) WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.phrase = b.phrase)
QUALIFY rank <= 2000
"""
