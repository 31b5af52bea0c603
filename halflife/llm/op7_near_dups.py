"""Operator 7: near-duplicate documents by one-permutation MinHash and verified links.

1. *Sets.*  A document's set is its distinct 5-word shingles (A-Z lower-cased); with
   fewer words the whole sequence is one shingle; without words it is empty and
   linked with nothing.  Documents of equal sets are one *class* from here on, under a
   number of its own, so a group of exact copies costs one row.
2. *Signature.*  One hash of every shingle; its high part is a bin, the least hash
   in a bin is the bin's value.  An empty bin takes the value of the first
   non-empty bin of its own random probe sequence (optimal densification).
3. *Bands.*  ``rows`` bins are one band; classes that agree in a band share a bucket.
   At similarity s two sets share one of b bands with probability
   1 - (1 - s^r)^b: 0.99998 for s = 0.75 with 40 bands of 5.
4. *Stars.*  A bucket proposes edges from a centre to its other members, never all
   pairs.  Each proposed edge is confirmed on the full sets.  After that, buckets
   whose members are still in several components choose a new centre and propose
   edges to the members of other components, until a round (the third or a later one)
   confirms nothing; what is left to the exact finish then is little.  Buckets that are one component propose nothing, and a round's
   links only join the components that the rounds before it made.
5. *Exact finish.*  Buckets of three or more that are still in several components hold
   pairs that no centre has tested.  Their members order their shingles by rarity
   among themselves; two sets that are similar enough share one of the first
   n - (least overlap) + 1 of both.  All such pairs of different components are
   confirmed like other edges.  What many members have in common stands last in that
   order, so a family with common boilerplate is not paired all with all.
6. *Components* of the confirmed links (alternating stars); the smallest id names them.

What can be lost: a pair that shares no band (above).
No bucket is capped and nothing is sampled.

Scale: sets are computed in a narrow map and never leave it; what is shuffled per
class is one row per band (16 bytes).  Bucket centres are minima, combined before the
shuffle, and handed out by a join that Spark splits when skewed.  Texts move
once, for classes that share a bucket, and per proposed edge once more.

Edge cases: null text is the empty text.  Rows with a null id are linked like others
(under a number of their text's hash, above all ids); if no id is known in a
component, component_id is null and kept is true (``drop_near_duplicates`` keeps one).  Repeated
rows are in one class; rows of one id with different texts are linked row by row, each by its
own text.  An empty table gives an empty result.  Other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halflife.llm import text as T
from halflife.llm.components import between, join_components
from halflife.session import stage

NAMELESS = 1 << 62  # rows without an id are numbered from here on
SIGNATURE = "doc_id long, th long, n_shingles long, k1 long, k2 long, bands array<long>"


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Distinct shingle hashes, ascending, of one document's word hashes."""
    if len(words) == 0:
        return words
    if len(words) < size:
        return T.mix(T.windows(words, len(words), 20 + len(words)), 21)
    return np.unique(T.mix(T.windows(words, size, 20), 21))


class Densifier:
    """Probe sequences of the bins; every empty bin asks its own until one is full."""

    def __init__(self, bins: int):
        self.bins = bins
        self.probes = np.zeros((bins, 0), dtype=np.int64)

    def _at(self, upto: int) -> np.ndarray:
        have = self.probes.shape[1]
        if have < upto:
            j, t = np.meshgrid(np.arange(self.bins, dtype=np.uint64), np.arange(have, upto, dtype=np.uint64), indexing="ij")
            more = (T.mix(j * np.uint64(1 << 32) + t, 23) % np.uint64(self.bins)).astype(np.int64)
            self.probes = np.hstack([self.probes, more])
        return self.probes

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Bin values of a non-empty set given as ascending hashes."""
        bin_of = ((shingles >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bin_of[1:] != bin_of[:-1]]))
        out = np.zeros(self.bins, dtype=np.uint64)
        full = np.zeros(self.bins, dtype=bool)
        out[bin_of[first]] = shingles[first]
        full[bin_of[first]] = True
        empty, done, upto = np.flatnonzero(~full), 0, 32
        while len(empty):
            probe = self._at(upto)[empty, done:upto]
            hit = full[probe]
            got = hit.any(axis=1)
            out[empty[got]] = out[probe[got, hit[got].argmax(axis=1)]]
            empty, done, upto = empty[~got], upto, upto * 4
        return out


def _signatures(bands: int, rows: int, size: int):
    def run(batches):
        dense = Densifier(bands * rows)
        number = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            T.trim()
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                data, offsets = T.flat(part.column("text"))
                starts, ends, first = T.word_spans(data, offsets)
                h = T.word_hashes(data, starts, ends, lower=True)
                n, k1, k2, band_rows = [], [], [], []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    s = shingle_hashes(h[a:b], size)
                    n.append(len(s))
                    k1.append(int(T.mix(s, 31).sum().astype(np.int64)) if len(s) else 0)
                    k2.append(int(T.mix(s, 32).sum().astype(np.int64)) if len(s) else 0)
                    if len(s):
                        v = T.mix(T.mix(dense.signature(s), 33).reshape(bands, rows) * (2 * np.arange(rows, dtype=np.uint64) + np.uint64(1)), 34).sum(axis=1)
                        band_rows.append(T.mix(v + number * np.uint64(0x9E3779B97F4A7C15), 35).astype(np.int64))
                    else:
                        band_rows.append(np.zeros(0, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(band_rows, pa.list_(pa.int64()))],
                    names=["doc_id", "th", "n_shingles", "k1", "k2", "bands"],
                )

    return T.trimmed(run)


def _confirm(size: int, percent: int):
    """Rows (a, c, ta, tc), c in runs -> the links with 100 |A n C| >= percent |A u C|."""

    def sets(column):
        data, offsets = T.flat(column)
        starts, ends, first = T.word_spans(data, offsets)
        h = T.word_hashes(data, starts, ends, lower=True)
        return [shingle_hashes(h[x:y], size) for x, y in zip(first[:-1].tolist(), first[1:].tolist())]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                centres = part.column("c").to_pylist()
                # A centre's text comes with each of its edges; its set is made once per run.
                heads = [i for i, c in enumerate(centres) if i == 0 or c != centres[i - 1]]
                made = dict(zip((centres[i] for i in heads), sets(part.column("tc").take(pa.array(heads)))))
                keep = []
                for i, s in enumerate(sets(part.column("ta"))):
                    other = made[centres[i]]
                    both = len(np.intersect1d(s, other, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(s) + len(other) - both))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(keep)), part.column("c").filter(pa.array(keep))], names=["a", "c"])

    return T.trimmed(run)


def _shingles(size: int):
    """Rows (rep, text) -> one row per distinct shingle."""

    def run(batches):
        for batch in batches:
            T.trim()
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                data, offsets = T.flat(part.column("text"))
                starts, ends, first = T.word_spans(data, offsets)
                h = T.word_hashes(data, starts, ends, lower=True)
                sets = [shingle_hashes(h[a:b], size) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                rep = np.repeat(part.column("rep").to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(np.concatenate(sets).view(np.int64))], names=["rep", "shingle"])

    return T.trimmed(run)


def _prefix_pairs(left: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges between all of ``left`` (rep, comp, n) of different components that can be similar enough."""
    shingles = texts.join(left.select("rep"), "rep").select("rep", "text").mapInArrow(_shingles(size), "rep long, shingle long")
    # A shingle of one set only comes first in the order and meets nobody: it is counted, not kept.
    often = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    met = shingles.join(often, "shingle").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("met"))
    # Sets of a and b shingles need percent (a + b) / (100 + percent) in common, so the first common one stands at a
    # place of both with reach = 100 n - (100 + percent) (place - 1) >= percent times the other's n.
    before = F.col("n") - F.col("size") + F.col("at")
    placed = met.join(left, "rep").select("rep", "comp", "n", F.size("met").alias("size"), F.posexplode("met").alias("at", "m"))
    prefix = placed.withColumn("reach", 100 * F.col("n") - (100 + percent) * before).where(100 * F.col("reach") >= percent * percent * F.col("n"))
    prefix = stage(prefix.select("rep", "comp", "n", "reach", F.col("m.shingle").alias("shingle")), "near-prefixes")
    # By way of the components that meet, each cut into cells of about equal size and reach: members of one component
    # are not paired first and dropped then, and of two large components only the cells that can be similar enough meet.
    cell = F.floor(F.log("n") * 8) * 16 + F.floor((F.col("reach") / F.col("n") - percent * percent / 100) / 4)
    prefix = prefix.withColumn("cell", cell)
    groups = prefix.groupBy("shingle", "comp", "cell").agg(F.min("n").alias("n"), F.max("reach").alias("reach"))

    def side(table: DataFrame, s: str) -> DataFrame:
        return table.select("shingle", *[F.col(c).alias(f"{s}_{c}") for c in table.columns if c != "shingle"])

    fits = (F.col("x_reach") >= percent * F.col("y_n")) & (F.col("y_reach") >= percent * F.col("x_n"))
    both = side(groups, "x").join(side(groups, "y"), "shingle").where(fits & (F.col("x_comp") < F.col("y_comp")))
    both = both.select("shingle", "x_comp", "x_cell", "y_comp", "y_cell", F.col("y_n").alias("least_n"), F.col("y_reach").alias("most_reach"))
    half = both.join(side(prefix, "x"), ["shingle", "x_comp", "x_cell"])
    half = half.where((F.col("x_reach") >= percent * F.col("least_n")) & (F.col("most_reach") >= percent * F.col("x_n"))).drop("least_n", "most_reach")
    pairs = half.join(side(prefix, "y"), ["shingle", "y_comp", "y_cell"]).where(fits)
    return pairs.select(F.greatest("x_rep", "y_rep").alias("a"), F.least("x_rep", "y_rep").alias("c")).distinct()


def near_duplicates(docs: DataFrame, bands: int = 40, rows: int = 5, size: int = 5, percent: int = 75, rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text); th is the text's hash, and
    first is true for one text of each component: the one that stays."""
    th = F.xxhash64("text")
    number = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NAMELESS) + F.pmod(th, F.lit(NAMELESS // 2)))
    read = docs.select(number.alias("doc_id"), "text", th.alias("th"))
    signed = stage(read.mapInArrow(_signatures(bands, rows, size), SIGNATURE), "near-signatures")
    key = ["k1", "k2", "n_shingles"]
    classes = (
        signed.where("n_shingles > 0")
        .groupBy(*key)
        .agg(F.min(F.struct("doc_id", "th")).alias("own"), F.any_value("bands").alias("bands"))
        # A class has a number of its own: an id with two texts may lead two classes.
        .withColumn("rep", F.monotonically_increasing_id())
    )
    classes = stage(classes, "near-classes")
    in_band = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = in_band.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("bucket")
    members = stage(in_band.join(shared, "bucket"), "near-members")
    heads = classes.join(members.select("rep").distinct(), "rep").select("rep", "own.doc_id", "own.th")
    texts = stage(read.join(heads, ["doc_id", "th"]).select("rep", "text").dropDuplicates(["rep"]), "near-texts")

    def propose(at: DataFrame, turn: int) -> DataFrame:
        """Edges from each bucket's centre of this round to members of other components."""
        choice = F.struct((F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn), "bucket")).alias("order"), "rep", "comp", "n")
        centre = at.groupBy("bucket").agg(F.min(choice).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
        centre = centre.select("bucket", F.col("m.rep").alias("c"), F.col("m.comp").alias("c_comp"), F.col("m.n").alias("c_n"))
        # Sets of too different a size cannot be similar enough: 100 min >= percent max.
        edge = at.join(centre, "bucket").where("comp <> c_comp").where(100 * F.least("n", "c_n") >= percent * F.greatest("n", "c_n"))
        return edge.select(F.greatest("rep", "c").alias("a"), F.least("rep", "c").alias("c")).distinct()

    def confirmed(edges: DataFrame) -> DataFrame:
        pairs = edges.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("rep").alias("c"), F.col("text").alias("tc")), "c")
        return stage(pairs.select("a", "c", "ta", "tc").mapInArrow(_confirm(size, percent), "a long, c long"), "near-links")

    def placed(component: DataFrame | None) -> DataFrame:
        if component is None:
            return members.withColumn("comp", F.col("rep"))
        return members.join(component, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "rep")).drop("node", "root")

    # The state is (node, root); a round's new links are few, and only they are worked on.
    tested, component, turn = None, None, 0
    while True:
        edges = propose(placed(component), turn)
        if tested is not None:
            edges = edges.join(tested, ["a", "c"], "left_anti")
        edges = stage(edges, "near-edges")
        tested = edges if tested is None else tested.unionByName(edges)
        found = confirmed(edges)
        turn += 1
        if not found.isEmpty():
            component = join_components(component, found.select(F.col("a").alias("u"), F.col("c").alias("v")))
        elif component is None or turn >= rounds:
            break
    # Two members were tested against each other when one was the centre.
    at = placed(component)
    open_buckets = at.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("m > 2 and lo <> hi")
    left = stage(at.join(open_buckets.select("bucket"), "bucket").select("rep", "comp", "n").distinct(), "near-left")
    if not left.isEmpty():
        found = confirmed(stage(_prefix_pairs(left, texts, size, percent).join(tested, ["a", "c"], "left_anti"), "near-edges"))
        # A family that is linked all with all needs few of its links: each node's least one, then those between the
        # components that makes, until none is left.
        found = found.select(F.col("a").alias("u"), F.col("c").alias("v"))
        while not found.isEmpty():
            component = join_components(component, found.groupBy("u").agg(F.min("v").alias("v")))
            found = stage(between(component, found).distinct(), "near-links")
    of_class = classes.select(*key, "rep", "own")
    if component is None:
        of_class = of_class.select(*key, F.col("own").alias("least"))
    else:
        tied = component.unionByName(component.select(F.col("root").alias("node"), "root").distinct())
        named = of_class.select(F.col("rep").alias("node"), "own").join(tied, "node")
        least = tied.join(named.groupBy("root").agg(F.min("own").alias("least")), "root").select(F.col("node").alias("rep"), "least")
        of_class = of_class.join(least, "rep", "left").select(*key, F.coalesce("least", "own").alias("least"))
    out = signed.drop("bands").join(of_class, key, "left")
    least = F.coalesce("least", F.struct("doc_id", "th"))
    known = lambda c: F.when(c < NAMELESS, c)
    out = out.select(known(F.col("doc_id")).alias("doc_id"), "th", "n_shingles", known(least["doc_id"]).alias("component_id"), (F.struct("doc_id", "th") == least).alias("first"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each group: of its rows the one with the smallest id (with no id known, and
    between texts of one id, the one with the smallest text hash).

    Rows equal in id and text are copies of each other; one of them stays.
    """
    found = near_duplicates(docs, **options).where("first").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    named = docs.withColumn("__key", F.xxhash64("text"))
    kept = named.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__th")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__key"]).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("th", "first")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)
),
r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b
),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
