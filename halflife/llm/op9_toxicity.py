"""Operator 9: toxicity by a weighted finite-state pattern grammar.

Words become symbols, symbols become clause readings, readings become a score:

1. *Lexicon transducer.*  Word beginnings (and whole words) that mark toxic
   documents, each with the lower bound of its log-odds learnt from labelled rows.
   A word is read by its longest entry; a beginning whose toxic documents are
   nearly all those of one longer entry gives way to that one; longer
   beginnings that clean documents use are entries of weight 0.  Threats, targets,
   negations and reporting verbs are small fixed word lists.
2. *Scope transducer.*  Reads a clause left to right and keeps, as its state, how
   many words a negation still reaches, whether the words are reported speech, and
   whether a target was named.  Each insult or threat leaves it as one of the
   readings plain, targeted, negated, reported.
3. *Clause transducer.*  Adds up the weights of the readings of a clause; a clause
   is scored as a whole, isolated words never are.
4. The clause readings of a document are summed up in a few numbers, and a
   logistic model, fitted on the same labelled sample, weighs them.  So how much
   a negation excuses or a target aggravates is learnt, not assumed.

Learning sees at most ``max_toxic`` toxic and ``max_clean`` clean labelled
documents (those with the smallest hash of their id): this bound is a parameter
of the classifier and the only place where rows are sampled.  A lexicon entry
needs support from several different neighbourhoods (word before, word after),
so copies of one document teach nothing new.  Scoring reads every whole text.

Scale: learning is one aggregation over the bounded sample; the grammar (at most
``max_terms`` entries) travels to the workers in the closure.  Scoring is a
narrow map, no shuffle.

Edge cases: null and empty texts have no clauses and get the score of a document
without any reading.  Without labelled rows of both classes the grammar has no
learnt entries and the score is the share of toxic labels (0.5 without labels).
Labels null or of unknown documents teach nothing.  Null ids and repeated rows are
scored row by row; an empty table gives an empty result.  Other columns are passed
through by ``score_toxicity`` unless they are called like an output.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from halflife.llm import text as T
from halflife.session import stage

# Small fixed word lists, four languages in a row: English, German, French, Spanish.
THREATS = frozenset(
    "kill hurt destroy burn beat attack murder shoot punish töten umbringen schlagen verletzen vernichten "
    "tuer frapper détruire brûler matar golpear destruir quemar".split()
)
TARGETS = frozenset(
    "you your yours they them their he him she her these those du dich dein ihr euch sie ihnen "
    "tu toi te vous ils elles eux leur tú ti usted ustedes ellos ellas vosotros".split()
)
NEGATIONS = frozenset("not no never none nobody hardly cannot nicht kein keine nie niemals niemand ne pas jamais aucun nunca nadie ningún jamás".split())
REPORTS = frozenset(
    "said says say wrote called quoted claimed reported alleged sagte sagt schrieb nannte behauptete "
    "dit écrit appelé affirme dijo dice escribió llamó afirma".split()
)
QUOTES = frozenset("\"“”„«»")
NEGATION_REACH = 3

CLAUSE_END = re.compile(r"[.!?;\n]")
TOKEN = re.compile(r"[\"“”„«»]|[^\s.,!?;:()\"“”„«»]+")
PREFIXES = range(3, 9)
READINGS = ("plain", "targeted", "negated", "reported", "threat")


def terms_of(word: str) -> Iterator[str]:
    """The word's entries in the lexicon: its beginnings, and itself with an end mark."""
    for n in PREFIXES:
        if len(word) < n:
            break
        yield word[:n]
    if len(word) >= 3:
        yield word + "$"


class Grammar:
    """Learnt lexicon and model; small, and shipped to the workers as it is."""

    def __init__(self, lexicon: dict[str, float], threats: dict[str, float], weights: list[float], bias: float):
        self.lexicon, self.threats, self.weights, self.bias = lexicon, threats, weights, bias
        self._finder = None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "threats": self.threats, "weights": self.weights, "bias": self.bias, "_finder": None}

    def finder(self):
        import ahocorasick

        if self._finder is None:
            found = ahocorasick.Automaton()
            for term in {*(t for t, w in self.lexicon.items() if w > 0), *(w + "$" for w, x in self.threats.items() if x > 0)}:
                found.add_word(term.rstrip("$"), len(term.rstrip("$")))
            if len(found):
                found.make_automaton()
            self._finder = found
        return self._finder

    def insult(self, word: str) -> float:
        """Weight of the word's longest entry."""
        weight = 0.0
        for term in terms_of(word):
            weight = self.lexicon.get(term, weight)
        return weight

    def clauses(self, text: str) -> list[str]:
        """The clauses in which some entry begins a word."""
        low = text.lower()
        finder = self.finder()
        if not len(finder):
            return []
        hits = [end + 1 - n for end, n in finder.iter(low)]
        hits = [a for a in hits if a == 0 or not low[a - 1].isalnum()]
        if not hits:
            return []
        stops = [m.start() for m in CLAUSE_END.finditer(low)]
        out = []
        for k in sorted({bisect_left(stops, a) for a in hits}):
            out.append(low[stops[k - 1] + 1 if k else 0 : stops[k] if k < len(stops) else len(low)])
        return out

    def read(self, clause: str) -> dict[str, float]:
        """Run the composed transducers over one clause: weight of each reading."""
        out = dict.fromkeys(READINGS, 0.0)
        negated, reported, target, found = 0, False, False, []
        for token in TOKEN.findall(clause):
            if token in QUOTES:
                reported = not reported
                continue
            if token in NEGATIONS or token.endswith("n't"):
                negated = NEGATION_REACH + 1
            elif token in REPORTS:
                reported = True
            elif token in TARGETS:
                target = True
            elif (weight := self.insult(token)) > 0:
                found.append(("reported" if reported else "negated" if negated else "plain", weight))
            elif (weight := self.threats.get(token, 0.0)) > 0:
                found.append(("reported" if reported else "negated" if negated else "threat", weight))
            negated = max(0, negated - 1)
        for reading, weight in found:  # a target anywhere in the clause is meant
            out["targeted" if target and reading == "plain" else reading] += weight
        return out

    def features(self, text: str | None) -> list[float]:
        total, worst, matched = dict.fromkeys(READINGS, 0.0), 0.0, 0
        for clause in self.clauses(text) if text else ():
            reading = self.read(clause)
            if (all_ := sum(reading.values())) > 0:
                matched += 1
                worst = max(worst, all_)
                for r in READINGS:
                    total[r] += reading[r]
        return [math.log1p(total[r]) for r in READINGS] + [math.log1p(worst), math.log1p(matched)]

    def score(self, text: str | None) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


# ---------------------------------------------------------------- learning


def _sample(labels: DataFrame, max_toxic: int, max_clean: int) -> DataFrame:
    """(doc_id, toxic) of the labelled rows to learn from."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    key = F.xxhash64(F.col("doc_id"), F.lit(9))
    toxic = rows.where(F.col("toxic") == 1).orderBy(key, "doc_id").limit(max_toxic)
    clean = rows.where(F.col("toxic") == 0).orderBy(key, "doc_id").limit(max_clean)
    return toxic.unionByName(clean).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _count_terms(batches):
    """(term, toxic documents, clean documents, neighbourhood bits) per part of the sample."""
    seen: dict[str, list[int]] = {}

    def flush():
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(seen)), *[pa.array([v[i] for v in seen.values()], pa.int64()) for i in range(3)]],
            names=["term", "pos", "neg", "near"],
        )
        seen.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = TOKEN.findall(text.lower()) if text else []
            bits: dict[str, int] = {}
            for i, word in enumerate(words):
                near = 0
                if toxic:
                    around = (words[i - 1] if i else "") + " " + (words[i + 1] if i + 1 < len(words) else "")
                    near = 1 << (sum(around.encode()) * 2654435761 >> 7) % 62
                for term in terms_of(word[:40]):
                    if term.endswith("$") and len(word) > 40:
                        continue  # the entry of another, shorter word
                    bits[term] = bits.get(term, 0) | near
            for term, near in bits.items():
                v = seen.get(term)
                if v is None:
                    v = seen[term] = [0, 0, 0]
                v[0 if toxic else 1] += 1
                v[2] |= near
            if len(seen) > 200_000:
                yield flush()
    if seen:
        yield flush()


def beginnings(term: str) -> list[str]:
    """The shorter terms that a word of this term also has."""
    word = term.rstrip("$")
    return [word[:n] for n in PREFIXES if n < len(word) or (n == len(word) and term != word)]


def most_specific(seen: dict[str, tuple[int, int]], share: float = 0.85) -> set[str]:
    """Terms without those that owe ``share`` of their toxic documents to a longer term, no less clean."""
    keep = set(seen)
    for term, (pos, neg) in seen.items():
        for short in beginnings(term):
            if short in seen and pos >= share * seen[short][0] and neg <= seen[short][1]:
                keep.discard(short)
    return keep


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, steps: int = 60) -> np.ndarray:
    """Newton steps for a ridge logistic model; the last weight is the bias.

    Without any feature a document gets the share of toxic rows in the sample.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = l2 * np.eye(x.shape[1]) * max(1.0, len(y) / 100)
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(len(w)), x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(
    docs: DataFrame,
    labels: DataFrame,
    max_toxic: int = 4000,
    max_clean: int = 8000,
    max_terms: int = 5000,
    least_weight: float = 2.0,
    least_near: int = 3,
    least_share: float = 0.01,
) -> Grammar:
    """Fit the grammar on labelled documents (the caller chooses which labels may teach)."""
    # At most max_toxic + max_clean rows of (long, int): a proven bound for the broadcast.
    teach = F.broadcast(_sample(labels, max_toxic, max_clean))
    # Copies teach once; a text with both labels is toxic.
    sample = stage(docs.select("doc_id", "text").join(teach, "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-sample")
    schema = "term string, pos long, neg long, near long"
    counts = sample.mapInArrow(_count_terms, schema).groupBy("term").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.bit_count(F.bit_or("near")).alias("near")
    )
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_neg:
        rate = 0.5 if not n_pos and not n_neg else 0.999 if n_pos else 0.001
        return Grammar({}, {}, [0.0] * (len(READINGS) + 2), math.log(rate / (1 - rate)))
    counts = stage(counts, "toxic-terms")
    weight = F.log((F.col("pos") + 0.5) / (n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / (n_neg + 1.0))
    weight = weight - 1.64 * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    least_pos = max(3, math.ceil(n_pos * least_share))
    best = (
        counts.withColumn("weight", weight)
        .where((F.col("weight") >= least_weight) & (F.col("pos") >= least_pos))
        .where(F.col("near") >= F.greatest(F.lit(least_near), F.least(F.lit(20), F.col("pos") / 3)))
        .orderBy((F.col("weight") * F.log1p("pos")).desc(), "term")
        .limit(max_terms)
        .collect()
    )
    chosen = most_specific({r["term"]: (r["pos"], r["neg"]) for r in best})
    lexicon = {r["term"]: float(r["weight"]) for r in best if r["term"] in chosen}
    # Longer beginnings of the same words that are no sign of toxicity: entries of weight 0.
    heads = F.array(*[F.substring("word", 1, n) for n in PREFIXES])
    longer = counts.where(F.col("neg") > 0).withColumn("word", F.regexp_replace("term", r"\$$", ""))
    longer = longer.where(F.arrays_overlap(heads, F.array(*[F.lit(t) for t in sorted(chosen)]))) if chosen else longer.limit(0)
    for r in longer.orderBy(F.col("neg").desc(), "term").limit(max_terms).select("term").collect():
        if r["term"] not in lexicon and any(h in lexicon for h in beginnings(r["term"])):
            lexicon[r["term"]] = 0.0
    known = counts.where(F.col("term").isin([w + "$" for w in sorted(THREATS)])).select("term", weight.alias("weight"), (F.col("pos") + F.col("neg")).alias("n"))
    measured = {r["term"][:-1]: float(r["weight"]) for r in known.collect() if r["n"] >= 5}
    threats = {w: max(0.0, measured.get(w, least_weight)) for w in THREATS}
    grammar = Grammar(lexicon, threats, [0.0] * (len(READINGS) + 2), 0.0)

    def featured(batches):
        for batch in batches:
            rows = [grammar.features(t) for part in _texts(batch.column("text")) for t in part]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    rows = sample.mapInArrow(featured, "x array<double>, toxic int").collect()  # bounded by the sample
    rows.sort(key=lambda r: (r["toxic"], r["x"]))
    w = fit_logistic(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], dtype=float))
    return Grammar(lexicon, threats, [float(v) for v in w[:-1]], float(w[-1]))


def _texts(column, rows: int = 200) -> Iterator[list]:
    """A batch's texts, a few at a time: they are Python strings only while they are read."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


def score_toxicity(docs: DataFrame, grammar: Grammar, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of every whole text and predicted (1 if score >= 0.5).

    Only texts go to the Python workers and only scores come back.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            scores = [grammar.score(t) for part in _texts(column) for t in part]
            del column
            T.trim()
            yield pa.array(scores, pa.float64())

    score = F.arrow_udf(run, DoubleType())
    keep = [c for c in docs.columns if c not in (out, "predicted")]
    return docs.select(*keep, score(F.col(text)).alias(out)).withColumn("predicted", (F.col(out) >= 0.5).cast("int"))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def teachable(labels: DataFrame) -> DataFrame:
    """The labels one may learn from: not held out."""
    return labels.where(~held_out())


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs.select("doc_id", "text"), learn(docs, teachable(labels)))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
