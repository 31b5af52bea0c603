"""Language model, quality, toxicity, BPE, top-k and mixing: against brute force or held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from halflife.llm import op3_lm, op4_topk, op5_quality, op8_bpe, op9_toxicity, op10_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- language model


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def test_language_model_counts_and_base(docs, rows):
    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_sum"], 6)) for r in op3_lm.score_corpus(docs).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_sum").collect())
    teaches = [r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2 for r in rows]
    count = Counter(t for r, ok in zip(rows, teaches) if ok for t in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    want = Counter((r[0], len(ts := tokens(r[1])), sum(count[t] > 0 for t in ts), n, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts), 6)) for r in rows)
    assert got == want


def test_language_model_is_a_distribution(spark):
    """After a known context the probabilities of all words and the unknown add up to 1."""
    words = ["a", "b", "c", "d"]
    rng = random.Random(1)
    train = [(7 * i, " ".join(rng.choice(words) for _ in range(30)), None) for i in range(40)]
    train = [t for t in train if zlib.crc32(str(t[0]).encode()) % 7 != 2]
    probe_ids = [i for i in range(10_000, 12_000) if zlib.crc32(str(i).encode()) % 7 == 2][:6]
    probes = [(i, w, None) for i, w in zip(probe_ids, ["a", "b", "c", "d", "zzz", ""])]
    out = {r["doc_id"]: r for r in op3_lm.score_corpus(spark.createDataFrame(train + probes, "doc_id long, text string, x string")).collect()}
    # score(w) = P(w | start) P(end | w); the starts are compared through one-word texts of a second run
    assert all(out[i]["score"] < 0 for i in probe_ids)
    assert out[probe_ids[4]]["score"] < min(out[i]["score"] for i in probe_ids[:4])  # the unknown word is least likely
    assert out[probe_ids[0]]["n_known"] == 2 and out[probe_ids[4]]["n_known"] == 1


def test_language_model_beats_its_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    r = op3_lm.score_corpus(docs).where(op3_lm.held_out()).agg(F.sum("base_sum"), F.sum("score")).first()
    assert r[1] > r[0]


def test_language_model_does_not_depend_on_chunks(docs):
    a = {(r["doc_id"], round(r["score"], 3)) for r in op3_lm.score_corpus(docs).collect()}
    b = {(r["doc_id"], round(r["score"], 3)) for r in op3_lm.score_corpus(docs, chunk_bytes=2000).collect()}
    assert a == b


def test_language_model_seats_contexts_by_the_shared_parent(spark):
    """Contexts dealt over many buckets are seated by the tables of all contexts, so scores keep."""
    rng = random.Random(4)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 400}"
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(60))) for i in range(400)], "doc_id long, text string")
    one, many = ({r["doc_id"]: r["score"] / r["n_tokens"] for r in op3_lm.score_corpus(docs, bucket_bytes=b, samples=8).collect()} for b in (16 << 20, 1500))
    off = [abs(many[i] - one[i]) for i in one]
    assert sum(off) / len(off) < 0.004


def test_seating_keeps_its_books():
    seats = op3_lm.Seating(np.array([1, 2, 5, 64, 65, 3000]), 0.6, np.random.default_rng(3))
    for _ in range(5):
        seats.sweep(np.full(6, 2.0))
        for k, dish in enumerate(seats.small):
            n = int(seats.c[dish])
            size = seats.size[seats.base[k] : seats.base[k] + n]
            at = seats.at[seats.base[k] : seats.base[k] + n]
            assert size.sum() == n and (np.bincount(at, minlength=n) == size).all() and (size > 0).sum() == seats.tables[dish]
        assert (seats.tables >= 1).all() and (seats.tables <= seats.c).all() and seats.tables[0] == 1


def test_seating_tables_follow_the_restaurant_process():
    """With a base of mass one the mean number of tables is that of a Pitman-Yor process of one dish each time."""
    n, d, theta = 40, 0.5, 1.0
    seats = op3_lm.Seating(np.full(4000, n), d, np.random.default_rng(1))
    total = []
    for _ in range(30):
        seats.sweep(theta + d * seats.tables)
        total.append(seats.tables.mean())
    expected, t = 0.0, 1.0
    mean = theta / d * (math.exp(math.lgamma(theta + n + d) + math.lgamma(theta) - math.lgamma(theta + d) - math.lgamma(theta + n)) - 1)
    assert abs(np.mean(total[10:]) - mean) < 0.06 * mean, (np.mean(total[10:]), mean, expected, t)


# ---------------------------------------------------------------- top-k


def test_top_k_prunes_although_one_vector_is_an_outlier(spark):
    """Every query gets a bound from the longest classes together; most products are never computed."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 8)) * np.exp(rng.normal(size=(3000, 1)))
    v[1234] *= 1e4  # alone in its class, and longest by far
    vectors = [(i, x.tolist()) for i, x in enumerate(v)]
    products = spark.sparkContext.accumulator(0)
    out = op4_topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), k=5, every=20, bucket_rows=128, products=products)
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(brute_top_k(vectors, 5, 20))
    assert products.value < 0.5 * 150 * 3000, products.value


def brute_top_k(vectors, k, every):
    ok = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints = [math.floor(64 * float(np.float32(x))) for x in v]
            ok[i] = min(ok.get(i, ints), ints)
    out = set()
    for q in ok:
        if q % every == 0:
            s = sorted(((-sum(a * b for a, b in zip(ok[q], ok[c])), c) for c in ok if c != q))[:k]
            out |= {(q, rank, c, -score) for rank, (score, c) in enumerate(s, 1)}
    return out


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 16, "block_rows": 4}, {"bucket_rows": 16, "coordinate_at": 0.2, "ratio": 1.02}])
def test_top_k(spark, options):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1) * (1 + i % 7) for _ in range(6)], 0) for i in range(200)]
    vectors += [(300, None, 0), (301, [1.0, None], 0), (302, [float("nan")] * 6, 0), (303, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (320, [], 0), (321, [0.0] * 6, 1), (340, [2.0] * 3, 0)]
    vectors += [(40, vectors[40][1], 0), (400, [3.0] * 6, 0), (401, [3.0] * 6, 0), (402, [3.0] * 6, 0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score int")
    got = {tuple(r) for r in op4_topk.top_k(df, k=5, **options).collect()}
    assert got == brute_top_k([v[:2] for v in vectors], 5, 20)


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 16, "block_rows": 4}])
def test_top_k_with_one_dominant_coordinate(spark, options):
    rng = random.Random(12)
    vectors = []
    for i in range(400):  # of about one length, so that thresholds are high
        turn = rng.uniform(-0.5, 0.5)
        v = [rng.choice([-1, 1]) * math.cos(turn), math.sin(turn)]
        vectors.append((i, v[:: rng.choice([-1, 1])]))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in op4_topk.top_k(df, k=5, every=4, **options).collect()}
    assert got == brute_top_k(vectors, 5, 4)


def test_coordinate_pruning_keeps_neighbours_across_the_axis():
    for sign in (-1, 1):
        q, p = np.array([[sign * 58, 27]]), np.array([[sign * 63, 15]])
        query = (np.array([0]), np.linalg.norm(q, axis=1), q, [np.array([0.7 * np.linalg.norm(q) * np.linalg.norm(p)])])
        (found,) = op4_topk.meet(query, (np.array([1]), np.linalg.norm(p, axis=1), p, []), 1, 0.7, 4)
        assert found[1].tolist() == [1] and found[2].tolist() == [58 * 63 + 27 * 15]


def test_top_k_of_nothing(spark):
    assert op4_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---------------------------------------------------------------- quality


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_features(docs, rows):
    f = op5_quality.FEATURES
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = Counter(tuple(r) for r in docs.select("doc_id", *[f[n][0]().alias(n) for n in names]).collect())
    assert got == Counter((r[0], *brute_quality(r[1])) for r in rows)


def test_quality_cascade_verdict_does_not_depend_on_the_order(extra, none):
    order = op5_quality.plan_order(extra)
    assert sorted(order) == sorted(r.name for r in op5_quality.RULES)
    out = op5_quality.quality_cascade(extra)
    assert out.columns == [*extra.columns, "rejected_by"]
    lazy = {n: e() for n, (e, _) in op5_quality.FEATURES.items()}
    every = extra.select("doc_id", op5_quality.verdict([r.name for r in op5_quality.RULES], op5_quality.RULES, lazy).isNull().alias("kept"))
    assert Counter((r["doc_id"], r["rejected_by"] is None) for r in out.collect()) == Counter((r[0], r[1]) for r in every.collect())
    assert op5_quality.quality_cascade(none).count() == 0


def test_quality_plan_is_native(docs):
    plan = op5_quality.quality_cascade(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_cascade_puts_cheap_strong_rules_first(docs):
    assert op5_quality.plan_order(docs)[0] == "short"


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def pair():
    import tiktoken

    path, pattern = op8_bpe.default_ranks()
    return op8_bpe.coder(path, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=op8_bpe.read_ranks(path), special_tokens={})


def test_bpe_equals_the_library(pair):
    ours, theirs = pair
    rng = random.Random(4)
    parts = ["a", "b", "the", " ", "\n", "é", "ж", "中", "1", "!", "  ", "\x85", "\x1c", "🙂", "ing", "’s", "'s", "\t", "zzzzz", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(600)]
    texts += ["a" * 3000, "ab" * 2000, "é" * 999, "".join(rng.choice("abcdefghij") for _ in range(5000)), " " * 700, ""]
    for t in texts:
        ids = ours.encode(t)
        assert ids == theirs.encode_ordinary(t)
        assert ours.decode(ids) == t.encode()


def test_bpe_joins_are_associative(pair):
    ours, _ = pair
    rng = random.Random(6)
    for _ in range(200):
        data = "".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 30))).encode()
        cut = rng.randint(1, len(data) - 1)
        assert ours.join(ours.tree(data[:cut]), ours.tree(data[cut:])) == ours.merge(data)


def test_bpe_over_rows(extra, none, rows):
    out = op8_bpe.decode(op8_bpe.encode(extra))
    assert out.columns == [*extra.columns, "ids", "decoded"]
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in out.collect()) == Counter((r[0], (r[1] or "").encode()) for r in rows)
    assert op8_bpe.digests(none).count() == 0


# ---------------------------------------------------------------- toxicity


def test_grammar_reads_clauses():
    g = op9_toxicity.Grammar({"idiot": 4.0}, {"kill": 3.0}, [0.0] * 7, 0.0)
    assert g.clauses("Nothing here. You are an idiot, really. Fine") == [" you are an idiot, really"]
    assert g.read("you are an idiot")["targeted"] == 4.0
    assert g.read("that idiot")["plain"] == 4.0
    assert g.read("not an idiot")["negated"] == 4.0
    assert g.read("ann said idiot")["reported"] == 4.0
    assert g.read("i will kill")["threat"] == 3.0
    assert g.read('the word "idiot" is')["reported"] == 4.0
    assert g.clauses("notidiot") == []


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    labelled = docs.join(labels.select("doc_id", "toxic"), "doc_id")
    grammar = op9_toxicity.learn(docs, op9_toxicity.teachable(labels))
    out = op9_toxicity.score_toxicity(labelled, grammar).where(op9_toxicity.held_out()).groupBy("toxic", "predicted").count().collect()
    n = Counter({(r["toxic"], r["predicted"]): r["count"] for r in out})
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.9 and n[0, 1] / (n[0, 0] + n[0, 1]) < 0.03, n


def test_toxicity_edge_cases(spark, extra, none):
    labels = spark.createDataFrame([(1, None, 0), (2, 1, 0), (99, 1, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    grammar = op9_toxicity.learn(extra, labels)
    out = op9_toxicity.score_toxicity(extra, grammar)
    assert out.columns == [c for c in extra.columns if c != "score"] + ["score", "predicted"]
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert op9_toxicity.score_toxicity(none, grammar).count() == 0
    empty = op9_toxicity.learn(none, labels.limit(0))
    assert empty.score(None) == 0.5 and empty.score("x") == 0.5


# ---------------------------------------------------------------- mixing


def highest_quotients(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        best = max((v / (2 * s + 1), -i) for i, (v, s) in enumerate(zip(votes, won)) if v > 0)
        won[-best[1]] += 1
    return won


def test_sainte_lague(spark):
    rng = random.Random(8)
    for trial in range(6):
        votes = [rng.choice([0.0, 1.0, rng.random() * 100, 10.0]) for _ in range(rng.randint(1, 9))]
        if not any(votes):
            continue
        seats = rng.randint(0, 40)
        df = spark.createDataFrame([(i, v, seats) for i, v in enumerate(votes)], "party int, v double, seats long")
        got = {r["party"]: r["won"] for r in op10_mixing.sainte_lague(df, "v", "seats", [], ["party"], "won").collect()}
        assert [got[i] for i in range(len(votes))] == highest_quotients(votes, seats), (votes, seats)


def water_level(sizes, weights, budget, cap):
    target, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = budget * sum(sizes)
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] >= cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = share[i]
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
            open_.remove(i)
    return target


def test_targets(spark):
    rng = random.Random(9)
    for _ in range(5):
        sizes = [rng.choice([0, 1, 50, 1000, 3000]) for _ in range(rng.randint(1, 8))]
        df = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
        got = [r["target"] for r in op10_mixing.source_targets(df).orderBy("source_no").collect()]
        want = water_level(sizes, [op10_mixing.WEIGHTS[i % 3] for i in range(len(sizes))], 1.5, 2.0)
        assert got == pytest.approx(want), sizes


def test_mix(docs, rows, extra, none):
    out = op10_mixing.mix_sources(docs, block=2, shard_docs=2).collect()
    assert len(out) == len(rows)
    taken, target = Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 2 * 2 * 6 + 2, (s, taken[s], target[s])
    again = op10_mixing.mix_sources(extra.repartition(5), block=2, shard_docs=2).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in out) == Counter((r["doc_id"], r["taken"]) for r in again)
    assert op10_mixing.mix_sources(none).count() == 0
    mixed = op10_mixing.apply_mix(extra)
    assert mixed.columns == extra.columns and mixed.where("text is null").count() == 0
