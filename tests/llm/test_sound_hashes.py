"""Words and lines in the alternating pattern that cancels polynomial sums are told apart."""

import numpy as np
import pyarrow as pa

from halflife.llm import op2_lines, op3_lm, op7_near_dups
from halflife.llm import text as T


def alternating(n):
    """0 and 1 by the parity of the ones in a place's binary form, and the other way round."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return bits, [1 - b for b in bits]


def test_long_words_differ():
    one, two = ("".join("ab"[b] for b in bits) for bits in alternating(2048))
    data, offsets = T.flat(pa.array([f"{one} {two}"]))
    starts, ends, _ = T.word_spans(data, offsets)
    h = T.word_hashes(data, starts, ends)
    assert len(set(h.tolist())) == 2


def test_long_lines_differ():
    one, two = (" ".join(("left", "right")[b] for b in bits) for bits in alternating(2048))
    table = pa.table({"doc_id": [1, 2], "text": [one, two]})
    c = op2_lines._Lines(table)
    lines = np.array([0, 1])
    a, b = c.digest(lines, 0), c.digest(lines, 1)
    assert len({*a.tolist(), *b.tolist()}) == 4


def test_line_hash_without_a_word_is_that_of_the_shorter_line():
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(words), *[" ".join(words[:i] + words[i + 1 :]) for i in range(12)]]
    c = op2_lines._Lines(pa.table({"doc_id": list(range(13)), "text": texts}))
    _, place, variants = c.without(np.array([0]))
    assert variants.tolist() == c.digest(np.arange(1, 13), 0)[place].tolist()


def test_operators_tell_them_apart(spark):
    bits = alternating(2048)
    words = ["".join("ab"[b] for b in x) for x in bits]
    lines = [" ".join(("left", "right")[b] for b in x) for x in bits]
    common = " ".join(f"c{i}" for i in range(4))
    rows = [(1, lines[0]), (2, lines[1]), (3, f"{common} {words[0]}"), (4, f"{common} {words[1]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["n_removed"] == 0 for r in op2_lines.repeated_lines(docs).collect())
    groups = {r["doc_id"]: r["component_id"] for r in op7_near_dups.near_duplicates(docs).collect()}
    assert groups[3] == 3 and groups[4] == 4
    probe = next(i for i in range(10, 1000) if op3_is_held_out(i))
    learn = next(i for i in range(10, 1000) if not op3_is_held_out(i))
    scored = op3_lm.score_corpus(spark.createDataFrame([(learn, words[0]), (probe, words[1])], "doc_id long, text string"))
    assert {r["doc_id"]: r["n_known"] for r in scored.collect()}[probe] == 1


def op3_is_held_out(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 7 == 2
