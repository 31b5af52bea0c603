import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
P13 = " ".join(f"w{i}" for i in range(20))
LONG = " ".join(f"x{i * 7919 % 5003}" for i in range(6000))


def passage(seed: int, n: int = 90) -> str:
    return " ".join(f"p{seed}_{(i * i + seed) % 997}" for i in range(n))


# Nulls in every column, empty and very long texts, ties, repeated rows, copies, shared passages.
ROWS = [
    (1, P13 + " tail one", "en", "a"),
    (2, "head two " + P13, "en", "a"),
    (2, "head two " + P13, "en", "a"),  # the same row again
    (3, None, "en", "b"),
    (4, "", None, None),
    (None, P13 + " of nobody", "en", "b"),
    (5, "   \n\t ", "en", "b"),
    (6, LONG, "de", "c"),
    (7, LONG + " end", "de", "c"),
    (8, "First line of eight words goes right here.\nSecond line of eight words goes right here.\nfirst LINE", "en", None),
    (9, "First line of nine words goes right here now.\nother\nSecond line of eight words went right here.", "en", "é"),
    (10, "the the the the the the the the the the", "en", "é"),
    (11, passage(1) + " middle of eleven " + passage(2), "en", "a"),
    (12, passage(2) + "\n" + passage(1), "en", "a"),
    (13, "ab" * 1500, "fr", "b"),
    (14, "zażółć gęślą jaźń 🙂🙂 ’s 123 4567 --- *** <tag> | & ! 中文文本", "pl", "b"),
    (15, passage(3), "en", "a"),
    (16, passage(3), "en", "a"),
    (17, passage(3).replace("p3_3 ", "changed "), "en", "b"),
    (18, "one two", "en", "b"),
    (19, "ONE two", "en", "b"),
]


@pytest.fixture(scope="session")
def rows():
    return [(*r, None if r[1] is None else len(r[1])) for r in ROWS]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def extra(docs):
    """The same rows with columns whose names clash with those the operators use inside."""
    from pyspark.sql import functions as F

    names = "chunk key blob kept score component_id taken size shard quota th n_words words root bucket rank".split()
    return docs.withColumns({n: F.lit("x") for n in names})
