"""Hand-worked fixture tables (FIXTURES.md §2)."""

import datetime as dt

from pyspark.sql import functions as F

T = dt.datetime

LIFECYCLE_ROWS = [
    ("a.java", "ann", "bob", T(2018, 9, 10, 9), T(2018, 9, 13, 10), 3),
    ("a.java", "ann", "ann", T(2018, 9, 10, 9), T(2018, 9, 18, 9), 8),
    ("a.java", "ann", None, T(2018, 9, 10, 9), None, 23),
    ("a.java", "bob", None, T(2018, 9, 12, 9, 2), None, 21),
    ("a.java", "bob", "bob", T(2018, 9, 12, 9, 2), T(2018, 9, 12, 23), 0),
    ("b.java", "cat", None, T(2018, 9, 17, 8), None, 16),
    ("b.java", "cat", "ann", T(2018, 9, 17, 8), T(2018, 9, 25, 8), 8),
    ("b.py", "cat", None, T(2018, 10, 1, 8, 30), None, 2),
    ("b.py", "ann", "cat", None, T(2018, 10, 2, 8), 0),
    ("b.java", "ann", None, T(2018, 10, 1, 8, 30, 59), None, 2),
]
LIFECYCLE_SCHEMA = (
    "path string, creator string, remover string, created timestamp_ntz, removed timestamp_ntz, lifespan int"
)

FILES_ROWS = [
    ("f1", T(2020, 1, 1, 12), None),
    ("f2", T(2020, 1, 2, 23, 59, 59), None),
    ("r1", T(2020, 1, 1, 12), T(2020, 1, 3, 6)),
]
FILES_SCHEMA = "file_id string, added timestamp_ntz, removed timestamp_ntz"


def lifecycle(spark):
    return spark.createDataFrame(LIFECYCLE_ROWS, LIFECYCLE_SCHEMA)


def files(spark):
    return spark.createDataFrame(FILES_ROWS, FILES_SCHEMA)


def rows(df, ndigits=6):
    out = []
    for r in df.collect():
        out.append(tuple(round(v, ndigits) if isinstance(v, float) else v for v in r))
    return out
