"""One summary for P1-P6: states of lines per day, written with the lifecycle.

The six reports look at a line by its creation day, its removal day, its two persons
and its lifespan only; P1 also needs the distinct creation times of all lines.  One
pass over the lines (grouping sets, partial sums before the shuffle) writes both:

- states: (created, removed, creator, remover, path classes) -> ``n_lines``, greatest
  ``lifespan``, ``lifespan_sum``, ``lifespan_n``; created and removed are days;
- times: distinct creation times.

Summaries of disjoint sets of lines merge by adding states and uniting times, so a
report over any union of parts never reads lines again.  Path patterns (P5) are fixed
when the summary is made: each is a named class, a boolean key of the states.

Lifespans of open lines are measured to the history's last day; parts to be merged must
have been measured to the same day.  Null days, persons and lifespans are kept as such;
an empty table gives an empty summary.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halflife.plans.activity import active_lines, active_people
from halflife.plans.authors import author_change_rates, author_decay
from halflife.plans.cohort import cohort_decay, weekly_decay

CLASS_PREFIX = "like_"
_KEYS = ["created", "removed", "creator", "remover"]
_SUMS = ["n_lines", "lifespan", "lifespan_sum", "lifespan_n"]


@dataclass(frozen=True)
class LineSummary:
    """States and creation times of a set of lines, and the reports that read them."""

    states: DataFrame
    times: DataFrame

    @property
    def classes(self) -> list[str]:
        return [c for c in self.states.columns if c.startswith(CLASS_PREFIX)]

    def cohort_decay(self, corrected: bool = False) -> DataFrame:
        return cohort_decay(self.states, corrected, weight="n_lines", times=self.times)

    def weekly_decay(self, corrected: bool = False) -> DataFrame:
        return weekly_decay(self.states, corrected, weight="n_lines", times=self.times)

    def active_lines(self, corrected: bool = False) -> DataFrame:
        return active_lines(self.states, corrected, weight="n_lines")

    def active_people(self, corrected: bool = False) -> DataFrame:
        return active_people(self.states, corrected)

    def author_decay(self, path_class: str | None = None, exclude: Iterable[str] = (), as_of=None) -> DataFrame:
        """P5 over all lines or those of a path class of the summary."""
        rows = self.states
        if path_class is not None:
            if CLASS_PREFIX + path_class not in self.classes:
                raise ValueError(f"the summary has no path class {path_class!r}, only {self.classes}")
            rows = rows.where(F.col(CLASS_PREFIX + path_class))
        return author_decay(rows, exclude=exclude, as_of=as_of, weight="n_lines")

    def author_change_rates(self, corrected: bool = False) -> DataFrame:
        return author_change_rates(self.states, corrected, weight="n_lines")


def write_summary(lines: DataFrame, path: str, path_classes: Mapping[str, str] | None = None) -> LineSummary:
    """Write the summary of ``lines`` under ``path`` in one pass over them, and read it.

    ``path_classes``: name -> LIKE pattern.  The two tables are the two values of the
    folder key ``kind``.
    """
    classes = {CLASS_PREFIX + name: like for name, like in (path_classes or {}).items()}
    rows = lines.select(
        F.to_date("created").alias("created_day"),
        F.to_date("removed").alias("removed_day"),
        "creator",
        "remover",
        *[F.col("path").like(like).alias(name) for name, like in classes.items()],
        F.col("created").alias("created_time"),
        "lifespan",
    )
    states = ["created_day", "removed_day", "creator", "remover", *classes]
    both = rows.groupingSets([states, ["created_time"]], *states, "created_time").agg(
        F.grouping("created_time").alias("kind"),
        F.count(F.lit(1)).alias("n_lines"),
        F.max("lifespan").alias("longest"),
        F.sum("lifespan").alias("lifespan_sum"),
        F.count("lifespan").alias("lifespan_n"),
    )
    # kind is 1 where the time was grouped away: the states.
    both.withColumn("kind", F.when(F.col("kind") == 1, "states").otherwise("times")).write.partitionBy("kind").mode(
        "overwrite"
    ).parquet(path)
    return read_summary(lines.sparkSession, path, both.schema)


def read_summary(spark: SparkSession, path: str, schema=None) -> LineSummary:
    """The summary written under ``path``; ``schema`` (of its files) is needed only if it may be empty."""
    reader = spark.read if schema is None else spark.read.schema(_with_text_kind(schema))
    both = reader.parquet(path)
    classes = [c for c in both.columns if c.startswith(CLASS_PREFIX)]
    states = both.where(F.col("kind") == "states").select(
        F.col("created_day").alias("created"),
        F.col("removed_day").alias("removed"),
        "creator",
        "remover",
        *classes,
        "n_lines",
        F.col("longest").alias("lifespan"),
        "lifespan_sum",
        "lifespan_n",
    )
    times = both.where((F.col("kind") == "times") & F.col("created_time").isNotNull())
    return LineSummary(states, times.select(F.col("created_time").alias("created")))


def _with_text_kind(schema):
    from pyspark.sql import types as T

    return T.StructType([T.StructField("kind", T.StringType()) if f.name == "kind" else f for f in schema.fields])


def merge_summaries(*parts: LineSummary) -> LineSummary:
    """Summary of the union of disjoint sets of lines (all with the same path classes)."""
    first = parts[0]
    if any(p.classes != first.classes for p in parts):
        raise ValueError("summaries with different path classes do not merge")
    states, times = first.states, first.times
    for part in parts[1:]:
        states, times = states.unionByName(part.states), times.unionByName(part.times)
    summed = {"lifespan": F.max}
    states = states.groupBy(*_KEYS, *first.classes).agg(*[summed.get(c, F.sum)(c).alias(c) for c in _SUMS])
    return LineSummary(states, times.distinct())
