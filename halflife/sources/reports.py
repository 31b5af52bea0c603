"""Report sinks.

Reports are small aggregates, but a single output file must not pull the
report's own computation into one task: ``single_file`` repartitions to one
partition *after* the report is computed (a shuffle of the finished rows) and
sorts within it, instead of ``coalesce(1)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_report(
    df: DataFrame,
    path: str,
    *,
    order_by: Sequence[str] = (),
    single_file: bool = False,
    header: bool = True,
    mode: str = "overwrite",
    fmt: str = "csv",
) -> None:
    """Overwrite, header, optionally one sorted file."""
    out = df
    if single_file:
        out = out.repartition(1)
        if order_by:
            out = out.sortWithinPartitions(*order_by)
    elif order_by:
        out = out.orderBy(*order_by)
    w = out.write.mode(mode)
    if fmt == "csv":
        w.option("header", header).csv(path)
    else:
        w.format(fmt).save(path)


def write_author_roster(roster: DataFrame, path: str, single_file: bool = False) -> None:
    """The alias-map template, identity pairs ``email,email`` without header,
    ready to be edited and read back with ``read_alias_map``."""
    write_report(roster.select("alias_from", "alias_to"), path, order_by=["alias_from"],
                 single_file=single_file, header=False)
