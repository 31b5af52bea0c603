"""Session helpers: a local session for tests/bench and the shared checkpoint dir."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every halflife job assumes.  Timestamps are zone-less (TIMESTAMP_NTZ)
# throughout, so the session zone only matters for display; UTC keeps any
# implicit LTZ conversion a no-op.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "halflife") -> SparkSession:
    """Build (or reuse) a local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "16g")
    )
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint dir, setting one only if unset.

    ``spark.checkpoint.dir`` is shared between driver and executors whatever its
    scheme: on a cluster whose machines mount one folder it is a ``file:`` path,
    and Spark adds that scheme to plain paths by itself.  Without it a cluster
    uses a folder below the warehouse, which is shared as well; a session in one
    process (tests) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        current = sc.getConf().get("spark.checkpoint.dir", None)
        if not current and (sc.master == "local" or sc.master.startswith("local[")):
            current = tempfile.mkdtemp(prefix="halflife-ckpt-", dir=os.environ.get("HALFLIFE_SCRATCH", "/tmp"))
        sc.setCheckpointDir(current or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/halflife-checkpoints")
    return sc.getCheckpointDir()


_STAGED: dict[tuple, str] = {}
_UNKEYED: list[tuple[str, str, str]] = []


# Spark deletes the shuffle files of a query when it is over, instead of when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries inside go as soon as each is over: for writes, whose result needs none."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


# Ordered keys as differences, paths as what they add to the one before, all of it in zstd.
COMPACT = {"compression": "zstd", "parquet.writer.version": "v2"}


def stage(df: DataFrame, name: str = "table", key: tuple | None = None, compact: bool = False, anew: bool = False) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint dir and read it back.

    Cuts lineage like ``checkpoint()`` but columnar: later steps read only the
    columns they need, filters reach the scan, and the written table survives
    executor loss.  Reports branch several times over their input, so reading
    a written table beats re-running the joins that derive it.

    With ``key`` (what the table was derived from), a table already written in
    this application is read again instead of being rebuilt: the hand-over
    table is produced once and read by every report.  ``compact`` tables are written small,
    and the shuffle files behind them go at once.  ``anew``: take the place of a table of that key.
    """
    import uuid

    spark = df.sparkSession
    if key is not None and not anew and (path := staged_path(spark, name, key)):
        return spark.read.parquet(path)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    if compact:
        with shuffles_cleaned(spark):
            df.write.options(**COMPACT).parquet(path)
    else:
        df.write.parquet(path)
    if key is not None:
        remember_staged(spark, name, key, path)
    else:
        _UNKEYED.append((spark.sparkContext.applicationId, name, path))
    return spark.read.parquet(path)


def source_key(spark: SparkSession, *paths: str) -> tuple:
    """What tells one state of input files from another: path, bytes, files, time of change.

    Part of the key of every staged table, so that a table derived from files that
    were replaced since is not read again.
    """
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    out = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        total = fs.getContentSummary(p)
        changed = [fs.getFileStatus(p).getModificationTime()]
        if fs.getFileStatus(p).isDirectory():
            changed += sorted(s.getModificationTime() for s in fs.listStatus(p))[-1:]
        out.append((path, total.getLength(), total.getFileCount(), max(changed)))
    return tuple(out)


def release_staged(spark: SparkSession, name: str | None = None) -> int:
    """Delete the tables this application staged (all, or those called ``name``); returns how many."""
    app, jvm = spark.sparkContext.applicationId, spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    mine = {slot: path for slot, path in _STAGED.items() if slot[0] == app and name in (None, slot[1])}
    loose = [x for x in _UNKEYED if x[0] == app and name in (None, x[1])]
    for path in [*mine.values(), *(x[2] for x in loose)]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    for slot in mine:
        del _STAGED[slot]
    for x in loose:
        _UNKEYED.remove(x)
    return len(mine) + len(loose)


def staged_path(spark: SparkSession, name: str, key: tuple) -> str | None:
    """Path of a table staged in this application under (name, key), if still there."""
    path = _STAGED.get((spark.sparkContext.applicationId, name, key))
    return path if path and _exists(spark, path) else None


def remember_staged(spark: SparkSession, name: str, key: tuple, path: str) -> None:
    _STAGED[(spark.sparkContext.applicationId, name, key)] = path


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)
