"""Session helpers: shared scratch space, staging tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

# A side is broadcast only while both bounds hold; beyond them the callers shuffle instead.
BROADCAST_MAX_ROWS = 500_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024

# Folders of local sessions that name none, by application.
_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for staged tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session that names none gets a
    temporary folder of its own, since every other executor layout needs a shared one.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach (master is {master})")
    application = spark.sparkContext.applicationId
    if application not in _local_roots:
        _local_roots[application] = tempfile.mkdtemp(prefix="qaloom-")
    return _local_roots[application]


# Folders that this process made in the scratch folder, by application, until they are dropped.
_made: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the scratch folder; what is written there goes with :func:`drop_stages`."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_stages(spark: SparkSession, since: int = 0) -> None:
    """Delete what was staged, from the given place in the list on. Tables that still read it are lost."""
    paths = _made.get(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while len(paths) > since:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def staged_so_far(spark: SparkSession) -> int:
    """A place in the list of staged tables, for :func:`settle`."""
    return len(_made.setdefault(spark.sparkContext.applicationId, []))


def settle(df: DataFrame, label: str, since: int) -> DataFrame:
    """Stage a result and drop what was staged on the way to it, from the given place on."""
    settled = stage(df, label)
    path = _made[df.sparkSession.sparkContext.applicationId].pop()
    drop_stages(df.sparkSession, since)
    _made[df.sparkSession.sparkContext.applicationId].append(path)
    return settled


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps dropped, which else stay on disk until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def stages(spark: SparkSession) -> Iterator[None]:
    """Everything that is staged inside goes at the end: compute and write results inside."""
    made = _made.setdefault(spark.sparkContext.applicationId, [])
    since = len(made)
    try:
        yield
    finally:
        drop_stages(spark, since)


@atexit.register
def _drop_all() -> None:
    """At the end of the process, what is left of its sessions' stages."""
    with suppress(Exception):
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None:
            drop_stages(spark)
    for root in _local_roots.values():
        shutil.rmtree(root, ignore_errors=True)


def stage(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the scratch folder and return a scan of it.

    Cuts the lineage with data that outlives any executor, and keeps column pruning and filter pushdown for whatever
    reads it next. A ``path`` of the caller's is kept, and must not exist yet.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(rows: int, size: int) -> bool:
    return rows <= BROADCAST_MAX_ROWS and size <= BROADCAST_MAX_BYTES


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows and serialized bytes of a (staged) table.

    Rows of a staged table are counted from its footers. Only a table within the bound of rows is read for its bytes,
    added up in the tasks that read it; a larger one counts as larger than the bound.
    """
    rows = df.count()
    if rows > BROADCAST_MAX_ROWS:
        return rows, BROADCAST_MAX_BYTES + 1
    width = F.length(F.to_json(F.struct(*df.columns)))
    return rows, df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()["b"]


def is_small(df: DataFrame) -> bool:
    return fits_broadcast(*measure(df))


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Hint a broadcast for a (staged) side that was measured to be small; otherwise leave the join to AQE."""
    return F.broadcast(df) if is_small(df) else df
