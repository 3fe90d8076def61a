"""Session settings and the few helpers that need to know about the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"
_CHARSET_CONFS = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")


def build_session(app_name: str = "tallyline", master: str | None = None, **confs: str) -> SparkSession:
    """A session with the settings the jobs are tuned for; ``confs`` override them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **confs,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def charset_support(spark: SparkSession, replace_bad_bytes: bool = True) -> Iterator[None]:
    """Allow every Java charset in ``encode``/``decode`` expressions resolved inside the block.

    Spark reads both settings when the expression is resolved, so they are put
    back on exit and the rest of the session keeps its own behaviour.
    """
    before = {key: spark.conf.get(key, None) for key in _CHARSET_CONFS}
    wanted = ("true", "true" if replace_bad_bytes else "false")
    try:
        for key, value in zip(_CHARSET_CONFS, wanted):
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    On a cluster a session without one is an error. Where driver and executors
    are one process (``local[…]``, as in tests) a temporary folder is made and
    recorded in the session, so later calls agree on it.
    """
    folder = spark.conf.get(_CHECKPOINT_CONF, None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_CHECKPOINT_CONF} to a folder that the driver and all executors reach")
        folder = tempfile.mkdtemp(prefix="tallyline-")
        spark.conf.set(_CHECKPOINT_CONF, folder)
    return folder


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tallyline-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the application's own part of the shared folder."""
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove everything the application has put below the shared folder.

    Frames that read it are gone with it, so this is for the end of an application.
    """
    if spark.conf.get(_CHECKPOINT_CONF, None):
        root = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
        root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where several reports hang off one expensive frame: the lineage is cut
    and the data outlives any executor.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Use all cores for expression-heavy work over a scan with too few splits.

    A large table already has more splits than cores and is returned as it is,
    so no shuffle is added at scale. Call it on a scan or a projection of one:
    the split count comes from planning alone.

    Where a narrow row grows into much work, as a key into a script, splits by
    bytes are too long however many there are. With ``rows`` a task gets about
    so many of them at most, so there are more tasks on more rows, none of them
    longer; the rows are counted, which of a scan reads no data.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        tasks = max(tasks, -(-df.count() // rows))
    if df.rdd.getNumPartitions() >= tasks:
        return df
    return df.repartition(tasks)


def too_few_partitions(spark: SparkSession, tasks: int | None) -> bool:
    """Whether ``tasks``, told from the rows, are more than a grouping's own exchange has."""
    return tasks is not None and tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))


def gather(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Bring rows of equal ``keys`` together in ``tasks`` partitions, for a grouping by them that makes long rows.

    A grouping's own exchange has ``spark.sql.shuffle.partitions`` tasks however
    many rows there are, so its tasks grow with the table. Where those are enough,
    or ``tasks`` is not known, ``df`` is returned as it is and the grouping
    combines rows before its exchange.
    """
    return df.repartition(tasks, *keys) if too_few_partitions(df.sparkSession, tasks) else df
