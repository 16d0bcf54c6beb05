"""Session settings and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_folders: dict[str, str] = {}
#: Where this thread's tables go, if not straight to the shared folder.
_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def build_session(app: str = "meterlens", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC timestamps, ANSI mode and adaptive execution with skew handling."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # An exact quantile holds a group's values: let a task keep few groups at a time.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "16")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the cluster names it.

    Only a local session without the setting gets a temporary folder: there, driver and
    executors are one machine. A cluster without it is an error, since a machine-local
    folder would be lost with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="meterlens-")
    return _local_folders[context.applicationId]


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Tables settled inside, by this thread, go to a folder of their own; ``discard`` deletes it when it is done with."""
    folder = f"{checkpoint_root(spark).rstrip('/')}/meterlens-run-{uuid.uuid4().hex}"
    token = _folder.set(folder)
    try:
        yield folder
    finally:
        _folder.reset(token)


def discard(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A run folder that is deleted at the end.

    What is to be kept has to be written elsewhere before: results read the settled tables.
    """
    with run_folder(spark) as folder:
        try:
            yield folder
        finally:
            discard(spark, folder)


def settle(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage durably (an executor lost later costs nothing that was written) and
    gives Catalyst the true size of the table, so that a later join broadcasts it only when
    it is under ``spark.sql.autoBroadcastJoinThreshold`` and sorts and merges otherwise.
    """
    spark = df.sparkSession
    root = _folder.get() or checkpoint_root(spark).rstrip("/")
    path = f"{root}/meterlens-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    # What the write shuffled is of no use once the table stands, so its files need not wait for
    # the driver's garbage collection.
    before = spark.conf.get(CLEANUP_KEY, "false")
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP_KEY, before)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
