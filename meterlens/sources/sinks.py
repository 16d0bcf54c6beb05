"""Writing results: CSV with header, Parquet by cluster, and the fitted model."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from meterlens.operators.explore import anomaly_report
from meterlens.params import CLUSTER


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration())


def _moved(spark: SparkSession, source: str, target: str) -> None:
    paths = spark._jvm.org.apache.hadoop.fs.Path
    if not _file_system(spark, source).rename(paths(source), paths(target)):
        raise OSError(f"cannot move {source} to {target}")


def overwrite(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let ``write`` fill a folder beside ``path``, then put it in the place of what is there.

    A write that fails leaves the old table as it is, and a plan may read the table that it
    overwrites. The switch is two renames: a driver that dies between them leaves the old table under
    ``<path>.before``, and ``restored`` (which the next overwrite and ``load_model`` call) puts it back.
    Where the store copies on a rename, so does the switch.
    """
    path = path.rstrip("/")
    staged, before = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.before"
    paths = spark._jvm.org.apache.hadoop.fs.Path
    files = _file_system(spark, path)
    restored(spark, path)
    try:
        write(staged)
        files.delete(paths(before), True)
        if files.exists(paths(path)):
            _moved(spark, path, before)
        _moved(spark, staged, path)
    except BaseException:
        restored(spark, path)
        files.delete(paths(staged), True)
        raise
    files.delete(paths(before), True)


def restored(spark: SparkSession, path: str) -> str:
    """``path``, after what an interrupted overwrite left beside it is put back."""
    path = path.rstrip("/")
    paths = spark._jvm.org.apache.hadoop.fs.Path
    files = _file_system(spark, path)
    if not files.exists(paths(path)) and files.exists(paths(f"{path}.before")):
        _moved(spark, f"{path}.before", path)
    return path


def write_csv(df: DataFrame, path: str) -> None:
    """Header, staged overwrite, time as text to the second. Also writes an empty result with its header."""
    overwrite(df.sparkSession, path, lambda to: df.write.option("header", True).option(
        "timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(to))


def write_by_cluster(df: DataFrame, path: str) -> None:
    """Parquet partitioned by cluster, staged overwrite; a later read of one cluster skips the others."""
    overwrite(df.sparkSession, path, lambda to: df.write.partitionBy(CLUSTER).parquet(to))


def write_report(flagged: DataFrame, path: str) -> None:
    """The anomaly report. No anomalies give a file with a header only, not a stale old one."""
    write_csv(anomaly_report(flagged), path)


@dataclass(frozen=True)
class FittedModel:
    """What detection needs: model, scaler parameters and thresholds, each a small table."""

    model: DataFrame
    scaler: DataFrame
    thresholds: DataFrame


def save_model(fitted: FittedModel, path: str) -> None:
    """All three tables change at once."""
    def write(to: str) -> None:
        for name in ("model", "scaler", "thresholds"):
            getattr(fitted, name).write.parquet(f"{to}/{name}")

    overwrite(fitted.model.sparkSession, path, write)


def load_model(spark: SparkSession, path: str) -> FittedModel | None:
    """The saved tables, or None if one of them cannot be read."""
    path = restored(spark, path)
    try:
        return FittedModel(*[spark.read.parquet(f"{path}/{name}")
                             for name in ("model", "scaler", "thresholds")])
    except AnalysisException:
        return None
