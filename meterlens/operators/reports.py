"""Quality reports that a job observes while it does something else: no pass of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.operators.quality import present

FIELDS = ("etapa string, columna string, filas long, nulos long, porcentaje double, completitud double, "
          "media double, desviacion double, minimo double, maximo double")


class ObservedReports:
    """An observer of a plan: every stage's rows pass on as they are and are counted on the way.

    The metrics are those of the first job that runs the stage's rows through, so a stage has to be
    used once and whole. ``table`` waits for the jobs; ask for it when they have run.
    """

    def __init__(self) -> None:
        self.stages: dict[str, tuple[list[T.StructField], Observation]] = {}

    def __call__(self, stage: str, df: DataFrame) -> DataFrame:
        fields = [f for f in df.schema.fields if not f.name.startswith("_")]
        metrics: list[Column] = [F.count(F.lit(1)).alias("n")]
        for i, f in enumerate(fields):
            value = present(df, f.name)
            metrics.append(F.count(value).alias(f"n{i}"))
            if isinstance(f.dataType, T.NumericType):
                number = value.cast("double")
                metrics += [F.avg(number).alias(f"m{i}"), F.stddev_samp(number).alias(f"s{i}"),
                            F.min(number).alias(f"a{i}"), F.max(number).alias(f"b{i}")]
        seen = Observation(f"{stage}")
        self.stages[stage] = fields, seen
        return df.observe(seen, *metrics)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a stage and column: rows, missing values and their share, the stage's completeness, and moments."""
        rows = []
        for stage, (fields, seen) in self.stages.items():
            m = seen.get
            n, filled = m["n"], sum(m[f"n{i}"] for i in range(len(fields)))
            whole = 100.0 * filled / (n * len(fields)) if n and fields else 0.0
            for i, f in enumerate(fields):
                missing = n - m[f"n{i}"]
                rows.append((stage, f.name, n, missing, 100.0 * missing / n if n else 0.0, whole,
                             *(None if m.get(f"{k}{i}") is None else float(m[f"{k}{i}"]) for k in "msab")))
        return spark.createDataFrame(rows, FIELDS)


def observed(observer, stage: str, df: DataFrame) -> DataFrame:
    """What an observer makes of a stage; one that only looks leaves it as it is."""
    made = observer(stage, df) if observer else None
    return df if made is None else made


def stage_order(stages: Sequence[str]) -> Column:
    """Stages in the order in which they were observed."""
    return F.array_position(F.array(*map(F.lit, stages)), F.col("etapa"))
