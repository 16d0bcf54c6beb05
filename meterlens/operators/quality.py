"""Data-quality reports: completeness, missing values and descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.functions.columns import finite, ratio
from meterlens.operators.quantiles import DIRECT_ROWS, exact_quantiles


def present(df: DataFrame, column: str) -> Column:
    """The value, NULL where it is missing; NaN and infinities of a number are missing."""
    fractional = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    return finite(F.col(column)) if fractional else F.col(column)


def completeness(df: DataFrame) -> DataFrame:
    """Rows, columns and the share of cells that hold a value, in percent."""
    width = len(df.columns)
    filled = sum((F.count(present(df, c)) for c in df.columns), F.lit(0))
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("filas"), F.lit(width).cast("bigint").alias("columnas"),
        (F.lit(100.0) * ratio(filled.cast("double"), (rows * width).cast("double")))
        .alias("completitud"))


def missing_by_column(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """Missing values per column, as a count and a percentage."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"),
                    *[F.count_if(present(df, c).isNull()).alias(c) for c in df.columns])
    long = counts.unpivot(["_rows"], list(df.columns), "columna", "nulos")
    long = long.select(
        "columna", "nulos",
        (F.lit(100.0) * ratio(F.col("nulos").cast("double"), F.col("_rows").cast("double")))
        .alias("porcentaje"))
    return long.where("nulos > 0") if only_missing else long


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def describe(df: DataFrame, columns: Sequence[str] | None = None,
             direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles and max, one row per numeric column."""
    columns = list(columns or numeric_columns(df))
    data = df.select(*[finite(F.col(c).cast("double")).alias(c) for c in columns])
    moments = data.agg(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.count(c).alias("count"), F.avg(c).alias("mean"),
                 F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
        for c in columns]).alias("_all")).select(F.inline("_all"))
    points = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    wide = exact_quantiles(
        data, [], {f"{n}_{c}": (c, p) for c in columns for n, p in points.items()}, direct_rows)
    quartiles = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), *[F.col(f"{n}_{c}").alias(n) for n in points])
        for c in columns])))
    return moments.join(quartiles, "variable")
