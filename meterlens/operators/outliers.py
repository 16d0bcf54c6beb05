"""Capping of outliers per customer, at quartile or median-deviation limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions.columns import capped
from meterlens.operators.chunks import attach_to_chunks, split_into_chunks
from meterlens.operators.quantiles import DIRECT_ROWS, exact_quantiles, median_deviations
from meterlens.params import KEY, TIME, EtlParams

# Method names, and the factor that turns a median deviation into a
# standard deviation for normal data.
IQR = "iqr"
ROBUST = "robust_zscore"
MAD_TO_SIGMA = 0.6745


def _sizes(spans: DataFrame | None, key: str) -> DataFrame | None:
    return None if spans is None else spans.groupBy(key).agg(F.sum("_rows").alias("_rows"))


def outlier_limits(df: DataFrame, columns: Sequence[str], params: EtlParams, key: str = KEY,
                   time: str = TIME, direct_rows: int = DIRECT_ROWS,
                   spans: DataFrame | None = None) -> DataFrame | None:
    """Per customer ``_lo_<c>`` and ``_hi_<c>``; NULL where the spread is 0, None if unknown method."""
    if params.outlier_method == IQR:
        wanted = {}
        for c in columns:
            wanted[f"_q1_{c}"] = (c, 0.25)
            wanted[f"_q3_{c}"] = (c, 0.75)
        found = exact_quantiles(df, [key], wanted, direct_rows, sizes=_sizes(spans, key), derived=True)
        limits = []
        for c in columns:
            q1, q3 = F.col(f"_q1_{c}"), F.col(f"_q3_{c}")
            spread = F.when(q3 - q1 != 0, q3 - q1)
            limits += [(q1 - F.lit(params.iqr_factor) * spread).alias(f"_lo_{c}"),
                       (q3 + F.lit(params.iqr_factor) * spread).alias(f"_hi_{c}")]
        return found.select(key, *limits)
    if params.outlier_method == ROBUST:
        found = median_deviations(df, [key], columns, direct_rows, sizes=_sizes(spans, key))
        limits = []
        for c in columns:
            middle = F.col(f"_med_{c}")
            mad = F.when(F.col(f"_mad_{c}") != 0, F.col(f"_mad_{c}"))
            reach = F.lit(params.zscore_factor) * mad / F.lit(MAD_TO_SIGMA)
            limits += [(middle - reach).alias(f"_lo_{c}"), (middle + reach).alias(f"_hi_{c}")]
        return found.select(key, *limits)
    return None


def cap_outliers(df: DataFrame, columns: Sequence[str], params: EtlParams, key: str = KEY,
                 time: str = TIME, direct_rows: int = DIRECT_ROWS,
                 spans: DataFrame | None = None) -> DataFrame:
    """Clip each column to its customer's limits; an unknown method changes nothing.

    Every row stays: one without a time is clipped like the others, one without a customer has
    no limits and passes unchanged.

    ``spans`` may give (customer, ``_chunk``, ``_rows``) if the caller has counted them already.
    """
    columns = [c for c in columns if c in df.columns]
    limits = outlier_limits(df, columns, params, key, time, direct_rows, spans) if columns else None
    if limits is None:
        return df
    joined = attach_to_chunks(split_into_chunks(df, params.chunk, key, time, keep_all=True), limits, key, spans)
    clipped = joined.withColumns({
        c: capped(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) for c in columns})
    return clipped.select(*df.columns)


def count_outliers(df: DataFrame, columns: Sequence[str], params: EtlParams, key: str = KEY,
                   time: str = TIME, direct_rows: int = DIRECT_ROWS,
                 spans: DataFrame | None = None) -> DataFrame:
    """Values outside the limits per customer and column, as (customer, variable, atipicos)."""
    columns = [c for c in columns if c in df.columns]
    limits = outlier_limits(df, columns, params, key, time, direct_rows, spans)
    if limits is None:
        counts = df.groupBy(key).agg(*[F.lit(0).cast("bigint").alias(c) for c in columns])
    else:
        joined = attach_to_chunks(split_into_chunks(df, params.chunk, key, time, keep_all=True), limits, key, spans)
        counts = joined.groupBy(key).agg(*[
            F.count_if((F.col(c) < F.col(f"_lo_{c}")) | (F.col(c) > F.col(f"_hi_{c}"))).alias(c)
            for c in columns])
    return counts.unpivot([key], list(columns), "variable", "atipicos")
