"""Filling missing readings per customer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlens.operators.chunks import (
    CHUNK, attach_to_chunks, chunk_index, split_into_chunks, with_rows, within_chunk,
)
from meterlens.params import KEY, TIME

# The method names.
LINEAR = "interpolacion_temporal"
FORWARD = "ffill"
BACKWARD = "bfill"
CUSTOMER_MEAN = "media_cliente"


def fill_gaps(df: DataFrame, columns: Sequence[str], method: str = LINEAR, unit: str = "auto",
              key: str = KEY, time: str = TIME) -> DataFrame:
    """Fill NULLs of ``columns`` per customer; whatever stays missing becomes 0.

    The linear method interpolates by position in the series, not by elapsed time, and gives
    both ends the nearest value. An unknown method fills with 0. Every row stays: methods that go
    by position leave rows without customer or time as they are, the mean those without customer.
    (Rows that come with their chunk have both.)
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    if method == CUSTOMER_MEAN:
        return _fill_with_mean(df, columns, unit, key, time)
    if method not in (LINEAR, FORWARD, BACKWARD):
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})

    numbered = with_rows(split_into_chunks(df, unit, key, time), key, time)
    rows = numbered
    to_here = (Window.unboundedPreceding, Window.currentRow)
    forward = within_chunk(key, time).rowsBetween(*to_here)
    # The next present value is found by walking backwards in time: a frame that reaches
    # forward to the end of the chunk would be re-read for every row.
    backward = within_chunk(key, time, latest_first=True).rowsBetween(*to_here)
    # Value and row number apart: plain numbers are carried in place, a pair would be a new object a row.
    if method in (LINEAR, FORWARD):
        rows = rows.withColumns(_last_known("before", columns, forward))
    if method in (LINEAR, BACKWARD):
        rows = rows.withColumns(_last_known("after", columns, backward))
    rows = rows.join(chunk_index(numbered, columns, key), [key, CHUNK])
    filled = rows.withColumns({c: _filled(c, method) for c in columns}).select(*df.columns)
    if CHUNK in df.columns:
        return filled
    return filled.unionByName(df.where(F.col(key).isNull() | F.col(time).isNull()))


def _last_known(side: str, columns: Sequence[str], frame) -> dict[str, Column]:
    """The last present value of each column in the frame, and the row number it has in its chunk."""
    return {
        **{f"_{side}_{c}": F.last(c, ignorenulls=True).over(frame) for c in columns},
        **{f"_{side}_row_{c}": F.last(F.when(F.col(c).isNotNull(), F.col("_row")), ignorenulls=True).over(frame) for c in columns}}


def _filled(c: str, method: str):
    before = F.coalesce(F.col(f"_before_{c}"), F.col(f"_prev_{c}.value")) \
        if method != BACKWARD else None
    after = F.coalesce(F.col(f"_after_{c}"), F.col(f"_next_{c}.value")) \
        if method != FORWARD else None
    if method == FORWARD:
        return F.coalesce(F.col(c), before, F.lit(0.0))
    if method == BACKWARD:
        return F.coalesce(F.col(c), after, F.lit(0.0))
    offset = F.col("_offset")
    before_at = F.coalesce(F.col(f"_before_row_{c}") + offset, F.col(f"_prev_{c}.row"))
    after_at = F.coalesce(F.col(f"_after_row_{c}") + offset, F.col(f"_next_{c}.row"))
    slope = F.try_divide(after - before, after_at - before_at)
    between = before + slope * (F.col("_row") + offset - before_at)
    return F.coalesce(F.col(c), between, before, after, F.lit(0.0))


def _fill_with_mean(df: DataFrame, columns: list[str], unit: str, key: str, time: str) -> DataFrame:
    """Means are aggregated map-side and joined back, so no task holds a whole customer."""
    chunked = split_into_chunks(df, unit, key, time, keep_all=True)
    means = chunked.groupBy(key).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    joined = attach_to_chunks(chunked, means, key)
    filled = joined.withColumns({
        c: F.when(F.col(key).isNotNull(), F.coalesce(F.col(c), F.col(f"_mean_{c}"), F.lit(0.0))).otherwise(F.col(c))
        for c in columns})
    return filled.select(*df.columns)


def fill_profile(profile: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill profile columns with their mean over customers; a column without values becomes 0."""
    means = profile.agg(*[F.avg(c).alias(c) for c in columns])
    return profile.withColumns({
        c: F.coalesce(F.col(c), means.select(c).scalar(), F.lit(0.0)) for c in columns})
