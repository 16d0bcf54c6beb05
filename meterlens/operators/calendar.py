"""Calendar features of the reading time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meterlens.functions.columns import calendar_parts, cyclic_pairs
from meterlens.params import TIME, EtlParams


def with_calendar(df: DataFrame, params: EtlParams, time: str = TIME) -> DataFrame:
    """Add the nine parts and the enabled sine/cosine pairs."""
    return df.withColumns(calendar_parts(time)).withColumns(cyclic_pairs(params))
