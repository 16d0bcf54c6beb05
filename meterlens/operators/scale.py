"""Scaling per group through a parameter table (group, variable, centro, escala)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.params import CLUSTER, KEY
from meterlens.session import settle

STANDARD = "standard_scaler"


def group_column(df: DataFrame) -> str | None:
    """Cluster if there is one, else customer, else the whole table."""
    return next((c for c in (CLUSTER, KEY) if c in df.columns), None)


def fit_scaler(df: DataFrame, columns: Sequence[str], method: str = STANDARD) -> DataFrame:
    """Centre and scale per group and column; NULL counts as 0, a constant column gets scale 1.

    ``standard_scaler`` uses mean and population std; any other method name is min-max.
    """
    columns = [c for c in columns if c in df.columns]
    group = group_column(df)
    keys = [group] if group else []
    facts = []
    for c in columns:
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        centre, spread = (F.avg(x), F.stddev_pop(x)) if method == STANDARD else \
            (F.min(x), F.max(x) - F.min(x))
        facts.append(F.struct(F.lit(c).alias("variable"), centre.alias("centro"),
                              F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias("escala")))
    fitted = df.groupBy(*keys).agg(F.array(*facts).alias("_all"))
    return fitted.select(*keys, F.inline("_all"))


def apply_scaler(df: DataFrame, columns: Sequence[str], scaler: DataFrame) -> DataFrame:
    """Add ``<column>_scaled`` from stored parameters; without parameters the raw value is copied.

    The table is joined without a broadcast hint: per cluster it is tiny and Catalyst sees
    that from its size, per customer it may be large and is merged with skew handling.
    """
    columns = [c for c in columns if c in df.columns]
    group = next((c for c in (CLUSTER, KEY) if c in scaler.columns), None)
    wide = scaler.groupBy(*([group] if group else [])).agg(*[
        F.max(F.when(F.col("variable") == c, F.col(part))).alias(f"_{part}_{c}")
        for c in columns for part in ("centro", "escala")])
    if group:
        joined = df.join(wide, group, "left")
    else:
        row = wide.first().asDict()
        joined = df.withColumns({name: F.lit(value).cast("double") for name, value in row.items()})
    scaled = {}
    for c in columns:
        x, centre, scale = F.col(c).cast("double"), F.col(f"_centro_{c}"), F.col(f"_escala_{c}")
        scaled[f"{c}_scaled"] = F.when(centre.isNull(), x).otherwise(
            (F.coalesce(x, F.lit(0.0)) - centre) / scale)
    return joined.withColumns(scaled).select(*df.columns, *scaled)


def scale_by_group(df: DataFrame, columns: Sequence[str], method: str = STANDARD) -> DataFrame:
    """Fit and apply on the same rows; the parameters are written first, so their size is known."""
    return apply_scaler(df, columns, settle(fit_scaler(df, columns, method)))
