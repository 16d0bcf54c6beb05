"""One row of summary features per customer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions.columns import ratio
from meterlens.functions.statistics import PROFILE_STATISTICS, parse_profile_spec
from meterlens.operators.quantiles import DIRECT_ROWS, exact_quantiles
from meterlens.params import BASE_COLUMNS, GAS, KEY


def build_profile(df: DataFrame, specs: Sequence[str],
                  allowed: Sequence[str] = (*BASE_COLUMNS, GAS),
                  direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Aggregate per customer the features named ``<column>_<statistic>``.

    Population std; ``cv`` is 0 when the mean is 0; a customer without values gets NULL, and
    so does everyone for a feature that cannot be parsed.
    """
    parsed = [parse_profile_spec(s, list(allowed), df.columns) for s in specs]
    plain = [
        PROFILE_STATISTICS[p.statistic](F.col(p.column).cast("double")).alias(p.name)
        for p in parsed if p.column and p.statistic != "median"]
    medians = {p.name: (p.column, 0.5) for p in parsed if p.statistic == "median"}
    profile = df.groupBy(KEY).agg(*plain) if plain else df.select(KEY).distinct()
    if medians:
        profile = profile.join(exact_quantiles(df, [KEY], medians, direct_rows), KEY, "left")
    columns = [F.col(p.name).cast("double").alias(p.name) if p.column
               else F.lit(None).cast("double").alias(p.name) for p in parsed]
    return profile.select(KEY, *columns)


def weekend_share(df: DataFrame, value: str = "Volumen") -> DataFrame:
    """Share of a customer's volume used on weekends; 0 when the total is not positive."""
    total = F.sum(value)
    weekend = F.coalesce(F.sum(F.when(F.col("es_findesemana") == 1, F.col(value))), F.lit(0.0))
    share = F.when(total > 0, ratio(weekend, total)).otherwise(F.lit(0.0))
    return df.groupBy(KEY).agg(share.alias("consumo_finde_ratio"))


def standardise_profile(profile: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre and scale every profile column over all customers; a constant column becomes 0."""
    row = profile.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first().asDict()
    out = {}
    for c in columns:
        spread = row[f"s_{c}"]
        out[c] = (F.col(c) - F.lit(row[f"m_{c}"]).cast("double")) / F.lit(spread if spread else 1.0)
    return profile.withColumns(out)
