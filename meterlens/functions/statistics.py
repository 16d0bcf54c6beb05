"""Named statistics, and the small description of a statistic that aggregates share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statistics that are quantiles: exact ones need more than one aggregate for very large
# groups, so they are computed by meterlens.operators.quantiles and not listed below.
QUANTILES = {"median": 0.5, "quantile_25": 0.25, "quantile_75": 0.75}

SAMPLE_STATISTICS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "count": F.count,
}


def _variation(value: Column) -> Column:
    """Population std over mean; 0 when the mean is 0, NULL for a series with no values."""
    mean = F.avg(value)
    return F.when(mean == 0, F.lit(0.0)).otherwise(F.try_divide(F.stddev_pop(value), mean))


PROFILE_STATISTICS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "std": F.stddev_pop,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "range": lambda value: F.max(value) - F.min(value),
    "cv": _variation,
}


@dataclass(frozen=True)
class ProfileSpec:
    """One profile feature ``<column>_<statistic>``; ``column`` is None when it is invalid."""

    name: str
    column: str | None
    statistic: str | None


def parse_profile_spec(name: str, allowed: list[str], present: list[str]) -> ProfileSpec:
    """Split at the last underscore and check both halves; an invalid spec yields NULLs."""
    column, _, statistic = name.rpartition("_")
    known = statistic in PROFILE_STATISTICS or statistic == "median"
    if not column or column not in allowed or column not in present or not known:
        return ProfileSpec(name, None, None)
    return ProfileSpec(name, column, statistic)
