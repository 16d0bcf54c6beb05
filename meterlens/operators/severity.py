"""Score statistics and severity levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions.columns import finite
from meterlens.params import NORMAL, SEVERITY_ORDER, UNDETERMINED, Bands

# Fixed value: a std below this counts as zero.
STD_FLOOR = 1e-6


def floored_std(std: Column) -> Column:
    return F.when(std < STD_FLOOR, F.lit(1.0)).otherwise(std)


def score_statistics(df: DataFrame, score: str, group: list[str] | None = None) -> DataFrame:
    """Mean and floored population std of the scores that are numbers; (0, 1) without any."""
    x = finite(F.col(score).cast("double"))
    return df.groupBy(*(group or [])).agg(
        F.coalesce(F.avg(x), F.lit(0.0)).alias("media"),
        F.coalesce(floored_std(F.stddev_pop(x)), F.lit(1.0)).alias("desviacion"))


def severity(score: Column, mean: Column, std: Column, bands: Bands) -> Column:
    """Level of a score by its distance from the normal mean in standard deviations.

    Bands include their lower end; a gap between bands falls to the lowest level. Without a
    usable std the highest level needs only a score above the mean.
    """
    z = F.try_divide(score - mean, std)
    media_max = bands.alta_min if bands.media_max is None else bands.media_max
    baja_max = bands.media_min if bands.baja_max is None else bands.baja_max
    missing = score.isNull() | mean.isNull() | std.isNull() | F.isnan(score) | F.isnan(mean) | F.isnan(std)
    return (
        F.when(missing, UNDETERMINED)
        .when((std < STD_FLOOR) & (score > mean + STD_FLOOR), "Alta")
        .when(std < STD_FLOOR, "Muy Baja")
        .when(z >= bands.alta_min, "Alta")
        .when((z >= bands.media_min) & (z < media_max), "Media")
        .when((z >= bands.baja_min) & (z < baja_max), "Baja")
        .otherwise("Muy Baja"))


def row_label(flagged: Column, score: Column, mean: Column, std: Column, bands: Bands) -> Column:
    """Unflagged rows are normal; flagged rows without statistics stay undetermined."""
    return F.when(~flagged, NORMAL).otherwise(severity(score, mean, std, bands))


def severity_rank(column: Column) -> Column:
    """0 for the gravest level."""
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(SEVERITY_ORDER) for x in (s, i)])
    return F.coalesce(F.try_element_at(ranks, column), F.lit(len(SEVERITY_ORDER)))
