"""A cube of moments: panels of any selection from sums kept per customer and month.

For every customer and month (and each hour of the day and day of the week in it) the cube holds, per
variable, the count, sum, sum of squares, least and largest value, and for every two variables the sums over
the readings that have both. Sums are of differences from one constant a variable, so that nothing is lost when they are
merged. A selection of days is the months that lie in it whole, read from the cube, and the readings
of the days at its ends, added up on the fly; the two are merged.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.operators.explore import DISPLAY, WHEN, by_dates, by_value
from meterlens.params import CLUSTER, KEY

MONTH, PART, VALUE, ALL = "_mes", "_parte", "_valor", "todo"
PARTS = ("hora_dia", "dia_semana")
#: A variance below this share of the mean square is rounding: the column is constant.
FLAT = 1e-12


@dataclass(frozen=True)
class Cube:
    """Rows (customer, cluster, month, part, value, sums), and the constants that were subtracted."""

    rows: DataFrame
    centres: dict[str, float]

    @property
    def variables(self) -> list[str]:
        return list(self.centres)


def moment_cube(readings: DataFrame, variables: Sequence[str] = DISPLAY, time: str = WHEN) -> Cube:
    """The cube of all readings; a job finds the constants, the rows stay lazy (write them once)."""
    present = [v for v in variables if v in readings.columns]
    means = readings.agg(F.lit(1).alias("_one"), *[F.avg(F.col(v).cast("double")).alias(v) for v in present]).first()
    centres = {v: float(means[v] or 0.0) for v in present}
    return Cube(_sums(readings, centres, time), centres)


def _sums(readings: DataFrame, centres: dict[str, float], time: str) -> DataFrame:
    x = {v: F.col(v).cast("double") - F.lit(c) for v, c in centres.items()}
    facts = []
    for v in centres:
        facts += [F.count(x[v]).alias(f"n_{v}"), F.sum(x[v]).alias(f"s_{v}"), F.sum(x[v] * x[v]).alias(f"q_{v}"),
                  F.min(F.col(v).cast("double")).alias(f"lo_{v}"), F.max(F.col(v).cast("double")).alias(f"hi_{v}")]
    for a, b in combinations(centres, 2):
        left, right = F.when(x[b].isNotNull(), x[a]), F.when(x[a].isNotNull(), x[b])
        facts += [F.count(left).alias(f"n_{a}_{b}"), F.sum(left).alias(f"sl_{a}_{b}"), F.sum(right).alias(f"sr_{a}_{b}"),
                  F.sum(left * left).alias(f"ql_{a}_{b}"), F.sum(right * right).alias(f"qr_{a}_{b}"), F.sum(left * right).alias(f"p_{a}_{b}")]
    whose = [c for c in (KEY, CLUSTER) if c in readings.columns]
    parts = [p for p in PARTS if p in readings.columns]
    # Each reading counts once in all, once for its hour and once for its weekday; tasks add up before anything moves.
    spread = F.array(F.struct(F.lit(ALL).alias("p"), F.lit(None).cast("int").alias("v")),
                     *[F.struct(F.lit(p).alias("p"), F.col(p).cast("int").alias("v")) for p in parts])
    rows = readings.where(F.col(time).isNotNull()).withColumns({MONTH: F.date_trunc("month", time), "_in": spread})
    rows = rows.select(*whose, MONTH, *centres, F.inline("_in").alias(PART, VALUE))
    return rows.groupBy(*whose, MONTH, PART, VALUE).agg(*facts)


def picked_cube(cube: Cube, readings: DataFrame, start: str, end: str, cluster_id: int | None = None, client: str | None = None,
             time: str = WHEN) -> Cube:
    """The sums of one selection: whole months from the cube, the days at the ends from the readings."""
    day = F.date_trunc("day", F.lit(end).cast("timestamp"))
    first = F.date_trunc("day", F.lit(start).cast("timestamp"))
    # A month that ends on the last day is not whole: that day lacks the last fraction of a second.
    whole = (F.col(MONTH) >= first) & (F.add_months(F.col(MONTH).cast("date"), 1).cast("timestamp") <= day)
    at = F.date_trunc("month", F.col(time))
    inside = (at >= first) & (F.add_months(at.cast("date"), 1).cast("timestamp") <= day)
    # Said of the time itself, too, so that the scan reads the ends only.
    ends = (F.col(time) < F.add_months(F.date_trunc("month", first).cast("date"), 1).cast("timestamp")) | (
        F.col(time) >= F.date_trunc("month", day))

    def chosen(df: DataFrame) -> DataFrame:
        return by_value(by_value(df, CLUSTER, cluster_id), KEY, client)

    edges = chosen(by_dates(readings, start, end, time)).where(ends & ~inside)
    return Cube(chosen(cube.rows.where(whole)).unionByName(_sums(edges, cube.centres, time)), cube.centres)


def _total(cube: Cube, name: str) -> Column:
    return F.sum(F.when(F.col(PART) == ALL, F.col(name)))


def _spread(n: Column, total: Column, squares: Column, less: int) -> Column:
    """Standard deviation from sums; exactly 0 where only rounding is left."""
    rest = squares - F.try_divide(total * total, n)
    rest = F.when(rest > F.lit(FLAT) * squares, rest).otherwise(F.when(n > 0, F.lit(0.0)))
    return F.sqrt(F.try_divide(rest, n - less))


def cube_statistics(cube: Cube, variable: str) -> DataFrame:
    """Mean, sample std, least and largest value of the selection."""
    n, s, q = (_total(cube, f"{k}_{variable}") for k in "nsq")
    return cube.rows.agg(
        (F.lit(cube.centres[variable]) + F.try_divide(s, n)).alias("mean"), _spread(n, s, q, 1).alias("std"),
        F.min(F.when(F.col(PART) == ALL, F.col(f"lo_{variable}"))).alias("min"),
        F.max(F.when(F.col(PART) == ALL, F.col(f"hi_{variable}"))).alias("max"))


def cube_band(cube: Cube, variable: str, factor: float = 1.5) -> DataFrame:
    facts = cube_statistics(cube, variable).where(F.col("std") > 0)
    reach = F.lit(float(factor)) * F.col("std")
    return facts.select(F.col("mean").alias("media"), F.col("std").alias("desviacion"),
                        (F.col("mean") - reach).alias("inferior"), (F.col("mean") + reach).alias("superior"))


def cube_pattern(cube: Cube, part: str, variable: str) -> DataFrame:
    """Mean, sample std (0 for a single value) and mean +- std per hour, weekday or month."""
    if part == "mes":
        rows = cube.rows.where(F.col(PART) == ALL).withColumn("mes", F.month(MONTH))
    else:
        rows = cube.rows.where(F.col(PART) == part).withColumn(part, F.col(VALUE)).where(F.col(part).isNotNull())
    n, s, q = (F.sum(f"{k}_{variable}") for k in "nsq")
    out = rows.groupBy(part).agg(
        n.alias("_n"), (F.lit(cube.centres[variable]) + F.try_divide(s, n)).alias("mean"),
        F.coalesce(_spread(n, s, q, 1), F.lit(0.0)).alias("std")).where("_n > 0").drop("_n")
    return out.withColumns({"upper_bound": F.col("mean") + F.col("std"), "lower_bound": F.col("mean") - F.col("std")})


def cube_correlation(cube: Cube) -> DataFrame:
    """Pearson correlation of every pair over the readings where both are present."""
    names = cube.variables
    if len(names) < 2:
        return cube.rows.sparkSession.createDataFrame([], "variable_1 string, variable_2 string, correlacion double")
    cells = []
    for v in names:
        n, s, q = (_total(cube, f"{k}_{v}") for k in "nsq")
        cells.append((v, v, F.try_divide(_spread(n, s, q, 0), _spread(n, s, q, 0))))
    for a, b in combinations(names, 2):
        n, sl, sr, ql, qr, p = (_total(cube, f"{k}_{a}_{b}") for k in ("n", "sl", "sr", "ql", "qr", "p"))
        shared = F.try_divide(p - F.try_divide(sl * sr, n), n)
        value = F.try_divide(shared, _spread(n, sl, ql, 0) * _spread(n, sr, qr, 0))
        cells += [(a, b, value), (b, a, value)]
    listed = F.array(*[F.struct(F.lit(a).alias("variable_1"), F.lit(b).alias("variable_2"), value.alias("correlacion")) for a, b, value in cells])
    return cube.rows.agg(listed.alias("_all")).select(F.inline("_all"))


def cube_customers(cube: Cube) -> DataFrame:
    """Customers of the selection, in order."""
    return cube.rows.where(F.col(KEY).isNotNull()).select(F.col(KEY).alias("valor")).distinct().orderBy("valor")
