"""Exact, linearly interpolated quantiles for groups of any size.

``percentile`` keeps every distinct value of a group in one buffer. That is right for groups
up to ``direct_rows``; larger groups (or a whole table) are narrowed instead: each round
counts values per equal-width bin between the current bounds, which is a map-side aggregate
of fixed size, and keeps only the bins that hold the wanted ranks. Each rank is narrowed on its
own, and a bin never holds both ends of its bounds, so every round shrinks them until one value
or few enough are left, which are ranked exactly. No value is sampled or dropped. NULL, NaN and
infinite values are missing in both ways, which give the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from meterlens.functions.columns import finite
from meterlens.session import settle

DIRECT_ROWS = 200_000
BINS = 4096
WHOLE_TABLE = 10
#: Values that the groups of one task may hold at a time.
BUFFERED = 12_800_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]],
                    direct_rows: int = DIRECT_ROWS, bins: int = BINS,
                    sizes: DataFrame | None = None, derived: bool = False) -> DataFrame:
    """One row per key with a column per entry ``alias -> (column, probability)``.

    Runs one small job to find the largest group. ``sizes`` may give (keys, ``_rows``) from a
    cheaper source; upper bounds do. With ``derived`` the values of large groups are written
    once before they are narrowed, as every round would repeat the work that made them.
    """
    keys = list(keys)
    used = {column for column, _ in wanted.values()}
    df = df.withColumns({c: finite(F.col(c).cast("double")) for c in used})
    if sizes is None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    if keys:
        direct_rows = min(direct_rows, buffered_rows(df.sparkSession, len(used)))
    largest = sizes.agg(F.max("_rows")).first()[0] or 0
    # Without keys there is a single buffer per column, which may be larger.
    if largest <= (direct_rows if keys else WHOLE_TABLE * direct_rows):
        return _direct(df, keys, wanted)
    if not keys:
        return _narrowed(df, keys, wanted, direct_rows, bins)
    hot = settle(sizes.where(F.col("_rows") > direct_rows).select(*keys))
    cold = _direct(df.join(hot, keys, "left_anti"), keys, wanted)
    values = df.select(*keys, *_by_column(wanted)).join(hot, keys, "left_semi")
    found = _narrowed(settle(values) if derived else values, keys, wanted, direct_rows, bins)
    return cold.unionByName(hot.join(found, keys, "left"))


def buffered_rows(spark: SparkSession, columns: int) -> int:
    """Rows a group may have so that the groups a task keeps at a time hold ``BUFFERED`` values.

    The session says how many groups an aggregate of objects keeps before it sorts instead.
    """
    groups = int(spark.conf.get("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "128"))
    return max(1, BUFFERED // (max(1, groups) * max(1, columns)))


def median_deviations(df: DataFrame, keys: Sequence[str], columns: Sequence[str], direct_rows: int = DIRECT_ROWS,
                      bins: int = BINS, sizes: DataFrame | None = None) -> DataFrame:
    """(keys, ``_med_<c>``, ``_mad_<c>``): exact median, and median distance from it, of each column and group.

    Values are shuffled once. A group's sorted values give the median and, folded about it, the
    distances; groups too large for that are written once, and both are narrowed from there by counts
    alone, distances being made where they are counted.
    """
    keys, columns = list(keys), list(columns)
    df = df.select(*keys, *[finite(F.col(c).cast("double")).alias(c) for c in columns])
    if sizes is None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    direct_rows = min(direct_rows, buffered_rows(df.sparkSession, len(columns)))
    largest = sizes.agg(F.max("_rows")).first()[0] or 0
    if largest <= direct_rows:
        return _folded(df, keys, columns)
    hot = settle(sizes.where(F.col("_rows") > direct_rows).select(*keys))
    cold = _folded(df.join(hot, keys, "left_anti"), keys, columns)
    values = settle(df.join(hot, keys, "left_semi"))
    medians = settle(hot.join(_narrowed(values, keys, {f"_med_{c}": (c, 0.5) for c in columns}, direct_rows, bins), keys, "left"))
    apart = values.join(medians, keys).select(*keys, *[F.abs(F.col(c) - F.col(f"_med_{c}")).alias(c) for c in columns])
    spreads = _narrowed(apart, keys, {f"_mad_{c}": (c, 0.5) for c in columns}, direct_rows, bins)
    return cold.unionByName(medians.join(spreads, keys, "left"))


def _folded(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    def middle(values: Column) -> Column:
        place = (F.size(values) - 1) / 2
        left, right = (F.get(values, end(place).cast("int")) for end in (F.floor, F.ceil))
        return F.when(left == right, left).otherwise((F.ceil(place) - place) * left + (place - F.floor(place)) * right)

    rows = df.groupBy(*keys).agg(*[F.sort_array(F.collect_list(c)).alias(f"_all_{c}") for c in columns])
    rows = rows.select(*keys, *[f"_all_{c}" for c in columns], *[middle(F.col(f"_all_{c}")).alias(f"_med_{c}") for c in columns])

    def distances(c: str) -> Column:
        return F.sort_array(F.transform(f"_all_{c}", lambda v: F.abs(v - F.col(f"_med_{c}"))))

    return rows.select(*keys, *[f"_med_{c}" for c in columns], *[middle(distances(c)).alias(f"_mad_{c}") for c in columns])


def _by_column(wanted: dict[str, tuple[str, float]]) -> dict[str, list[float]]:
    columns: dict[str, list[float]] = {}
    for column, probability in wanted.values():
        columns.setdefault(column, [])
        if probability not in columns[column]:
            columns[column].append(probability)
    return columns


def _direct(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    columns = _by_column(wanted)
    arrays = [F.percentile(F.col(c), F.array(*map(F.lit, ps))).alias(f"_q_{c}")
              for c, ps in columns.items()]
    picked = [F.col(f"_q_{c}")[columns[c].index(p)].alias(a) for a, (c, p) in wanted.items()]
    return df.groupBy(*keys).agg(*arrays).select(*keys, *picked)


def _narrowed(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]],
              direct_rows: int, bins: int) -> DataFrame:
    columns = _by_column(wanted)
    group = [*keys, "_column"]
    request = [*group, "_rank"]
    long = (
        df.select(*keys, F.inline(F.array(*[
            F.struct(F.lit(c).alias("_column"), F.col(c).alias("_value")) for c in columns])))
        .where(F.col("_value").isNotNull())
    )
    probabilities = F.coalesce(*[
        F.when(F.col("_column") == c, F.array(*[F.lit(float(p)) for p in ps]))
        for c, ps in columns.items()])
    ranks = F.array_distinct(F.flatten(F.transform(
        probabilities, lambda p: F.array(F.floor(_place(p)), F.ceil(_place(p))))))
    span = settle(long.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi"),
    ).withColumn("_below", F.lit(0).cast("long")))
    # The first round bins every value once, whatever the number of ranks.
    bounds = settle(_tighten(_inside(long, span, group), group, request, ranks, bins))

    def too_wide() -> int:
        """Values still held by requests that are not done."""
        wide = (F.col("_held") > direct_rows) & (F.col("_lo") < F.col("_hi"))
        return bounds.agg(F.sum(F.when(wide, F.col("_held") + 1))).first()[0] or 0

    def widest() -> Row:
        return bounds.agg(F.sum(F.col("_hi") / 2 - F.col("_lo") / 2), F.sum("_held")).first()

    open_values, extent = too_wide(), widest()
    while open_values:
        bounds = settle(_tighten(_inside(long, bounds, group), request, request, None, bins))
        before, open_values, extent = extent, too_wide(), widest()
        if open_values and extent == before:
            raise RuntimeError("the bounds of a quantile did not shrink")

    counted = (_inside(long, bounds, group).groupBy(*request, "_n", "_below", "_value")
               .agg(F.count(F.lit(1)).alias("_count")))
    upto = (Window.partitionBy(*request).orderBy("_value")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (
        counted.withColumn("_upto", F.col("_below") + F.sum("_count").over(upto))
        .groupBy(*request, "_n")
        .agg(F.min(F.when(F.col("_upto") > F.col("_rank"), F.col("_value"))).alias("_found")))
    results = []
    for alias, (c, p) in wanted.items():
        place = _place(F.lit(float(p)))

        def at(rank: Column, c=c) -> Column:
            return F.max(F.when((F.col("_column") == c) & (F.col("_rank") == rank), F.col("_found")))

        n = F.max(F.when(F.col("_column") == c, F.col("_n")))
        results += [at(F.floor(place)).alias(f"{alias}_left"), at(F.ceil(place)).alias(f"{alias}_right"),
                    n.alias(f"{alias}_n")]
    wide = placed.groupBy(*keys).agg(*results)
    return wide.select(*keys, *[_between(alias, p).alias(alias) for alias, (_, p) in wanted.items()])


def _place(p: Column, n: str = "_n") -> Column:
    return p * (F.col(n) - 1)


def _between(alias: str, p: float) -> Column:
    """The same sum that ``percentile`` makes of its two neighbours, for equal last digits."""
    place = _place(F.lit(float(p)), f"{alias}_n")
    left, right = F.col(f"{alias}_left"), F.col(f"{alias}_right")
    return F.when((F.floor(place) == F.ceil(place)) | (left == right), left).otherwise(
        (F.ceil(place) - place) * left + (place - F.floor(place)) * right)


def _bin(bins: int) -> Column:
    """Bin number from 0, the largest value always in the last one.

    A group has a bin for every four values at most, and two at least: more would be its values over again.
    Halves are subtracted so that a range near the limits cannot overflow.
    """
    number = F.least(F.lit(bins).cast("long"), F.greatest(F.lit(2).cast("long"), F.floor(F.col("_n") / 4)))
    width = F.col("_hi") / 2 - F.col("_lo") / 2
    share = F.try_divide(F.col("_value") / 2 - F.col("_lo") / 2, width)
    last = number - 1
    return F.when((F.col("_value") == F.col("_hi")) & (F.col("_lo") < F.col("_hi")), last).otherwise(
        F.least(F.floor(F.coalesce(share, F.lit(0.0)) * number), last))


def _inside(long: DataFrame, bounds: DataFrame, group: list[str]) -> DataFrame:
    """Values within their bounds; the bounds are few and Catalyst knows their size."""
    return long.join(bounds, group).where(F.col("_value").between(F.col("_lo"), F.col("_hi")))


def _tighten(values: DataFrame, by: list[str], request: list[str], ranks: Column | None,
             bins: int) -> DataFrame:
    """Bounds of the bin that holds the rank of every request, and the count below it."""
    binned = (
        values.groupBy(*by, "_n", "_below", _bin(bins).alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_count"), F.min("_value").alias("_min"),
             F.max("_value").alias("_max"))
    )
    # Requests of one group share its bins until the bin that holds each is known: bins are not repeated by rank.
    upto = (Window.partitionBy(*by).orderBy("_bin")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = binned.withColumn("_upto", F.col("_below") + F.sum("_count").over(upto))
    before = F.col("_upto") - F.col("_count")
    if ranks is not None:
        ranked = ranked.withColumn("_rank", F.explode(F.filter(ranks, lambda r: (F.col("_upto") > r) & (before <= r))))
    else:
        ranked = ranked.where((F.col("_upto") > F.col("_rank")) & (before <= F.col("_rank")))
    return ranked.select(
        *request, "_n", before.alias("_below"), F.col("_min").alias("_lo"),
        F.col("_max").alias("_hi"), F.col("_count").alias("_held"))
