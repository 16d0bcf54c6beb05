"""Exact quantiles: narrowing ends on awkward values and equals ``percentile``."""

import pytest
from pyspark.sql import functions as F

from meterlens.operators import quantiles
from meterlens.operators.quantiles import exact_quantiles

WANTED = {f"q{int(p * 100)}": ("v", p) for p in (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)}
CASES = {
    "two_heavy_ties": [0.0] * 20 + [1.0] * 20,
    "plain": [float(i) for i in range(40)],
    "equal": [3.5] * 30,
    "nan": [float("nan"), 1.0, 2.0] * 9,
    "infinite": [float("inf"), float("-inf"), 1.0, 5.0] * 8,
    "nothing": [None, float("nan"), float("inf")] * 5,
    "adjacent": [1.0, 1.0 + 2**-52] * 11,
    "denormal": [0.0, 5e-324] * 11,
    "far": [-1.7e308, 1.7e308, 0.0, 1e-300] * 6,
    "nulls": [None, 2.0, 4.0, 4.0] * 7,
    "three_ties": [0.0] * 10 + [5.0] * 10 + [5.000001] * 10,
}


def table(spark):
    rows = [(name, v) for name, values in CASES.items() for v in values]
    return spark.createDataFrame(rows, "k string, v double").repartition(3)


@pytest.mark.parametrize("bins", [4096, 3])
def test_narrowed_groups_equal_percentile(spark, bins):
    df = table(spark)
    fine = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    want = df.groupBy("k").agg(*[F.percentile(fine, F.lit(p)).alias(a) for a, (_, p) in WANTED.items()])
    direct = exact_quantiles(df, ["k"], WANTED, direct_rows=1000)
    narrowed = exact_quantiles(df, ["k"], WANTED, direct_rows=2, bins=bins)
    columns = ["k", *WANTED]
    expected = sorted(map(tuple, want.select(*columns).collect()))
    assert sorted(map(tuple, direct.select(*columns).collect())) == expected
    assert sorted(map(tuple, narrowed.select(*columns).collect())) == expected


def test_narrowed_whole_table_equals_percentile(spark):
    df = table(spark).where("k IN ('two_heavy_ties', 'plain', 'nan', 'infinite')")
    direct = exact_quantiles(df, [], WANTED, direct_rows=10_000).first()
    assert exact_quantiles(df, [], WANTED, direct_rows=1).first() == direct


def test_bins_are_not_repeated_by_rank_and_fewer_than_values(spark):
    long = spark.range(1000).select(F.lit("a").alias("k"), F.lit("v").alias("_column"), F.col("id").cast("double").alias("_value"),
                                    F.lit(1000).cast("long").alias("_n"), F.lit(0).cast("long").alias("_below"),
                                    F.lit(0.0).alias("_lo"), F.lit(999.0).alias("_hi"))
    assert long.select(quantiles._bin(4096).alias("b")).distinct().count() == 250
    ranks = F.array(*[F.lit(r).cast("long") for r in (0, 500, 999)])
    made = quantiles._tighten(long, ["k", "_column"], ["k", "_column", "_rank"], ranks, 4096)
    assert sorted(tuple(r) for r in made.select("_rank", "_below", "_lo", "_hi", "_held").collect()) == [
        (0, 0, 0.0, 3.0, 4), (500, 500, 500.0, 503.0, 4), (999, 996, 996.0, 999.0, 4)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Window")  # the ranks come after the running counts
