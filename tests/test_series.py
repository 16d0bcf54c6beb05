"""Gaps, positions, splits and windows: edge cases, and chunks against whole series."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterlens.operators.chunks import measured_spans, running_total, split_into_chunks, with_positions
from meterlens.operators.clean import infinities_to_null, keep_first, parse_dates, with_gas_quantity
from meterlens.operators.impute import fill_gaps
from meterlens.operators.outliers import cap_outliers, count_outliers
from meterlens.operators.quantiles import exact_quantiles
from meterlens.operators.split import split_chronologically, split_label
from meterlens.operators.windows import add_windows, score_windows, training_windows
from meterlens.params import EtlParams, GasLaw
from tests.conftest import rows

START = datetime(2024, 1, 1)


def series(spark, values, name="A", step=6):
    return spark.createDataFrame(
        [(name, START + timedelta(hours=step * i), v) for i, v in enumerate(values)],
        "cliente_id string, Fecha timestamp, Volumen double")


def column(df, name="Volumen"):
    return [r[name] for r in df.orderBy("cliente_id", "Fecha").collect()]


@pytest.mark.parametrize("unit", ["day", "month"])
def test_linear_fill_edges_and_gaps(spark, unit):
    df = series(spark, [None, None, 2.0, None, None, None, None, None, 14.0, None])
    assert column(fill_gaps(df, ["Volumen"], unit=unit)) == [2, 2, 2, 4, 6, 8, 10, 12, 14, 14]


@pytest.mark.parametrize("method", ["interpolacion_temporal", "ffill", "bfill", "media_cliente", "otro"])
def test_a_customer_without_values_gets_zero(spark, method):
    assert column(fill_gaps(series(spark, [None] * 6), ["Volumen"], method, "day")) == [0.0] * 6


def test_directional_fills(spark):
    df = series(spark, [None, 1.0, None, None, None, None, 5.0, None])
    assert column(fill_gaps(df, ["Volumen"], "ffill", "day")) == [0, 1, 1, 1, 1, 1, 5, 5]
    assert column(fill_gaps(df, ["Volumen"], "bfill", "day")) == [1, 1, 5, 5, 5, 5, 5, 0]
    assert column(fill_gaps(df, ["Volumen"], "media_cliente", "day")) == [3, 1, 3, 3, 3, 3, 5, 3]


@pytest.mark.parametrize("unit", ["hour", "day", "week", "year"])
def test_fill_equals_pandas_whatever_the_chunk(spark, unit):
    rng = np.random.default_rng(3)
    frames = []
    for name in "ABC":
        values = pd.Series(rng.normal(size=200)).where(rng.random(200) > 0.6)
        frames.append(pd.DataFrame({
            "cliente_id": name, "Fecha": pd.date_range(START, periods=200, freq="h"), "Volumen": values}))
    data = pd.concat(frames, ignore_index=True)
    got = fill_gaps(spark.createDataFrame(data).withColumn("Volumen", F.expr("nanvl(Volumen, NULL)")),
                    ["Volumen"], unit=unit)
    want = data.groupby("cliente_id")["Volumen"].transform(
        lambda s: s.interpolate(method="linear", limit_direction="both"))
    assert np.allclose(column(got), want)


def test_positions_run_through_chunks(spark):
    placed = with_positions(series(spark, [1.0] * 23).union(series(spark, [1.0] * 2, "B")), "day")
    found = rows(placed, "cliente_id", "_pos", "_total")
    assert found == sorted([("A", i + 1, 23) for i in range(23)] + [("B", 1, 2), ("B", 2, 2)], key=repr)


def test_a_dense_meter_gets_shorter_chunks(spark):
    sparse = series(spark, [1.0] * 40, "A", 12)
    dense = spark.range(600).select(
        F.lit("B").alias("cliente_id"), (F.lit(START) + F.make_dt_interval(mins=F.col("id"))).alias("Fecha"),
        F.lit(1.0).alias("Volumen"))
    both = sparse.unionByName(dense)
    assert measured_spans(sparse, "auto")[0] == "year"
    unit, spans = measured_spans(both, "auto", chunk_rows=100)
    assert unit == "hour" and tuple(spans.agg(F.max("_rows"), F.sum("_rows")).first()) == (60, 640)
    placed = with_positions(both, unit).where("cliente_id = 'B'").orderBy("Fecha")
    assert [r["_pos"] for r in placed.collect()] == list(range(1, 601))
    assert split_into_chunks(both, "auto").count() == 640


def test_running_total_over_many_partitions(spark):
    data = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), (F.col("id") % 7).alias("n"))
    got = running_total(data, ["g"], ["o"], F.col("n"), "before").toPandas().sort_values(["g", "o"])
    want = got.groupby("g")["n"].cumsum() - got["n"]
    assert (got["before"] == want).all()


def test_keep_first_by_load_order(spark):
    raw = spark.createDataFrame(
        [("A", START, None, 2), ("A", START, 5.0, 3), ("A", START, 1.0, 1), ("B", START, 9.0, 7)],
        "cliente_id string, Fecha timestamp, Volumen double, seq long")
    by_number = keep_first(raw.withColumn("o", F.col("seq")), "o").drop("o")
    by_columns = keep_first(raw.withColumns({"o1": F.lit("f"), "o2": F.col("seq")}), ["o1", "o2"])
    assert rows(by_number, "cliente_id", "Volumen", "seq") == [("A", 1.0, 1), ("B", 9.0, 7)]
    assert rows(by_columns, "cliente_id", "Volumen", "seq") == [("A", 1.0, 1), ("B", 9.0, 7)]


def test_first_duplicate_stays_even_when_its_value_is_missing(spark):
    raw = spark.createDataFrame(
        [("A", START, None, 1), ("A", START, 5.0, 2)],
        "cliente_id string, Fecha timestamp, Volumen double, o long")
    assert keep_first(raw, "o").first()["Volumen"] is None


def test_bad_dates_are_dropped(spark):
    raw = spark.createDataFrame([("A", "2024-02-30"), ("A", "x"), ("A", None), ("A", "2024-02-29 05:00:00")],
                                "cliente_id string, d string")
    assert rows(parse_dates(raw, "d")) == [("A", datetime(2024, 2, 29, 5))]


def test_gas_quantity_edges(spark):
    data = spark.createDataFrame(
        [(100.0, 26.85, 8.314), (100.0, -273.15, 1.0), (None, 20.0, 1.0), (1.0, math.nan, 1.0), (1.0, math.inf, 1.0)],
        "Presion double, Temperatura double, Volumen double")
    values = [r[0] for r in with_gas_quantity(data, GasLaw()).select("cantidad_gas_calculada").collect()]
    assert values[0] == pytest.approx(100 * 1000 * 8.314 / (8.314 * 300.0))
    assert values[1:] == [None] * 4
    assert with_gas_quantity(data, GasLaw(active=False)).columns == data.columns
    assert with_gas_quantity(data.drop("Volumen"), GasLaw()).select("cantidad_gas_calculada").first()[0] is None


def test_infinities(spark):
    data = spark.createDataFrame([(math.inf,), (-math.inf,), (math.nan,), (None,), (0.0,)], "x double")
    assert [r[0] for r in infinities_to_null(data, ["x"]).collect()] == [None, None, None, None, 0.0]


# --- outliers -----------------------------------------------------------------------------

def test_iqr_and_robust_caps(spark):
    df = series(spark, [1.0, 2.0, 3.0, 4.0, 100.0, None], step=1)
    assert column(cap_outliers(df, ["Volumen"], EtlParams(chunk="day"))) == [1, 2, 3, 4, 7, None]
    robust = column(cap_outliers(df, ["Volumen"], EtlParams(outlier_method="robust_zscore", chunk="day")))
    assert robust[4] == pytest.approx(3 + 3.5 * 1 / 0.6745)
    assert count_outliers(df, ["Volumen"], EtlParams(chunk="day")).first()["atipicos"] == 1


@pytest.mark.parametrize("method", ["iqr", "robust_zscore", "otro"])
def test_no_spread_no_caps(spark, method):
    df = series(spark, [5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 99.0], step=1)
    assert column(cap_outliers(df, ["Volumen"], EtlParams(outlier_method=method, chunk="day")))[-1] == 99.0


def test_hot_groups_are_narrowed_to_the_same_quantiles(spark):
    """One group with a third of all rows, heavy ties, huge outliers: both ways agree."""
    rng = np.random.default_rng(5)
    hot = np.concatenate([np.zeros(3000), rng.normal(size=3000), [1e300, -1e300, 1e-300]])
    cold = [rng.exponential(size=500).round(2) for _ in range(4)]
    data = [("hot", float(v), None if i % 9 == 0 else float(v) * 2) for i, v in enumerate(hot)]
    data += [(f"c{g}", float(v), None) for g, vs in enumerate(cold) for v in vs]
    df = spark.createDataFrame(data, "k string, x double, y double")
    wanted = {"a": ("x", 0.25), "b": ("x", 0.5), "c": ("x", 0.999), "d": ("y", 0.75), "e": ("x", 0.0), "f": ("x", 1.0)}
    plain = rows(exact_quantiles(df, ["k"], wanted))
    narrowed = rows(exact_quantiles(df, ["k"], wanted, direct_rows=700, bins=16))
    assert len(plain) == len(narrowed) == 5
    for p, n in zip(plain, narrowed):
        assert p[0] == n[0]
        assert [v is None for v in p] == [v is None for v in n]
        assert np.allclose([v for v in p[1:] if v is not None], [v for v in n[1:] if v is not None], rtol=1e-12)
    whole = rows(exact_quantiles(df, [], wanted))
    assert np.allclose(whole[0], rows(exact_quantiles(df, [], wanted, direct_rows=10, bins=64))[0], rtol=1e-12)


def test_narrowed_group_without_values_is_kept(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("a", None), ("b", 1.0)], "k string, x double")
    assert rows(exact_quantiles(df, ["k"], {"m": ("x", 0.5)}, direct_rows=2)) == [("a", None), ("b", 1.0)]


# --- split --------------------------------------------------------------------------------

def reference_split(n, test, val):
    if n < 3:
        return ["train"] * n
    n_test = int(n * test)
    n_rest = n - n_test
    n_val = int(n_rest * val)
    n_train = n_rest - n_val
    if n_rest == 0:
        return ["test"] * n
    if n_train <= 0:
        return ["val"] * n_val + ["test" if n_test else None] * (n - n_val)
    return ["train"] * n_train + ["val"] * n_val + ["test"] * n_test


@pytest.mark.parametrize("test,val", [(0.2, 0.15), (0.29, 0.29), (1.0, 0.5), (0.5, 1.0), (0.0, 0.0), (0.0, 1.0)])
def test_split_labels(spark, test, val):
    data = spark.range(1, 41).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(1), F.col("id"))).alias("p"))
    got = data.select("n", "p", split_label(F.col("p"), F.col("n"), test, val).alias("l")).orderBy("n", "p").collect()
    want = [label for n in range(1, 41) for label in reference_split(n, test, val)]
    assert [r["l"] for r in got] == want


def test_split_is_ordered_in_time(spark):
    got = split_chronologically(series(spark, [1.0] * 30), unit="day").orderBy("Fecha").collect()
    assert [r["particion"] for r in got] == reference_split(30, 0.2, 0.15)


# --- windows ------------------------------------------------------------------------------

@pytest.mark.parametrize("n,windows", [(23, 0), (24, 1), (25, 2), (130, 107)])
@pytest.mark.parametrize("block", [24, 31, 4096])
def test_windows_over_block_edges(spark, n, windows, block):
    df = series(spark, [float(i) for i in range(n)], step=1).withColumn("_pos", F.col("Volumen").cast("long") + 1)
    got = add_windows(df, ["Volumen", "Volumen"], 24, ["cliente_id"], block=block).orderBy("Fecha").collect()
    assert len(got) == n
    made = [r for r in got if r["ventana"] is not None]
    assert len(made) == windows
    for r in made:
        last = int(r["Volumen"])
        assert r["ventana"] == [float(v) for v in range(last - 23, last + 1) for _ in range(2)]


def test_missing_feature_gives_no_windows(spark):
    df = series(spark, [1.0] * 30).withColumn("_pos", F.lit(1))
    assert add_windows(df, ["Volumen", "nada"], 24, ["cliente_id"]).where("ventana IS NOT NULL").isEmpty()


def test_windows_stay_in_a_customer_or_run_on(spark):
    df = series(spark, [1.0] * 20, "A", 1).union(series(spark, [2.0] * 20, "B", 1)).withColumn("cluster_id", F.lit(0))
    placed = split_chronologically(df, 0.2, 0.15, "day")
    assert score_windows(placed, ["Volumen"], 24).where("ventana IS NOT NULL").isEmpty()
    across = score_windows(placed, ["Volumen"], 24, "cluster").where("ventana IS NOT NULL")
    found = across.orderBy("Fecha").collect()
    assert [r["cliente_id"] for r in found] == ["B"] * 17
    assert found[0]["ventana"] == [1.0] * 20 + [2.0] * 4
    # 14 training rows each: 28 in a frame of their own, so 5 windows; 4 validation rows, none.
    kept = rows(training_windows(placed, ["Volumen"], 24, "cluster").groupBy("particion_ventana").count())
    assert kept == [("train", 5)]


def test_training_windows_lie_in_one_split(spark):
    df = series(spark, [float(i) for i in range(300)], step=1).withColumn("cluster_id", F.lit(0))
    placed = split_chronologically(df, 0.2, 0.15, "day")
    kept = training_windows(placed, ["Volumen"], 24)
    labels = reference_split(300, 0.2, 0.15)
    for r in kept.collect():
        assert {labels[int(v)] for v in r["ventana"]} == {r["particion_ventana"]}
    assert kept.count() == (labels.count("train") - 23) + (labels.count("val") - 23)


@pytest.mark.parametrize("method", ["interpolacion_temporal", "ffill", "bfill", "media_cliente", "otro"])
def test_filling_keeps_every_row(spark, method):
    rows = [("a", datetime(2024, 1, 1, h), float(h) if h % 3 else None) for h in range(9)]
    rows += [("a", None, None), ("a", None, 5.0), (None, datetime(2024, 1, 1), None), (None, None, 2.0)]
    df = spark.createDataFrame(rows, "cliente_id string, Fecha timestamp, v double")
    got = fill_gaps(df, ["v"], method).collect()
    assert len(got) == len(rows)
    if method not in ("media_cliente", "otro"):
        assert sorted((r for r in got if r["Fecha"] is None), key=repr) == sorted(df.where("Fecha IS NULL").collect(), key=repr)


@pytest.mark.parametrize("method", ["iqr", "robust_zscore", "otro"])
def test_capping_keeps_every_row(spark, method):
    rows = [("a", datetime(2024, 1, 1, h), float(h)) for h in range(20)] + [("a", None, 500.0), (None, None, 900.0), (None, datetime(2024, 1, 1), -9.0)]
    df = spark.createDataFrame(rows, "cliente_id string, Fecha timestamp, v double")
    params = EtlParams(chunk="auto", outlier_method=method)
    got = cap_outliers(df, ["v"], params).collect()
    assert len(got) == len(rows) and {900.0, -9.0} <= {r["v"] for r in got}
    assert (500.0 in {r["v"] for r in got}) == (method == "otro")


def test_gaps_are_carried_as_plain_numbers(spark):
    """A pair of value and row number is a new object for every row and column of the windows."""
    df = spark.createDataFrame([("A", 1.0)], "cliente_id string, v double").withColumn("Fecha", F.lit("2024-01-01").cast("timestamp"))
    plan = fill_gaps(df, ["v"], unit="week")._jdf.queryExecution().optimizedPlan().toString()
    assert "_before_v" in plan and "_after_v" in plan and "named_struct(value, v#" not in plan
