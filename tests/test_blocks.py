"""Position blocks, Gram tables and components against windows as a column and plain computations."""

import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from meterlens.operators import blocks, grams, reconstruct
from meterlens.operators.split import split_chronologically
from meterlens.operators.windows import score_windows, training_windows
from tests.conftest import rows

START = datetime(2024, 1, 1)
FEATURES = ["x", "y"]


@pytest.fixture(scope="module")
def placed(spark):
    """Three clusters of customers with series of very different lengths, one value missing."""
    rng = np.random.default_rng(9)
    data = []
    for customer, (cluster, n) in enumerate([(0, 90), (0, 7), (1, 60), (1, 3), (2, 2), (0, 40)]):
        base = np.cumsum(rng.normal(size=(n, 2)), axis=0)
        data += [(f"C{customer}", START + timedelta(hours=i), cluster, float(a), None if (customer, i) == (2, 30) else float(b))
                 for i, (a, b) in enumerate(base)]
    df = spark.createDataFrame(data, "cliente_id string, Fecha timestamp, cluster_id int, x double, y double")
    return split_chronologically(df, unit="day").cache()


def errors_by_column(placed, model, boundary, seq_len):
    found = reconstruct.with_errors(score_windows(placed, FEATURES, seq_len, boundary), model)
    return rows(found.select("cliente_id", "Fecha", "particion_ventana", F.round("error", 9).alias("e")))


@pytest.mark.parametrize("boundary", ["entity", "cluster"])
@pytest.mark.parametrize("block", [4096, 9])
@pytest.mark.parametrize("rank", [0, 3])
def test_blocks_give_the_errors_of_windows(placed, boundary, block, rank):
    seq_len = 5
    training = blocks.training_blocks(placed, FEATURES, seq_len, boundary, block)
    model = grams.fit_components(grams.gram_of_blocks(training, seq_len, 2), rank).cache()
    scored = blocks.score_blocks(placed, FEATURES, seq_len, boundary, block)
    got = blocks.unpacked(reconstruct.block_errors(scored, model, seq_len, 2), "error", "error")
    assert set(placed.columns) <= set(got.columns)
    assert rows(got.select("cliente_id", "Fecha", "particion_ventana", F.round("error", 9).alias("e"))) == errors_by_column(
        placed, model, boundary, seq_len)


@pytest.mark.parametrize("boundary", ["entity", "cluster"])
def test_gram_of_blocks_is_that_of_windows(placed, boundary):
    whole = placed.where("cluster_id != 1")  # no missing value, which a column of windows cannot hold
    of_blocks = grams.gram_of_blocks(blocks.training_blocks(whole, FEATURES, 4, boundary, 7), 4, 2)
    of_windows = grams.gram_of_windows(training_windows(whole, FEATURES, 4, boundary))
    key = ["cluster_id", "particion_ventana", "linea"]
    left = {tuple(r[k] for k in key): r["valores"] for r in of_blocks.collect()}
    right = {tuple(r[k] for k in key): r["valores"] for r in of_windows.collect()}
    assert left.keys() == right.keys() and all(np.allclose(left[k], right[k]) for k in left)


def test_a_window_with_a_missing_value_has_no_error_and_no_part_in_the_model(placed):
    training = blocks.training_blocks(placed, FEATURES, 5)
    table = grams.gram_of_blocks(training, 5, 2)
    n = {(r["cluster_id"], r["particion_ventana"]): r["valores"][0] for r in table.where("linea = 0").collect()}
    windows = training_windows(placed, FEATURES, 5).where(~F.exists("ventana", lambda v: v.isNull()))
    want = {(r[0], r[1]): r["count"] for r in windows.groupBy("cluster_id", "particion_ventana").count().collect()}
    assert {k: round(v) for k, v in n.items()} == want
    model = grams.fit_components(table, 2)
    got = blocks.unpacked(reconstruct.block_errors(blocks.score_blocks(placed, FEATURES, 5), model, 5, 2), "error", "error")
    hours = {r["Fecha"].hour + 24 * (r["Fecha"].day - 1) for r in got.where("cliente_id = 'C2' AND error IS NULL").collect()}
    assert hours == {0, 1, 2, 3, *range(30, 35)}


def test_components_equal_the_librarys_up_to_sign(spark, placed):
    training = training_windows(placed.where("cluster_id = 0"), FEATURES, 6)
    own = training.where("particion_ventana = 'train'").select(array_to_vector("ventana").alias("v"))
    want = PCA(k=4, inputCol="v", outputCol="p").fit(own).pc.toArray().T
    got = np.array(grams.fit_components(grams.gram_of_windows(training), 4).first()["componentes"])
    assert np.allclose(np.abs((got * want).sum(axis=1)), 1.0, atol=1e-9)


def test_losses_of_all_ranks_in_closed_form(placed):
    training = training_windows(placed.where("cluster_id != 1"), FEATURES, 4)
    model = grams.fit_components(grams.gram_of_windows(training), 8, range(9))
    for row in model.collect():
        mean, axes = np.array(row["media"]), np.array([list(c) for c in row["componentes"]]).reshape(-1, 8)
        for split, rank, loss in row["perdidas"]:
            part = np.array([r["ventana"] for r in training.where(
                (F.col("cluster_id") == row["cluster_id"]) & (F.col("particion_ventana") == split)).collect()])
            z, p = part - mean, axes[:rank]
            assert loss == pytest.approx(((z - z @ p.T @ p) ** 2).mean(), abs=1e-9)


def test_values_cross_to_python_once(placed):
    """The task's input is the block, not the windows: values a reading, not values a window."""
    seq_len = 24
    scored = blocks.score_blocks(placed, FEATURES, seq_len)
    held = scored.agg(F.sum(F.size(blocks.VALUES))).first()[0]
    windows = score_windows(placed, FEATURES, seq_len).agg(F.sum(F.coalesce(F.size("ventana"), F.lit(0)))).first()[0]
    assert held == 2 * placed.count() and windows > 10 * held


def test_absent_features_give_no_windows(placed):
    scored = blocks.score_blocks(placed, ["x", "none"], 5)
    table = grams.gram_of_blocks(blocks.training_blocks(placed, ["x", "none"], 5), 5, 2)
    assert table.isEmpty()
    got = blocks.unpacked(reconstruct.block_errors(scored, grams.fit_components(table, 2), 5, 2), "error", "error")
    assert got.count() == placed.count() and got.where("error IS NOT NULL").isEmpty()


def test_parameters_without_effect_are_named(placed):
    table = grams.gram_of_blocks(blocks.training_blocks(placed, FEATURES, 4), 4, 2)
    with pytest.warns(UserWarning, match="learning_rate"):
        _, tried = reconstruct.grid_of_grams(table, {"encoding_dim": [2, 3], "learning_rate": [0.1, 0.2]})
    same = {r["orden"]: r["igual_a"] for r in tried.where("cluster_id = 0").collect()}
    assert same == {0: 0, 1: 0, 2: 2, 3: 2}


def test_rows_without_a_position_are_in_no_block(spark):
    rows_ = [(0, "A", k + 1, float(k), 1.0) for k in range(6)] + [(0, "A", None, 9.0, 9.0)]
    df = spark.createDataFrame(rows_, "cluster_id int, cliente_id string, _pos long, x double, y double")
    made = blocks.position_blocks(df, FEATURES, 3, ["cluster_id", "cliente_id"], "_pos", 4)
    scored = blocks.unpacked(made.withColumn("v", F.transform(blocks.ROWS, lambda r: r["x"])), "v", "error")
    assert rows(scored, "_pos", "error") == [(k + 1, float(k)) for k in range(6)]


@pytest.mark.parametrize("boundary", ["entity", "cluster"])
def test_no_array_of_a_block_is_made_once_an_element(placed, boundary):
    """A function of each element that names an array of the whole block costs the square of the block's rows."""
    plan = blocks.score_blocks(placed, FEATURES, 5, boundary)._jdf.queryExecution().optimizedPlan().toString()
    bodies = []
    for start in (m.end() for m in re.finditer(r"lambdafunction\(", plan)):
        depth, end = 1, start
        while depth:
            depth += {"(": 1, ")": -1}.get(plan[end], 0)
            end += 1
        bodies.append(plan[start:end])
    assert bodies and not [b for b in bodies if "_e#" in b]
