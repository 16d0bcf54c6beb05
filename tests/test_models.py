"""Scaling, segments, reconstruction, severity and evaluation."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlens.operators import evaluate, reconstruct, scale, segment
from meterlens.operators.impute import fill_profile
from meterlens.operators.profile import build_profile
from meterlens.operators.severity import score_statistics, severity
from meterlens.params import METRIC_COLUMNS, Acceptance, Bands
from meterlens.sources.sinks import FittedModel, load_model, save_model
from tests.conftest import rows

START = datetime(2024, 1, 1)


# --- scaling ------------------------------------------------------------------------------

def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([("a", 7.0), ("a", 7.0), ("b", 1.0), ("b", 3.0)], "cliente_id string, x double")
    for method in ("standard_scaler", "otro"):
        found = dict.fromkeys([])
        for r in scale.scale_by_group(df, ["x"], method).collect():
            found.setdefault(r["cliente_id"], []).append(r["x_scaled"])
        assert found["a"] == [0.0, 0.0]
        assert sorted(found["b"]) == ([-1.0, 1.0] if method == "standard_scaler" else [0.0, 1.0])


def test_group_precedence(spark):
    df = spark.createDataFrame([(0, "a", 1.0)], "cluster_id int, cliente_id string, x double")
    assert scale.group_column(df) == "cluster_id"
    assert scale.group_column(df.drop("cluster_id")) == "cliente_id"
    assert scale.group_column(df.select("x")) is None


def test_raw_value_without_parameters(spark):
    df = spark.createDataFrame([(0, 2.0), (5, 2.0), (5, None)], "cluster_id int, x double")
    fitted = scale.fit_scaler(df.where("cluster_id = 0"), ["x"])
    assert rows(scale.apply_scaler(df, ["x"], fitted), "cluster_id", "x_scaled") == [(0, 0.0), (5, 2.0), (5, None)]


# --- profile and segments -----------------------------------------------------------------

def test_profile_edge_cases(spark):
    df = spark.createDataFrame(
        [("a", -1.0, None), ("a", 1.0, None), ("b", 4.0, 2.0)], "cliente_id string, Volumen double, Presion double")
    specs = ["Volumen_cv", "Volumen_std", "Presion_mean", "nada_mean", "Volumen_rara", "Volumen"]
    profile = build_profile(df, specs)
    assert rows(profile) == [("a", 0.0, 1.0, None, None, None, None), ("b", 0.0, 0.0, 2.0, None, None, None)]
    assert rows(fill_profile(profile, specs)) == [("a", 0.0, 1.0, 2.0, 0.0, 0.0, 0.0), ("b", 0.0, 0.0, 2.0, 0.0, 0.0, 0.0)]


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][same].sum() / (same.sum() - 1)
        b = min(d[i][labels == other].mean() for other in set(labels) if other != own)
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


@pytest.mark.parametrize("block", [5000, 17])
def test_silhouette_equals_brute_force_in_any_blocks(spark, block):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    labels = np.array([0] * 20 + [1] * 39 + [7])
    df = spark.createDataFrame([(v.tolist(), int(l)) for v, l in zip(x, labels)], "v array<double>, l int")
    assert segment.silhouette(df, "v", "l", block).first()[0] == pytest.approx(brute_silhouette(x, labels))


def blobs(spark, per=12):
    rng = np.random.default_rng(2)
    data = []
    for c, centre in enumerate([(0, 0), (20, 0), (0, 20)]):
        data += [(f"c{c}-{i}", *(np.array(centre) + rng.normal(size=2)).tolist()) for i in range(per)]
    return spark.createDataFrame(data, "cliente_id string, x double, y double")


def test_segments_found_and_numbered_by_centre(spark):
    found = segment.fit_clusters(blobs(spark), ["x", "y"], 3).collect()
    ids = {r["cliente_id"][:2]: r["cluster_id"] for r in found}
    assert {(r["cliente_id"][:2], r["cluster_id"]) for r in found} == set(ids.items())
    assert ids["c1"] == 2  # the largest x sorts last


def test_k_is_chosen_and_clamped(spark):
    data, columns = blobs(spark), ["x", "y"]
    assert segment.resolve_k(data, columns, [2, 3, 6], "silhouette") == 3
    assert segment.resolve_k(data, columns, [2, 3, 4, 6], "elbow") == 4  # the middle candidate
    assert segment.resolve_k(data, columns, [2, 3, 4, 6], "elbow", knee="chord") == 3
    assert segment.resolve_k(data, columns, [2], "silhouette", fixed_k=99) == 36
    assert segment.resolve_k(data, columns, [100], "silhouette") == 2
    assert segment.resolve_k(data.limit(1), columns, [2, 6], "silhouette") == 1
    assert segment.usable_candidates([1, 2, 6, 20], "silhouette", 20) == [2, 6]
    assert segment.usable_candidates([1, 2, 6, 20], "elbow", 20) == [1, 2, 6, 20]
    assert segment.choose_k([(2, 0.6367), (6, 0.6498)], "silhouette") == 6
    assert segment.choose_k([(2, 0.5), (6, 0.5)], "silhouette") == 2


def test_within_squares_do_not_grow_with_k(spark):
    scores = segment.score_candidates(blobs(spark), ["x", "y"], [1, 2, 3, 6], "elbow")
    values = [w for _, w in scores]
    assert all(a >= b - 1e-9 for a, b in zip(values, values[1:]))


def test_fallbacks_to_one_cluster(spark):
    assert {r["cluster_id"] for r in segment.fit_clusters(blobs(spark), ["x", "y"], 0).collect()} == {0}


def test_plane_has_positive_main_loading_and_full_variance(spark):
    data = blobs(spark)
    plane = segment.project_plane(data, ["x", "y"]).toPandas()
    x = data.toPandas()[["x", "y"]]
    assert plane[["PC1", "PC2"]].var().sum() == pytest.approx(x.var().sum())
    assert plane["PC1"].var() >= plane["PC2"].var()


# --- reconstruction -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def windows(spark):
    rng = np.random.default_rng(4)
    data = []
    for cluster, n in ((0, 80), (1, 60), (2, 1)):
        base = rng.normal(size=(n, 3)) @ rng.normal(size=(3, 12)) + 0.1 * rng.normal(size=(n, 12)) + cluster
        data += [(cluster, "val" if cluster < 2 and i % 5 == 0 else "train", w.tolist()) for i, w in enumerate(base)]
    return spark.createDataFrame(data, "cluster_id int, particion_ventana string, ventana array<double>").cache()


def errors_of(df):
    return np.array([r["error"] for r in df.orderBy("cluster_id", "ventana").collect()], dtype=float)


def test_rank_zero_is_the_mean(windows):
    model = reconstruct.mean_model(windows)
    frame = windows.toPandas()
    got = {r["cluster_id"]: r["media"] for r in model.collect()}
    for c, part in frame[frame["particion_ventana"] == "train"].groupby("cluster_id"):
        assert np.allclose(got[c], np.stack(part["ventana"]).mean(axis=0))


def test_components_equal_numpy_and_error_falls_to_zero(windows):
    frame = windows.toPandas()
    for rank in (3, 12):
        scored = reconstruct.with_errors(windows, reconstruct.component_model(windows, rank))
        got = scored.where("cluster_id = 0").orderBy("ventana").toPandas()
        x = np.stack(got["ventana"])
        own = frame[(frame["cluster_id"] == 0) & (frame["particion_ventana"] == "train")]
        train = np.stack(own["ventana"])
        mean = train.mean(axis=0)
        p = np.linalg.svd(train - mean, full_matrices=False)[2][:rank]
        want = np.abs((x - mean) - (x - mean) @ p.T @ p).mean(axis=1)
        assert np.allclose(got["error"], want)
    assert got["error"].max() < 1e-9


def test_single_window_cluster_keeps_rank_zero(windows):
    model = {r["cluster_id"]: r["rango"] for r in reconstruct.component_model(windows, 4).collect()}
    assert model == {0: 4, 1: 4, 2: 0}


def test_external_model_equals_rank_zero(spark, windows):
    one = windows.where("cluster_id = 0")
    model = reconstruct.mean_model(one)
    mean = np.array(model.first()["media"], dtype=np.float32)

    def make_predict_fn():
        return lambda batch: np.tile(mean, (len(batch), 1))

    got = errors_of(reconstruct.with_external_errors(one, make_predict_fn, 4, 3))
    assert np.allclose(got, errors_of(reconstruct.with_errors(one, model)), atol=1e-5)


def test_grid_picks_first_best_and_loss_falls_with_rank(windows):
    grid = {"encoding_dim": [2, "x", 8, 8, 0], "learning_rate": [0.1], "epochs": [1], "batch_size": [1]}
    model, tried = reconstruct.search_grid(windows, grid)
    table = {(r["cluster_id"], r["orden"]): r for r in tried.collect()}
    assert table[(0, 0)]["perdida"] > table[(0, 1)]["perdida"] == table[(0, 2)]["perdida"]
    assert [table[(0, i)]["elegido"] for i in range(3)] == [False, True, False]
    assert {r["cluster_id"]: r["rango"] for r in model.collect()} == {0: 8, 1: 8, 2: 0}


def test_grid_loss_is_the_mean_squared_error(windows):
    model = reconstruct.component_model(windows, 5)
    losses = {(r["cluster_id"], r["particion_ventana"], r["rango"]): r["perdida"]
              for r in reconstruct.rank_losses(windows, model, [0, 2, 5]).collect()}
    arrays = reconstruct._model_arrays(model)
    frame = windows.toPandas()
    for (c, split, rank), loss in losses.items():
        part = frame[(frame["cluster_id"] == c) & (frame["particion_ventana"] == split)]
        mean, p = arrays[c]
        z = np.stack(part["ventana"]) - mean
        assert loss == pytest.approx(((z - z @ p[:rank].T @ p[:rank]) ** 2).mean(), abs=1e-9)


def test_thresholds_and_fallback(spark):
    data = [(0, "val", 1.0), (0, "val", 3.0), (0, "train", 9.0), (1, "train", 2.0), (1, "train", 2.0),
            (2, "val", 5.0), (2, "val", 5.0)]
    df = spark.createDataFrame(data, "cluster_id int, particion_ventana string, error double")
    # Training errors use the floored std for the threshold, validation errors the raw one.
    assert rows(reconstruct.fit_thresholds(df, 2.0)) == [
        (0, 4.0, 2.0, 1.0), (1, 4.0, 2.0, 1.0), (2, 5.0, 5.0, 1.0)]


def test_flag_is_strict_and_needs_a_threshold(spark):
    errors = spark.createDataFrame(
        [("a", 0, 4.0), ("b", 0, 4.1), ("c", 0, None), ("d", 9, 99.0)], "cliente_id string, cluster_id int, error double")
    limits = spark.createDataFrame([(0, 4.0, 2.0, 1.0)], "cluster_id int, umbral double, media double, desviacion double")
    got = rows(reconstruct.flag(errors, limits, Bands(), "m"), "cliente_id", "anomalia_predicha",
               "score_anomalia_final", "criticidad_predicha")
    assert got == [("a", False, 4.0, "Normal"), ("b", True, 4.1, "Media"), ("c", False, None, "Normal"),
                   ("d", False, None, "Normal")]


def test_model_can_be_saved_and_loaded(spark, windows, tmp_path):
    model = reconstruct.component_model(windows, 2)
    limits = reconstruct.fit_thresholds(reconstruct.with_errors(windows, model), 2.0)
    scaler = scale.fit_scaler(spark.createDataFrame([(0, 1.0)], "cluster_id int, x double"), ["x"])
    save_model(FittedModel(model, scaler, limits), str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert rows(again.model) == rows(model)
    assert np.allclose([list(r)[1:] for r in again.thresholds.orderBy("cluster_id").collect()],
                       [list(r)[1:] for r in limits.orderBy("cluster_id").collect()])
    assert load_model(spark, str(tmp_path / "none")) is None


# --- severity -----------------------------------------------------------------------------

def grade(spark, score, mean, std, bands=Bands()):
    row = spark.createDataFrame([(score, mean, std)], "s double, m double, d double")
    return row.select(severity(F.col("s"), F.col("m"), F.col("d"), bands)).first()[0]


@pytest.mark.parametrize("score,mean,std,level", [
    (13.0, 10.0, 1.0, "Alta"), (12.999, 10.0, 1.0, "Media"), (12.0, 10.0, 1.0, "Media"), (11.5, 10.0, 1.0, "Baja"),
    (11.499, 10.0, 1.0, "Muy Baja"), (0.0, 10.0, 1.0, "Muy Baja"), (None, 10.0, 1.0, "Indeterminada"),
    (1.0, None, 1.0, "Indeterminada"), (float("nan"), 10.0, 1.0, "Indeterminada"), (10.1, 10.0, 0.0, "Alta"),
    (10.0, 10.0, 1e-7, "Muy Baja")])
def test_severity_bands(spark, score, mean, std, level):
    assert grade(spark, score, mean, std) == level


def test_gap_between_bands_and_open_ends(spark):
    assert grade(spark, 12.7, 10.0, 1.0, Bands(media_max=2.5)) == "Muy Baja"
    assert grade(spark, 12.7, 10.0, 1.0, Bands(media_max=None)) == "Media"


def test_score_statistics_floor(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, float("nan")), (3, 1.0), (3, 3.0)], "g int, s double")
    assert rows(score_statistics(df, "s", ["g"])) == [(1, 5.0, 1.0), (2, 0.0, 1.0), (3, 2.0, 1.0)]
    assert rows(score_statistics(df.limit(0), "s")) == [(0.0, 1.0)]


# --- evaluation ---------------------------------------------------------------------------

def test_published_metrics_row(spark):
    counts = spark.createDataFrame(
        [(855610, 11496, 844114, 29664, 8256, 21408, 822706, 3240, 1.0)],
        "total_muestras long, positivos_reales long, negativos_reales long, positivos_predichos long, "
        "verdaderos_positivos_tp long, falsos_positivos_fp long, verdaderos_negativos_tn long, "
        "falsos_negativos_fn long, precision_clasificacion_criticidad double")
    metrics = evaluate.derived_metrics(counts)
    row = metrics.first()
    assert metrics.columns == list(METRIC_COLUMNS)
    assert row["precision_anomalia"] == pytest.approx(0.2783171521035599)
    assert row["recall_anomalia_sensibilidad"] == pytest.approx(0.7181628392484343)
    assert row["f1_score_anomalia"] == pytest.approx(0.4011661807580175)
    assert row["tasa_falsos_positivos"] == pytest.approx(0.025361503304056086)
    assert row["accuracy_general"] == pytest.approx(0.9711924825563049)
    assert [r["cumple"] for r in evaluate.acceptance(metrics, Acceptance()).collect()] == [True, False, True]
    report = {r["id"]: r["cumple"] for r in evaluate.compliance(metrics, Acceptance(), 573.3).collect()}
    assert report == {"N2": "No", "N3": "Sí", "D1": "Sí", "D2": "No", "D3": "Sí"}
    assert {r["id"]: r["cumple"] for r in evaluate.compliance(metrics, Acceptance(), None).collect()}["D3"] == "N/A"


def hours(*items):
    return [(name, START + timedelta(hours=h), *rest) for name, h, *rest in items]


def test_label_fan_out_and_dedupe(spark):
    scored = spark.createDataFrame(
        hours(("a", 0, True, "Alta"), ("a", 1, False, "Normal")),
        "cliente_id string, Fecha timestamp, anomalia_predicha boolean, criticidad_predicha string")
    labels = spark.createDataFrame(
        hours(("a", 0, True, "Media"), ("a", 0, True, "Alta"), ("z", 9, True, "Alta")),
        "cliente_id string, Fecha timestamp, anomalia_real boolean, criticidad_real string")
    row = evaluate.evaluate(scored, labels).first()
    assert (row["total_muestras"], row["verdaderos_positivos_tp"], row["precision_clasificacion_criticidad"]) == (3, 2, 0.5)
    row = evaluate.evaluate(scored, labels, dedupe=True).first()
    assert (row["total_muestras"], row["precision_clasificacion_criticidad"]) == (2, 1.0)
    assert evaluate.unmatched_labels(scored, labels).first()[0] == 1


def test_no_true_positive_and_no_rows(spark):
    scored = spark.createDataFrame(hours(("a", 0, False)), "cliente_id string, Fecha timestamp, anomalia_predicha boolean")
    labels = spark.createDataFrame(hours(("a", 0, True)), "cliente_id string, Fecha timestamp, anomalia_real boolean")
    row = evaluate.evaluate(scored, labels).first()
    assert row["precision_clasificacion_criticidad"] is None and row["recall_anomalia_sensibilidad"] == 0.0
    row = evaluate.evaluate(scored.limit(0), labels).first()
    assert row["total_muestras"] == 0 and row["recall_anomalia_sensibilidad"] is None


def test_a_filter_on_the_cluster_reaches_the_scan(spark, tmp_path):
    """Each covariance job reads the rows of one cluster only."""
    from meterlens.operators.split import split_chronologically
    from meterlens.operators.windows import training_windows
    data = spark.range(200).select(
        (F.col("id") % 2).cast("int").alias("cluster_id"), (F.col("id") % 4).cast("string").alias("cliente_id"),
        (F.lit(START) + F.make_dt_interval(hours=F.col("id"))).alias("Fecha"), F.rand(1).alias("x"))
    split_chronologically(data, unit="day").write.partitionBy("cluster_id").parquet(str(tmp_path / "t"))
    windows = training_windows(spark.read.parquet(str(tmp_path / "t")), ["x"], 24)
    text = windows.where("cluster_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster_id" in text


def test_counted_labels_give_the_totals_of_the_plain_join(spark):
    scored = spark.createDataFrame(
        hours(*[("a", h, h % 3 == 0, "Alta" if h % 2 else "Media") for h in range(30)]),
        "cliente_id string, Fecha timestamp, anomalia_predicha boolean, criticidad_predicha string")
    labels = spark.createDataFrame(
        hours(*[("a", h % 13, h % 2 == 0, "Alta" if h % 5 else "Media") for h in range(200)]),
        "cliente_id string, Fecha timestamp, anomalia_real boolean, criticidad_real string")
    plain = evaluate.derived_metrics(evaluate.confusion(evaluate.join_labels(scored, labels)))
    assert rows(evaluate.evaluate(scored, labels)) == rows(plain)
