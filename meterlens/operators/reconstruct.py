"""Linear autoencoder per cluster: fit, reconstruction error, thresholds and flags.

A window of ``seq_len`` rows is one vector. The best linear autoencoder under squared error
is the projection on the leading principal components, so training is one pass that adds up
a Gram table (see ``grams``) and, per cluster, a decomposition whose size is fixed by the window
(240 x 240). Rank 0 reconstructs every window by the mean window. Errors come from windows as a
column (``with_errors``) or, as the plans do it, from blocks of positions (``block_errors``).

A model is a table with one row per cluster: (cluster_id, rango, media, componentes).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.operators.blocks import HEAD, SPLITS, VALUES, block_windows, per_row
from meterlens.operators.grams import MODEL_FIELDS, TOGETHER, fit_components, gram_of_windows, losses_under
from meterlens.operators.severity import floored_std, row_label
from meterlens.operators.windows import WINDOW, WINDOW_SPLIT
from meterlens.params import CLUSTER, Bands
from meterlens.session import settle

ERROR = "error"
MODEL_SCHEMA = T.StructType(MODEL_FIELDS)


def mean_model(windows: DataFrame) -> DataFrame:
    """Rank 0: the mean training window of each cluster, in one map-side aggregate."""
    train = windows.where(F.col(WINDOW_SPLIT) == "train")
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col(WINDOW))))
    return train.groupBy(CLUSTER).agg(mean.alias("media")).select(
        F.col(CLUSTER).cast("int").alias(CLUSTER), F.lit(0).alias("rango"), "media",
        F.array().cast("array<array<double>>").alias("componentes"))


def component_model(windows: DataFrame, rank: int) -> DataFrame:
    """Leading components of the training windows of each cluster, from their Gram table.

    A cluster with a single window keeps rank 0; one without any gets no row.
    """
    return fit_components(gram_of_windows(windows), rank).select(*MODEL_SCHEMA.names)


def _model_arrays(model: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The model on the driver: one small row per cluster."""
    arrays = {}
    for row in model.collect():
        mean = np.array(row["media"], dtype=float)
        components = np.array(row["componentes"], dtype=float).reshape(-1, mean.size)
        arrays[row[CLUSTER]] = (mean, components)
    return arrays


def mean_absolute_difference(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, d: t + d)
    return F.try_divide(total, F.size(a))


def with_errors(windows: DataFrame, model: DataFrame) -> DataFrame:
    """Add ``error``, the mean absolute reconstruction error; NULL without window or model."""
    deepest = model.agg(F.max("rango")).first()[0]
    if not deepest:
        joined = windows.join(model.select(CLUSTER, F.col("media").alias("_mean")), CLUSTER, "left")
        error = mean_absolute_difference(F.col(WINDOW), F.col("_mean"))
        return joined.withColumn(ERROR, error).select(*windows.columns, ERROR)

    shared = windows.sparkSession.sparkContext.broadcast(_model_arrays(model))

    @F.pandas_udf("double")
    def errors(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        arrays = shared.value
        for cluster, window in batches:
            out = np.full(len(cluster), np.nan)
            usable = window.notna().to_numpy()
            for c in cluster[usable].unique():
                if c in arrays:
                    mean, components = arrays[c]
                    at = usable & (cluster == c).to_numpy()
                    centred = np.stack(window[at].to_numpy()) - mean
                    out[at] = np.abs(centred - centred @ components.T @ components).mean(axis=1)
            yield pd.Series(out)

    scored = windows.withColumn(ERROR, errors(F.col(CLUSTER), F.col(WINDOW)))
    return scored.withColumn(ERROR, F.when(~F.isnan(ERROR), F.col(ERROR)))


def with_external_errors(windows: DataFrame, make_predict_fn: Callable, seq_len: int,
                         n_features: int, batch_size: int = 1024) -> DataFrame:
    """Add ``error`` from a caller's model: a function of a (batch, step, feature) array.

    ``make_predict_fn`` is called once per Python worker and returns the reconstruction
    function, so a heavy model is loaded there and not shipped with every batch.
    """
    rebuild = predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
        input_tensor_shapes=[[seq_len, n_features]])
    usable = windows.where(F.col(WINDOW).isNotNull())
    rest = windows.where(F.col(WINDOW).isNull()).withColumn(ERROR, F.lit(None).cast("double"))
    rebuilt = usable.withColumn("_rebuilt", rebuild(F.col(WINDOW).cast("array<float>")))
    error = mean_absolute_difference(F.col(WINDOW), F.col("_rebuilt").cast("array<double>"))
    scored = rebuilt.withColumn(ERROR, error).drop("_rebuilt")
    return scored.unionByName(rest)


def rank_losses(windows: DataFrame, model: DataFrame, ranks: Sequence[int]) -> DataFrame:
    """Mean squared error per cluster, split and rank, in closed form from one pass over the windows.

    Smaller models are prefixes of the largest, so the squared length outside the first r
    components is the total minus the first r squared projections.
    """
    return losses_under(gram_of_windows(windows), model, ranks)


def search_grid(windows: DataFrame, grid: dict[str, Sequence]) -> tuple[DataFrame, DataFrame]:
    """``grid_of_grams`` for windows that are a column."""
    return grid_of_grams(settle(gram_of_windows(windows)), grid)


def grid_of_grams(grams: DataFrame, grid: dict[str, Sequence]) -> tuple[DataFrame, DataFrame]:
    """Try every parameter combination; return (model, grid table).

    The bottleneck size is the rank. Other parameters belong to iterative training and do not
    change a closed-form fit: they are named in a warning, and ``igual_a`` is the first combination
    with the same fit. One that cannot be converted, or has no positive rank, is skipped with a warning. The
    loss is taken on validation windows, else on training windows; the first of equal losses wins.
    """
    names = list(grid)
    without = [n for n in names if n != "encoding_dim" and len(grid[n]) > 1]
    if without:
        warnings.warn(f"these parameters do not change a closed-form fit: {', '.join(without)}", stacklevel=2)
    combos: list[tuple[int, dict[str, str]]] = []
    for values in product(*grid.values()):
        combo = dict(zip(names, values))
        try:
            rank = int(combo["encoding_dim"])
        except (KeyError, TypeError, ValueError):
            rank = 0
        if rank > 0:
            combos.append((rank, {n: str(v) for n, v in combo.items()}))
        else:
            warnings.warn(f"no rank in {combo}; skipped", stacklevel=2)
    spark = grams.sparkSession
    if not combos:
        empty = f"{CLUSTER} int, orden int, rango int, parametros map<string,string>, perdida double, igual_a int, elegido boolean"
        return spark.createDataFrame([], MODEL_SCHEMA), spark.createDataFrame([], empty)
    ranks = [r for r, _ in combos]
    largest = settle(fit_components(grams, max(ranks), sorted(set(ranks))))
    losses = largest.select(CLUSTER, F.inline("perdidas"))
    by_split = losses.groupBy(CLUSTER, "rango").agg(
        F.coalesce(F.max(F.when(F.col(WINDOW_SPLIT) == "val", F.col("perdida"))),
                   F.max(F.when(F.col(WINDOW_SPLIT) == "train", F.col("perdida")))).alias("perdida"))
    table = spark.createDataFrame(
        [(i, r, p, ranks.index(r)) for i, (r, p) in enumerate(combos)],
        "orden int, rango int, parametros map<string,string>, igual_a int")
    tried = by_split.join(table, "rango")
    best = tried.groupBy(CLUSTER).agg(
        F.min_by("orden", F.struct("perdida", "orden")).alias("_best"),
        F.min_by("rango", F.struct("perdida", "orden")).alias("_rank"))
    tried = tried.join(best.drop("_rank"), CLUSTER).select(
        CLUSTER, "orden", "rango", "parametros", "perdida", "igual_a",
        (F.col("orden") == F.col("_best")).alias("elegido"))
    chosen = largest.join(best, CLUSTER)
    kept = F.slice("componentes", F.lit(1), F.least(F.col("_rank"), F.size("componentes")))
    model = chosen.select(CLUSTER, F.size(kept).alias("rango"), "media", kept.alias("componentes"))
    return settle(model), settle(tried)


def block_errors(blocks: DataFrame, model: DataFrame, seq_len: int, width: int, squared: bool = False) -> DataFrame:
    """Blocks with ``error``: for each own row the mean absolute (or squared) error of its window.

    NULL without window or model. Only values cross to Python, each once; the model is one small row a cluster.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(_model_arrays(model))

    @F.arrow_udf("array<double>")
    def errors(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        arrays = shared.value
        for clusters, values, heads, sizes in batches:
            found = []
            of = clusters.to_pylist()
            for k, n, windows, ends in block_windows(values, heads, sizes, seq_len, width):
                if of[k] not in arrays:
                    windows, ends = windows[:0], ends[:0]
                out = np.zeros(len(windows))
                for at in range(0, len(windows), TOGETHER):
                    mean, axes = arrays[of[k]]
                    centred = windows[at:at + TOGETHER].reshape(-1, seq_len * width) - mean
                    rest = centred - centred @ axes.T @ axes
                    out[at:at + TOGETHER] = (rest * rest if squared else np.abs(rest)).mean(axis=1)
                found.append((n, ends, out))
            yield per_row(found)

    return blocks.withColumn(ERROR, errors(F.col(CLUSTER), F.col(VALUES), F.col(HEAD), F.size(SPLITS)))


def external_block_errors(blocks: DataFrame, make_predict_fn: Callable, seq_len: int, width: int,
                          batch_size: int = 1024) -> DataFrame:
    """The same with a caller's model: a function of a (batch, step, feature) array of floats.

    ``make_predict_fn`` is called once per task and returns the reconstruction function.
    """
    @F.arrow_udf("array<double>")
    def errors(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        predict = make_predict_fn()
        for values, heads, sizes in batches:
            found = []
            for _, n, windows, ends in block_windows(values, heads, sizes, seq_len, width):
                out = np.zeros(len(windows))
                for at in range(0, len(windows), batch_size):
                    some = windows[at:at + batch_size]
                    rebuilt = np.asarray(predict(np.ascontiguousarray(some, dtype=np.float32)), dtype=np.float64)
                    out[at:at + batch_size] = np.abs(some.reshape(len(some), -1) - rebuilt.reshape(len(some), -1)).mean(axis=1)
                found.append((n, ends, out))
            yield per_row(found)

    return blocks.withColumn(ERROR, errors(F.col(VALUES), F.col(HEAD), F.size(SPLITS)))


def fit_thresholds(errors: DataFrame, sigma: float) -> DataFrame:
    """(cluster_id, umbral, media, desviacion) from validation errors, else training errors.

    The validation threshold uses the raw std and the training fallback the floored one; the
    statistics for grading always use the floored std.
    """
    def part(split: str, f) -> Column:
        return f(F.when(F.col(WINDOW_SPLIT) == split, F.col(ERROR)))

    facts = errors.groupBy(CLUSTER).agg(
        part("val", F.avg).alias("_mv"), part("val", F.stddev_pop).alias("_sv"),
        part("train", F.avg).alias("_mt"), part("train", F.stddev_pop).alias("_st"))
    s = F.lit(float(sigma))
    return facts.select(
        F.col(CLUSTER).cast("int").alias(CLUSTER),
        F.coalesce(F.col("_mv") + s * F.col("_sv"),
                   F.col("_mt") + s * floored_std(F.col("_st"))).alias("umbral"),
        F.coalesce("_mv", "_mt").alias("media"),
        F.coalesce(floored_std(F.col("_sv")), floored_std(F.col("_st"))).alias("desviacion"))


def flag(errors: DataFrame, thresholds: DataFrame, bands: Bands, label: str) -> DataFrame:
    """Scored rows: flag strictly above the threshold, score, model label and severity.

    Rows of a cluster without a threshold get no flag and no score.
    """
    joined = errors.join(thresholds, CLUSTER, "left")
    flagged = F.coalesce(F.col(ERROR) > F.col("umbral"), F.lit(False))
    kept = [c for c in errors.columns if c not in (ERROR, WINDOW, WINDOW_SPLIT)]
    return joined.select(
        *kept,
        flagged.alias("anomalia_predicha"),
        F.when(F.col("umbral").isNotNull(), F.col(ERROR)).alias("score_anomalia_final"),
        F.lit(label).alias("modelo_deteccion"),
        row_label(flagged, F.col(ERROR), F.col("media"), F.col("desviacion"), bands)
        .alias("criticidad_predicha"))
