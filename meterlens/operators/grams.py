"""Mergeable Gram tables: all that component models and their losses need of the training windows.

A window is a vector w. Each task adds up, for every cluster and split it meets, the count n, the sum
s and the Gram matrix G = sum of w w', and gives one row a matrix line; Spark adds the lines. From
that table the mean, the covariance, its components and the squared losses of *every* rank in every
split follow in closed form, so training reads the windows once, whatever the number of clusters
and ranks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.operators.blocks import HEAD, SPLITS, VALUES, block_windows
from meterlens.operators.windows import WINDOW, WINDOW_SPLIT
from meterlens.params import CLUSTER

#: Clusters and splits whose matrices a task keeps before it hands them on, and windows multiplied at a time.
KEPT, TOGETHER = 32, 4096
LINES = f"{CLUSTER} int, {WINDOW_SPLIT} string, linea int, valores array<double>"
MODEL_FIELDS = [
    T.StructField(CLUSTER, T.IntegerType()), T.StructField("rango", T.IntegerType()),
    T.StructField("media", T.ArrayType(T.DoubleType())), T.StructField("componentes", T.ArrayType(T.ArrayType(T.DoubleType())))]
LOSS = T.ArrayType(T.StructType([T.StructField(WINDOW_SPLIT, T.StringType()), T.StructField("rango", T.IntegerType()),
                                 T.StructField("perdida", T.DoubleType())]))


def _added(batches: Iterator[pa.RecordBatch], groups: Callable) -> Iterator[pa.RecordBatch]:
    """Lines of the matrices of one task; ``groups`` yields (cluster, split, windows as rows of a matrix)."""
    kept: dict[tuple, np.ndarray] = {}

    def lines() -> Iterator[pa.RecordBatch]:
        for (cluster, split), table in kept.items():
            n = len(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([cluster] * n, pa.int32()), pa.array([split] * n), pa.array(np.arange(n), pa.int32()),
                 pa.array(list(np.ascontiguousarray(table)), pa.list_(pa.float64()))], names=[CLUSTER, WINDOW_SPLIT, "linea", "valores"])
        kept.clear()

    for batch in batches:
        for cluster, split, windows in groups(batch):
            windows = windows[~np.isnan(windows).any(axis=1)]
            if len(windows):
                # A column of ones in front: line and column 0 hold the count and the sums.
                padded = np.hstack([np.ones((len(windows), 1)), windows])
                key = (int(cluster), split)
                kept[key] = kept.get(key, 0.0) + padded.T @ padded
                if len(kept) > KEPT:
                    yield from lines()
    yield from lines()


def _merged(lines: DataFrame) -> DataFrame:
    total = vector_to_array(Summarizer.sum(array_to_vector("valores")))
    return lines.groupBy(CLUSTER, WINDOW_SPLIT, "linea").agg(total.alias("valores"))


def gram_of_blocks(blocks: DataFrame, seq_len: int, width: int) -> DataFrame:
    """The Gram table (cluster, split, line, values) of the windows of training blocks."""
    def groups(batch: pa.RecordBatch):
        clusters = batch.column(CLUSTER).to_pylist()
        splits_of = batch.column(SPLITS)
        for k, _, windows, ends in block_windows(batch.column(VALUES), batch.column(HEAD), splits_of.value_lengths(), seq_len, width):
            splits = np.array(splits_of[k].as_py(), dtype=object)[ends]
            for split in sorted({s for s in splits if s is not None}):
                own = np.flatnonzero(splits == split)
                for at in range(0, len(own), TOGETHER):
                    yield clusters[k], split, windows[own[at:at + TOGETHER]].reshape(-1, seq_len * width)

    return _merged(blocks.select(CLUSTER, VALUES, HEAD, SPLITS).mapInArrow(lambda b: _added(b, groups), LINES))


def gram_of_windows(windows: DataFrame) -> DataFrame:
    """The same of windows that are a column."""
    def groups(batch: pa.RecordBatch):
        frame = batch.to_pandas()
        for (cluster, split), part in frame.groupby([CLUSTER, WINDOW_SPLIT], sort=True):
            yield cluster, split, np.stack([np.asarray(w, dtype=np.float64) for w in part[WINDOW]])

    usable = windows.where(F.col(WINDOW).isNotNull() & F.col(WINDOW_SPLIT).isNotNull() & F.col(CLUSTER).isNotNull())
    return _merged(usable.select(F.col(CLUSTER).cast("int").alias(CLUSTER), WINDOW_SPLIT, WINDOW).mapInArrow(lambda b: _added(b, groups), LINES))


def _tables(frame: pd.DataFrame) -> dict[str, np.ndarray]:
    """The whole matrix of each split of a cluster."""
    out = {}
    for split, part in frame.sort_values("linea").groupby(WINDOW_SPLIT):
        table = np.stack(part["valores"].to_numpy())
        table[0, 0] = round(table[0, 0])
        out[split] = table
    return out


def scatter(table: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Sum of (w - mean)(w - mean)' over the windows of a split."""
    n, total, gram = table[0, 0], table[0, 1:], table[1:, 1:]
    cross = np.outer(total, mean)
    return gram - cross - cross.T + n * np.outer(mean, mean)


def components_of(table: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading components (rows) of the training windows; the largest loading of each is positive."""
    n, mean = table[0, 0], table[0, 1:] / table[0, 0]
    k = min(rank, mean.size) if n > 1 else 0
    if k <= 0:
        return mean, np.zeros((0, mean.size))
    axes = np.linalg.eigh(scatter(table, mean))[1][:, ::-1][:, :k].T
    sign = np.sign(axes[np.arange(k), np.abs(axes).argmax(axis=1)])
    return mean, axes * np.where(sign == 0, 1.0, sign)[:, None]


def losses_of(table: np.ndarray, mean: np.ndarray, axes: np.ndarray, ranks: Sequence[int]) -> list[float]:
    """Mean squared reconstruction error of a split for each rank: what the first components leave."""
    spread = scatter(table, mean)
    explained = np.concatenate([[0.0], np.cumsum(np.einsum("ij,jk,ik->i", axes, spread, axes))])
    left = np.maximum(np.trace(spread) - explained, 0.0) / (table[0, 0] * mean.size)
    return [float(left[min(max(r, 0), len(axes))]) for r in ranks]


def fit_components(grams: DataFrame, rank: int, ranks: Sequence[int] = ()) -> DataFrame:
    """(cluster, rank, mean, components, losses) for every cluster with training windows, each in a task of its own.

    ``losses`` has the mean squared error of each split and each of ``ranks``. A task reads the
    matrices of one cluster, whose size the window fixes.
    """
    schema = T.StructType([*MODEL_FIELDS, T.StructField("perdidas", LOSS)])
    ranks = list(ranks)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        tables = _tables(frame)
        if "train" not in tables:
            return pd.DataFrame(columns=schema.names)
        mean, axes = components_of(tables["train"], rank)
        losses = [(split, r, loss) for split, table in sorted(tables.items())
                  for r, loss in zip(ranks, losses_of(table, mean, axes, ranks))]
        return pd.DataFrame([(int(frame[CLUSTER].iloc[0]), len(axes), mean.tolist(), axes.tolist(), losses)], columns=schema.names)

    return grams.groupBy(CLUSTER).applyInPandas(fit, schema)


def losses_under(grams: DataFrame, model: DataFrame, ranks: Sequence[int]) -> DataFrame:
    """(cluster, split, rank, loss) of a given model, from the Gram table alone."""
    ranks = list(ranks)

    def losses(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [CLUSTER, WINDOW_SPLIT, "rango", "perdida"]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns)
        mean = np.array(right["media"].iloc[0], dtype=float)
        axes = np.array([list(c) for c in right["componentes"].iloc[0]], dtype=float).reshape(-1, mean.size)
        return pd.DataFrame([(int(left[CLUSTER].iloc[0]), split, r, loss) for split, table in sorted(_tables(left).items())
                             for r, loss in zip(ranks, losses_of(table, mean, axes, ranks))], columns=columns)

    one = model.withColumn(CLUSTER, F.col(CLUSTER).cast("int"))
    return grams.groupBy(CLUSTER).cogroup(one.groupBy(CLUSTER)).applyInPandas(
        losses, f"{CLUSTER} int, {WINDOW_SPLIT} string, rango int, perdida double")
