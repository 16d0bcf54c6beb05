"""Windows as strided views: a block of positions is one row of arrays, and windows exist in the task only.

``add_windows`` gives every reading its window as a column, each value ``seq_len`` times. Here a block
of up to ``BLOCK`` positions of a series becomes one row that holds every value once (and the last
``seq_len - 1`` values of the block before it). Python tasks view its windows without copying the
column out, so a reading crosses to Python once, not ``seq_len`` times.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.operators.chunks import POSITION
from meterlens.operators.split import SPLIT
from meterlens.operators.windows import BLOCK, WINDOW_SPLIT, cluster_positions
from meterlens.params import CLUSTER, KEY

#: Columns of a block: values one after the other, rows repeated at its head, window splits and rows of its own.
VALUES, HEAD, SPLITS, ROWS = "_valores", "_cabeza", "_particiones", "_filas"


def position_blocks(df: DataFrame, features: Sequence[str], seq_len: int, keys: Sequence[str],
                    position: str = POSITION, block: int = BLOCK, carry: bool = True) -> DataFrame:
    """One row per block of positions of ``keys``, with its values, window splits and, if ``carry``, its rows.

    Positions count 1, 2, 3, … within ``keys``. A window's split is that of its rows if they all have
    the same (the first and last do: splits follow each other in time), else NULL. Without one of the
    features there are no values, and so no windows; a row without a position is in no block. A block has ``block + seq_len - 1`` rows at most.
    """
    block = max(block, seq_len)
    known = all(f in df.columns for f in features)
    values = F.array(*[F.col(f).cast("double") for f in features]) if known else F.array().cast("array<double>")
    home = F.floor((F.col(position) - 1) / block)
    tail = (F.col(position) - 1) % block >= block - (seq_len - 1)
    spread = df.withColumn("_home", home).withColumn(
        "_block", F.explode(F.when(tail, F.array(home, home + 1)).otherwise(F.array(home)))).where("_block IS NOT NULL")
    own = F.col("_home") == F.col("_block")
    split = F.col(SPLIT) if SPLIT in df.columns else F.lit(None).cast("string")
    # A nested row can only be carried, not compared, so positions, which differ, come first.
    entry = F.struct(F.col(position).alias("p"), own.alias("own"), split.alias("s"), values.alias("x"),
                     *([F.when(own, F.struct(*df.columns)).alias("r")] if carry else []))
    packed = spread.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    splits = F.col("_e.s")
    # The split of the row that a window starts at, beside that of its last row. Arrays of the block are made once:
    # one that a function of each element names is made anew for each.
    starts = F.slice(F.concat(F.array_repeat(F.lit(None).cast("string"), seq_len - 1), splits), F.lit(1), F.size(splits))
    window_splits = F.zip_with(splits, starts, lambda last, first: F.when(first == last, last))

    head = F.size(F.filter("_e", lambda e: ~e["own"]))
    rows = F.size("_e") - head
    out = packed.where(rows > 0).select(
        *keys, F.flatten("_e.x").alias(VALUES), head.alias(HEAD),
        F.slice(window_splits, head + 1, rows).alias(SPLITS),
        *([F.slice(F.col("_e.r"), head + 1, rows).alias(ROWS)] if carry else []))
    return out


def score_blocks(df: DataFrame, features: Sequence[str], seq_len: int, boundary: str = "entity", block: int = BLOCK) -> DataFrame:
    """Blocks over all rows that have a cluster; with ``"cluster"`` windows run on to the next customer."""
    if boundary == "cluster":
        placed = cluster_positions(df, by_split=False)
        return position_blocks(placed, features, seq_len, [CLUSTER], "_cluster_pos", block)
    return position_blocks(df, features, seq_len, [CLUSTER, KEY], POSITION, block)


def training_blocks(df: DataFrame, features: Sequence[str], seq_len: int, boundary: str = "entity", block: int = BLOCK) -> DataFrame:
    """Blocks of the training and validation rows, without the rows themselves."""
    rows = df.where(F.col(SPLIT).isin("train", "val"))
    if boundary == "cluster":
        placed = cluster_positions(rows, by_split=True)
        return position_blocks(placed, features, seq_len, [CLUSTER, SPLIT], "_cluster_pos", block, carry=False)
    return position_blocks(rows, features, seq_len, [CLUSTER, KEY], POSITION, block, carry=False)


def views(flat: np.ndarray, head: int, n: int, seq_len: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (window, step, feature) of a block as a view, and the number of the own row each ends at."""
    total = head + n
    if width == 0 or len(flat) != total * width or total < seq_len:
        return np.zeros((0, seq_len, width)), np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(flat.reshape(total, width), seq_len, axis=0).transpose(0, 2, 1)
    first = max(head, seq_len - 1)
    return windows[first - (seq_len - 1):], np.arange(first - head, n)


def block_windows(values: pa.Array, heads: pa.Array, sizes: pa.Array, seq_len: int, width: int
                  ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(number of the block, own rows, windows, rows they end at) of every block; a missing value is NaN."""
    flat = np.asarray(values.flatten().cast(pa.float64()).fill_null(np.nan))
    ends = np.cumsum(np.asarray(values.value_lengths().fill_null(0)))
    for k, (head, n, end, length) in enumerate(zip(heads.to_pylist(), sizes.to_pylist(), ends.tolist(), np.diff(ends, prepend=0).tolist())):
        yield k, n, *views(flat[end - length:end], head, n, seq_len, width)


def per_row(errors: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Array:
    """Lists with a value for each own row of each block, from (rows, rows with a window, their values); no number is NULL."""
    parts = []
    for n, ends, values in errors:
        out = np.full(n, np.nan)
        out[ends] = values
        parts.append(out)
    flat = np.concatenate([np.zeros(0), *parts])
    offsets = np.concatenate([[0], np.cumsum([n for n, *_ in errors], dtype=np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, mask=np.isnan(flat)))


def unpacked(blocks: DataFrame, values: str, name: str) -> DataFrame:
    """Rows of the blocks, each with its entry of the array column ``values`` and its window's split."""
    each = blocks.select(F.inline(F.arrays_zip(F.col(ROWS).alias("r"), F.col(values).alias("v"), F.col(SPLITS).alias("s"))))
    each = each.toDF("r", "v", "s")
    return each.select("r.*", F.col("v").alias(name), F.col("s").alias(WINDOW_SPLIT))


def unpacked_training(blocks: DataFrame, values: str, name: str) -> DataFrame:
    """(cluster, window split, value) of the windows that lie in one split."""
    each = blocks.select(CLUSTER, F.inline(F.arrays_zip(F.col(values).alias("v"), F.col(SPLITS).alias("s")))).toDF(CLUSTER, "v", "s")
    return each.where("s IS NOT NULL").select(CLUSTER, F.col("s").alias(WINDOW_SPLIT), F.col("v").alias(name))
