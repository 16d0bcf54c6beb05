"""Sliding windows of consecutive rows, cut in blocks of positions so no series is one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlens.operators.chunks import POSITION, running_total
from meterlens.operators.split import SPLIT
from meterlens.params import CLUSTER, KEY

WINDOW = "ventana"
WINDOW_SPLIT = "particion_ventana"
BLOCK = 4096


def add_windows(df: DataFrame, features: Sequence[str], seq_len: int, keys: Sequence[str],
                position: str = POSITION, block: int = BLOCK) -> DataFrame:
    """Add ``ventana``: the features of the last ``seq_len`` rows, oldest first, flattened.

    NULL on rows with too few rows before them, and everywhere if a feature column is absent.
    Positions must count 1, 2, 3, … within ``keys``. Rows are grouped by position block and
    the last ``seq_len - 1`` rows of a block are repeated at the head of the next one, so a
    group holds at most ``block + seq_len - 1`` rows. With a split label among the columns,
    ``particion_ventana`` is that label when the whole window lies in one split.
    """
    if any(f not in df.columns for f in features):
        return df.withColumns({
            WINDOW: F.lit(None).cast("array<double>"), WINDOW_SPLIT: F.lit(None).cast("string")})
    block = max(block, seq_len)
    home = F.floor((F.col(position) - 1) / block)
    tail = (F.col(position) - 1) % block >= block - (seq_len - 1)
    blocks = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    values = F.array(*[F.col(f).cast("double") for f in features])
    spread = df.withColumn("_home", home).withColumn("_x", values).withColumn("_block", F.explode(blocks))
    frame = (Window.partitionBy(*keys, "_block").orderBy(position)
             .rowsBetween(-(seq_len - 1), Window.currentRow))
    added = {"_list": F.collect_list("_x").over(frame)}
    if SPLIT in df.columns:
        added["_first_split"] = F.first(SPLIT).over(frame)
    rows = spread.withColumns(added).where(F.col("_home") == F.col("_block"))
    whole = F.size("_list") == seq_len
    out = {WINDOW: F.when(whole, F.flatten("_list"))}
    if SPLIT in df.columns:
        out[WINDOW_SPLIT] = F.when(whole & (F.col("_first_split") == F.col(SPLIT)), F.col(SPLIT))
    return rows.withColumns(out).select(*df.columns, *out)


def cluster_positions(df: DataFrame, by_split: bool) -> DataFrame:
    """Position of each row in its cluster's frame ordered by customer and time.

    With ``by_split`` the frame holds one split of the cluster only. A customer's start is the
    number of rows of the customers before it, summed over a range-partitioned customer table.
    """
    group = [CLUSTER, SPLIT] if by_split else [CLUSTER]
    sizes = df.groupBy(*group, KEY).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(POSITION).alias("_first"))
    starts = running_total(sizes, group, [KEY], F.col("_rows"), "_start").drop("_rows")
    placed = df.join(starts, [*group, KEY])
    return (placed.withColumn("_cluster_pos", F.col("_start") + F.col(POSITION) - F.col("_first") + 1)
            .drop("_start", "_first"))


def score_windows(df: DataFrame, features: Sequence[str], seq_len: int, boundary: str = "entity",
                  block: int = BLOCK) -> DataFrame:
    """Windows over all rows that have a cluster; the score of a window belongs to its last row."""
    if boundary == "cluster":
        placed = cluster_positions(df, by_split=False)
        return add_windows(placed, features, seq_len, [CLUSTER], "_cluster_pos", block).drop("_cluster_pos")
    return add_windows(df, features, seq_len, [CLUSTER, KEY], POSITION, block)


def training_windows(df: DataFrame, features: Sequence[str], seq_len: int, boundary: str = "entity",
                     block: int = BLOCK) -> DataFrame:
    """(cluster_id, particion_ventana, ventana) of windows that lie in one split, train or val."""
    rows = df.where(F.col(SPLIT).isin("train", "val"))
    if boundary == "cluster":
        placed = cluster_positions(rows, by_split=True)
        made = add_windows(placed, features, seq_len, [CLUSTER, SPLIT], "_cluster_pos", block)
    else:
        # The cluster is among the keys so that a filter on it passes below the window.
        made = add_windows(rows, features, seq_len, [CLUSTER, KEY], POSITION, block)
    return (made.where(F.col(WINDOW).isNotNull() & F.col(WINDOW_SPLIT).isNotNull())
            .select(CLUSTER, WINDOW_SPLIT, WINDOW))
