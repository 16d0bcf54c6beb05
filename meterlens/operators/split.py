"""Chronological split per customer into train, val and test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.operators.chunks import POSITION, TOTAL, with_positions
from meterlens.params import KEY, TIME

SPLIT = "particion"


def split_label(position: Column, total: Column, test_size: float, val_size: float) -> Column:
    """Label of the row at a 1-based position; shares are truncated binary doubles.

    The last rows are test and those before them val. Fewer than 3 rows are all train. When
    nothing is left to train on, the first rows are val and the rest test.
    """
    n_test = F.floor(total * F.lit(float(test_size)))
    n_rest = total - n_test
    n_val = F.floor(n_rest * F.lit(float(val_size)))
    n_train = n_rest - n_val
    return (
        F.when(total < 3, "train")
        .when(n_rest <= 0, "test")
        .when((n_train <= 0) & (position <= n_val), "val")
        .when(n_train <= 0, F.when(n_test > 0, "test"))
        .when(position <= n_train, "train")
        .when(position <= n_rest, "val")
        .otherwise("test"))


def split_chronologically(df: DataFrame, test_size: float = 0.2, val_size: float = 0.15,
                          unit: str = "auto", key: str = KEY, time: str = TIME) -> DataFrame:
    """Add the split label, the position and the number of rows of the customer."""
    placed = with_positions(df, unit, key, time)
    return placed.withColumn(
        SPLIT, split_label(F.col(POSITION), F.col(TOTAL), test_size, val_size))
