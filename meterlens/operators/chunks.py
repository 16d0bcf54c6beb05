"""Positions and carried values along one customer's series, without one task per customer.

A window over ``cliente_id`` alone puts a whole customer into one task, however long its
series. Here a series is cut into calendar chunks: rows are sorted and ranked per (customer,
chunk), and a small index with one row per (customer, chunk) carries counts and edge values
from chunk to chunk. Only the index is ever windowed per customer, and its length is bounded
by the calendar, not by the number of readings. The unit ``auto`` takes the longest calendar
unit in which no customer has more than ``CHUNK_ROWS`` rows, so one very dense meter gets
shorter chunks instead of longer sorts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlens.params import KEY, TIME
from meterlens.session import settle

CHUNK = "_chunk"
POSITION = "_pos"
TOTAL = "_total"
CHUNK_ROWS = 2_000_000
#: The chunk of rows without a time, for operators that need none.
UNDATED = "0001-01-01"
# Units of date_trunc from long to short.
UNITS = ("year", "month", "week", "day", "hour", "minute", "second")


def split_into_chunks(df: DataFrame, unit: str, key: str = KEY, time: str = TIME,
                      keep_all: bool = False) -> DataFrame:
    """Add the chunk a row belongs to, unless it is there already.

    A row without customer or time has no place in a series and is left out, unless ``keep_all``
    puts the undated rows of a customer into a chunk of their own. The filter is
    spelled out so that both uses of the rows below (themselves and their index) carry the
    same one and share a single shuffle; an inner join would add it to one side only.
    """
    if CHUNK in df.columns:
        return df
    if unit == "auto":
        unit, _ = measured_spans(df.select(key, time), unit, key, time)
    chunked = df.withColumn(CHUNK, F.date_trunc(unit, F.col(time)))
    if keep_all:
        return chunked.withColumn(CHUNK, F.coalesce(CHUNK, F.lit(UNDATED).cast("timestamp")))
    return chunked.where(F.col(key).isNotNull() & F.col(CHUNK).isNotNull())


def count_rows(chunked: DataFrame, key: str = KEY) -> DataFrame:
    """Rows per (key, chunk): a small table, reduced before its shuffle."""
    return chunked.groupBy(key, CHUNK).agg(F.count(F.lit(1)).alias("_rows"))


def measured_spans(df: DataFrame, unit: str, key: str = KEY, time: str = TIME,
                   chunk_rows: int = CHUNK_ROWS) -> tuple[str, DataFrame]:
    """(unit, rows per (key, chunk)), the unit chosen from the counts when it is ``auto``.

    Each try is one map-side count of two columns; for hourly meters the first try fits.
    """
    for candidate in UNITS if unit == "auto" else (unit,):
        spans = settle(count_rows(split_into_chunks(df, candidate, key, time), key))
        densest = spans.agg(F.max("_rows")).first()[0] or 0
        if densest <= chunk_rows:
            break
    return candidate, spans


def with_rows(chunked: DataFrame, key: str = KEY, time: str = TIME) -> DataFrame:
    """Add ``_row``, the place of a row in its chunk."""
    return chunked.withColumn("_row", F.row_number().over(within_chunk(key, time)))


def within_chunk(key: str = KEY, time: str = TIME, latest_first: bool = False):
    order = F.desc(time) if latest_first else F.asc(time)
    return Window.partitionBy(key, CHUNK).orderBy(order)


def known(column: str, row: str) -> Column:
    """(value, row number) where the value is present, else NULL."""
    return F.when(F.col(column).isNotNull(),
                  F.struct(F.col(column).alias("value"), F.col(row).cast("long").alias("row")))


def chunk_index(rows: DataFrame, carry: Sequence[str] = (), key: str = KEY) -> DataFrame:
    """One row per (key, chunk), from rows numbered by ``with_rows``.

    ``_offset`` counts the rows of earlier chunks, ``_total`` all rows of the key. For each
    carried column ``_prev_<c>`` is the last present value of the earlier chunks and
    ``_next_<c>`` the first of the later ones, each with its position in the series.
    """
    facts = [F.count(F.lit(1)).alias("_rows")]
    for c in carry:
        seen = F.when(F.col(c).isNotNull(), F.col("_row"))
        facts += [
            F.min(seen).alias(f"_first_row_{c}"), F.min_by(F.col(c), seen).alias(f"_first_{c}"),
            F.max(seen).alias(f"_last_row_{c}"), F.max_by(F.col(c), seen).alias(f"_last_{c}"),
        ]
    index = rows.groupBy(key, CHUNK).agg(*facts)

    series = Window.partitionBy(key).orderBy(CHUNK)
    earlier = series.rowsBetween(Window.unboundedPreceding, -1)
    later = (Window.partitionBy(key).orderBy(F.desc(CHUNK))
             .rowsBetween(Window.unboundedPreceding, -1))
    index = index.withColumns({
        "_offset": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
        TOTAL: F.sum("_rows").over(Window.partitionBy(key)),
    })
    carried = {}
    for c in carry:
        first_row, last_row = F.col(f"_first_row_{c}"), F.col(f"_last_row_{c}")
        last_known = F.when(last_row.isNotNull(), F.struct(
            F.col(f"_last_{c}").alias("value"), (F.col("_offset") + last_row).alias("row")))
        first_known = F.when(first_row.isNotNull(), F.struct(
            F.col(f"_first_{c}").alias("value"), (F.col("_offset") + first_row).alias("row")))
        carried[f"_prev_{c}"] = F.last(last_known, ignorenulls=True).over(earlier)
        carried[f"_next_{c}"] = F.last(first_known, ignorenulls=True).over(later)
    index = index.withColumns(carried) if carried else index
    return index.select(key, CHUNK, "_offset", TOTAL, *carried)


def with_positions(df: DataFrame, unit: str = "auto", key: str = KEY, time: str = TIME) -> DataFrame:
    """Add ``_pos`` (1-based, by time) and ``_total`` rows of the key."""
    rows = with_rows(split_into_chunks(df, unit, key, time), key, time)
    placed = rows.join(chunk_index(rows, (), key), [key, CHUNK])
    placed = placed.withColumn(POSITION, F.col("_offset") + F.col("_row"))
    extra = [] if CHUNK not in df.columns else [CHUNK]
    return placed.select(*[c for c in df.columns if c != CHUNK], *extra, POSITION, TOTAL)


def attach_to_chunks(chunked: DataFrame, values: DataFrame, key: str = KEY,
                     spans: DataFrame | None = None) -> DataFrame:
    """Left-join per-key values, reusing the (key, chunk) partitioning of the rows.

    The values are first spread over the chunks of each key (a small table), so the rows
    themselves are not shuffled again and a hot key stays split by chunk.
    """
    spans = chunked if spans is None else spans
    spread = spans.select(key, CHUNK).distinct().join(values, key, "left")
    return chunked.join(spread, [key, CHUNK], "left")


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
                  amount: Column, name: str) -> DataFrame:
    """Sum of ``amount`` over the rows before each row, per ``group`` in ``order``.

    For groups of any size: rows are range-partitioned by group and order, written once so
    that partition numbers stay fixed, totalled per partition (as many rows as partitions),
    and summed inside each partition. ``order`` must be unique within a group.
    """
    placed = df.repartitionByRange(*[F.col(g) for g in group], *order)
    placed = settle(placed.withColumns({"_part": F.spark_partition_id(), "_amount": amount}))
    totals = placed.groupBy(*group, "_part").agg(F.sum("_amount").alias("_part_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_part_start", F.coalesce(F.sum("_part_sum").over(earlier), F.lit(0)))
    inside = (Window.partitionBy(*group, "_part").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    summed = placed.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    joined = summed.join(totals.drop("_part_sum"), [*group, "_part"])
    return (joined.withColumn(name, F.col("_part_start") + F.col("_inside"))
            .drop("_part", "_amount", "_inside", "_part_start"))
