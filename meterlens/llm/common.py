"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.session import settle

ROWS_PER_BATCH, BYTES_PER_BATCH = 512, 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts holds; a single longer text is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def give_back() -> None:
    """Hand freed memory to the system: a worker keeps it otherwise, and tasks of other stages need the room."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # other systems than glibc's
        ctypes.CDLL(None).malloc_trim(0)


def crc_remainder(id_column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % divisor


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the values of ``parts`` only."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def mixed_array(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a batch in one array, and where each text starts (one more than texts).

    A null text is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0]:starts[-1]] if len(starts) else whole[:0], starts - starts[0]


def discard(table: DataFrame, part: str = "") -> None:
    """Delete the files of a settled table (or one of its partition folders) that no later table reads."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        folder = re.match(r".*/meterlens-[0-9a-f]{32}(?=/)", file)
        if folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f"{folder[0]}/{part}".rstrip("/")))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """``function`` turns one record batch into one record batch; empty ones are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows:
                    yield function(batch)
        finally:
            give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def drop_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents without those whose id and ``xxhash64`` of the text are in ``rows`` (doc_id, key; null is an id)."""
    gone, hashed = free_name(docs, "_gone"), free_name(docs, "_hashed")
    rows = rows.select(F.col("doc_id").alias(gone), F.col("key").alias(hashed)).distinct()
    return docs.join(rows, docs["doc_id"].eqNullSafe(F.col(gone)) & (F.xxhash64(docs["text"]) == F.col(hashed)), "left_anti")


def one_row_a_text(docs: DataFrame) -> DataFrame:
    """Of rows that share id and text the one of the least hash; where ids are unique nothing moves."""
    same, hashed, many = (free_name(docs, n) for n in ("_same", "_hashed", "_many"))
    keyed = docs.withColumn(hashed, F.xxhash64("text"))
    repeated = settle(keyed.groupBy("doc_id", hashed).agg(F.count(F.lit(1)).alias(many)).where(F.col(many) > 1).select(
        F.col("doc_id").alias(same), F.col(hashed).alias(f"{hashed}_same"), many))
    if repeated.isEmpty():
        return docs
    marked = keyed.join(repeated, keyed["doc_id"].eqNullSafe(F.col(same)) & (F.col(hashed) == F.col(f"{hashed}_same")), "left")
    first = marked.where(F.col(many).isNotNull()).groupBy("doc_id", hashed).agg(
        F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return marked.where(F.col(many).isNull()).select(*docs.columns).unionByName(first.select("row.*"))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of sorted rows cut so that no group is torn, each with the places where groups start (and the end).

    At most one group waits for its end; groups have to be bounded by the caller.
    """
    waiting: list[pa.RecordBatch] = []

    def borders(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            column = np.asarray(batch.column(k))
            new[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = borders(batch)
        if waiting:
            last = waiting[-1]
            goes_on = all(last.column(k)[last.num_rows - 1].as_py() == batch.column(k)[0].as_py() for k in keys)
            if goes_on and len(starts) == 1:
                waiting.append(batch)
                continue
            if goes_on:
                waiting.append(batch.slice(0, starts[1]))
                batch, starts = batch.slice(starts[1]), starts[1:] - starts[1]
            yield pa.concat_batches(waiting), np.array([0, sum(b.num_rows for b in waiting)])
            waiting = []
        if len(starts) > 1:
            yield batch.slice(0, starts[-1]), starts
        waiting = [batch.slice(starts[-1])]
    if waiting:
        yield pa.concat_batches(waiting), np.array([0, sum(b.num_rows for b in waiting)])
