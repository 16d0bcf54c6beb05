"""SimHash near-duplicates, found through pivot distance tables.

A fingerprint has 64 bits; a bit is set if it is set in over half of the XXH64 hashes of the
text's shingles. Documents link if their fingerprints differ in ``distance`` bits or fewer, and a
component is what links reach.

Documents of one fingerprint are one class. Each class has a table of its Hamming distances to
``PIVOTS`` reference fingerprints, made once. Two fingerprints within the distance have at least
two of five blocks of bits in common, so classes meet by (pair of blocks, their bits). Of those
that meet, a pair is discarded if any two entries of their tables differ by more than the
distance (the triangle inequality), and the survivors are verified bit by bit. A meeting place of
over ``MEET`` classes is cut into pieces, and every two pieces meet in a task of their own; each
task links its classes by a spanning star, not by all pairs. No link is lost.

Defined cases: null texts and texts without a word have fingerprint zero and link like any other;
a null id counts as the smallest id and stays null in the result; rows are kept as often as they
occur; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import drop_texts, map_batches, one_row_a_text, small_batches
from meterlens.llm.graph import components
from meterlens.session import settle

PIVOTS, MEET, NO_ID = 16, 4096, -(1 << 63)
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: str | None, words: int = 3) -> int:
    found = text.encode().lower().split() if text else []
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]).tolist()
    starts = [0, *ends]
    digest, last = xxhash.xxh64_intdigest, min(words, len(found)) - 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        stop = min(n, at + (1 << 16))
        hashes = np.array([digest(joined[a:b - 1], 42) for a, b in zip(starts[at:stop], ends[at + last:stop + last])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, key, print) of every whole text: a hash of the text, and the print as a signed number."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(prints.view(np.int64))],
                                          names=["doc_id", "key", "print"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key")), run, "doc_id long, key long, print long")


def references() -> list[int]:
    return np.random.default_rng(64).integers(-(1 << 63), (1 << 63) - 1, PIVOTS, np.int64).tolist()


def linked(prints: np.ndarray, tables: np.ndarray, distance: int) -> np.ndarray:
    """Number of each class's group within one meeting place (the lowest place among its links)."""
    n = len(prints)
    group = np.arange(n)
    order = np.argsort(tables[:, 0], kind="stable")
    first = tables[order, 0]
    left, right = [], []
    for at in range(0, n, 256):
        rows = np.arange(at, min(n, at + 256))
        stop = int(np.searchsorted(first, first[rows[-1]] + distance, "right"))
        i, j = np.divmod(np.arange(len(rows) * (stop - at)), stop - at)
        i, j = rows[i], at + j
        near = j > i
        i, j = order[i[near]], order[j[near]]
        for p in range(tables.shape[1]):
            near = np.abs(tables[i, p] - tables[j, p]) <= distance
            i, j = i[near], j[near]
        near = np.bitwise_count(prints[i] ^ prints[j]) <= distance
        i, j = i[near], j[near]
        # Pairs of one group already say nothing new.
        new = group[i] != group[j]
        left, right = i[new], j[new]
        while len(left):
            low = np.minimum(group[left], group[right])
            np.minimum.at(group, group[left], low)
            np.minimum.at(group, group[right], low)
            while (group[group] != group).any():
                group = group[group]
            new = group[left] != group[right]
            left, right = left[new], right[new]
    return group


def links(classes: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) between classes (node, print, t0, t1) that span all their links."""
    spark = classes.sparkSession
    keys = []
    for k, pair in enumerate(combinations(BLOCKS, 2)):
        bits = F.lit(k).cast("long")
        for start, size in pair:
            bits = F.shiftleft(bits, size).bitwiseOR(F.shiftrightunsigned("print", start).bitwiseAND(F.lit((1 << size) - 1)))
        keys.append(bits)
    meeting = classes.select(F.explode(F.array(*keys)).alias("key"), "node", "print", "t0", "t1")
    crowded = meeting.groupBy("key").count().where(F.col("count") > MEET).select(
        "key", F.ceil(F.col("count") / MEET).cast("int").alias("pieces"))
    placed = meeting.join(crowded, "key", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("print"), F.col("pieces")).cast("int"))
    units = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "print", "t0", "t1")
    # Of the pieces of a place, a task gets two; both are needed where they differ.
    dealt = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def run(batches):
        rest = None
        for batch in batches:
            now = np.stack([np.asarray(batch.column(c), np.int64) for c in ("key", "i", "j", "node", "print", "t0", "t1")])
            now = now if rest is None else np.concatenate([rest, now], axis=1)
            last = int(np.flatnonzero((now[:3] != now[:3, -1:]).any(axis=0))[-1]) + 1 if (now[:3] != now[:3, -1:]).any() else 0
            rest = now[:, last:]
            if last:
                yield from spans(now[:, :last])
        if rest is not None:
            yield from spans(rest)

    def spans(rows):
        cut = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [rows.shape[1]]])
        node, prints = rows[3], rows[4].astype(np.uint64)
        tables = np.ascontiguousarray(rows[5:7].T).view(np.uint8).reshape(-1, PIVOTS).astype(np.int16)
        a, b = [], []
        two = starts[ends - starts == 2]
        near = (np.abs(tables[two] - tables[two + 1]) <= distance).all(axis=1)
        two = two[near]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= distance]
        a.append(node[two])
        b.append(node[two + 1])
        for s, e in zip(starts.tolist(), ends.tolist()):
            if e - s > 2:
                group = linked(prints[s:e], tables[s:e], distance)
                other = group != np.arange(e - s)
                a.append(node[s:e][group[other]])
                b.append(node[s:e][other])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    small_batches(spark)
    return dealt.mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, words: int, distance: int) -> DataFrame:
    """(doc_id, node, key, print, least, least_key) of every row: its id, that or NO_ID, a hash of its text, and its group's smallest node and key."""
    if distance > 3:
        raise ValueError("five blocks of which two agree need a distance of 3 or less")
    prints = settle(fingerprints(docs, words).withColumn("node", F.coalesce("doc_id", F.lit(NO_ID))))
    tables = [F.bit_count(F.col("print").bitwiseXOR(F.lit(r))).cast("long") for r in references()]

    def packed(part):
        out = part[0]
        for i, d in enumerate(part[1:], 1):
            out = out.bitwiseOR(F.shiftleft(d, 8 * i))
        return out

    # Classes are told apart by their print: an id can have texts in several.
    classes = settle(prints.groupBy("print").agg(F.min(F.struct("node", "key")).alias("first")).select(
        F.col("print").alias("node"), "print", "first", packed(tables[:8]).alias("t0"), packed(tables[8:]).alias("t1")))
    found = components(links(classes.drop("first"), distance))
    labelled = settle(classes.select("node", "print", "first").join(found, "node", "left").select(
        "print", "first", F.coalesce("component", "node").alias("group")))
    firsts = labelled.groupBy("group").agg(F.min("first").alias("least"))
    named = labelled.select("print", "group").join(firsts, "group").select(
        "print", F.col("least.node").alias("least"), F.col("least.key").alias("least_key"))
    return prints.join(settle(named), "print")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; a component has the smallest id of its rows."""
    return grouped(docs, words, distance).select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.nullif(F.col("least"), F.lit(NO_ID)).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """The documents, all columns, of which each group keeps its smallest by id and hash of the text (one row of it).

    Rows are told apart by id and text: other texts of an id, or without one, are documents of their own.
    """
    gone = grouped(docs, words, distance).where((F.col("node") != F.col("least")) | (F.col("key") != F.col("least_key")))
    return one_row_a_text(drop_texts(docs, settle(gone.select("doc_id", "key"))))
