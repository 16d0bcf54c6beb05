"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of ``size`` bytes that covers it also starts earlier (in a document of a
smaller id, or earlier in its own), so the first copy of a passage stays. Texts are UTF-8 bytes;
strings never cross documents and are judged on the input.

1. Every string of ``size`` bytes has a key: the smallest hash of its ``GRAM``-byte grams, which
   equal strings share. Neighbouring starts mostly have the same key, so a document is a list of
   runs (key, start, number of starts), one for about 40 bytes, with a hash of the run's bytes.
2. Runs meet by key, sorted by (content, position), and are read in a stream that keeps one run.
   Runs whose key is alone go. A run whose content came before is a copy as a whole. The first of
   each content is kept for step 3 if its key has other contents too, or if it may repeat itself.
3. The bytes of those runs are read from the documents, and meet by key. The runs of some keys at a
   time are laid side by side; their suffixes are sorted (by doubling, deep enough to compare
   ``size`` bytes), and the previous and next smaller position in suffix order give each start its
   longest previous factor. Starts whose factor reaches ``size`` are copies.
   Keys of over ``CROWD`` contents are taken apart first: their strings become runs of one start,
   with the hash of the string as the key, and go through step 2, where nothing is left to sort.
4. Copies, as intervals of starts, go back to their documents, which cut them out.

Defined cases: a null text is empty; a null id counts as the smallest; rows of one id and text are
one document, each of which gets its result; texts of one id come in the order of a hash; an empty
table gives no rows; extra columns pass through (one named like a result is replaced). Very long
texts are worked on in slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.llm.common import map_batches, small_batches, text_buffers
from meterlens.session import settle

GRAM, CROWD, SLICE, SORTED_BYTES, LONGEST_RUN = 20, 20_000, 1 << 18, 1 << 20, 4096
ODD = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTES, OTHER = np.random.default_rng(100).integers(0, (1 << 64) - 1, (2, 256), np.uint64)
RUN = "key long, content long, document long, variant long, start long, n int, selfish boolean"
PLACE = ["document", "variant", "start"]


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


UP, DOWN = powers(ODD, SLICE + 8192), powers(BACK, SLICE + 8192)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def span_hashes(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from ``starts`` to ``ends``, the same wherever they stand."""
    return mixed((total[ends] - total[starts]) * DOWN[starts])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs_of(data: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Runs of a slice of bytes: first start, number of starts, key, content, whether a gram may repeat in it.

    ``owner`` numbers the document of each byte; starts whose string leaves its document are left out.
    """
    n = len(data) - size + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(bool)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * UP[:len(data)], out=total[1:])
    grams = mixed((total[GRAM:] - total[:-GRAM]) * DOWN[:len(data) - GRAM + 1])
    key = sliding_minimum(grams, size - GRAM + 1)
    inside = owner[:n] == owner[size - 1:]
    cut = np.ones(n, bool)
    cut[1:] = (key[1:] != key[:-1]) | (owner[1:n] != owner[:n - 1])
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], n)
    # Starts that stay inside a document come before those that leave it.
    counted = np.concatenate([[0], np.cumsum(inside)])
    length = counted[end] - counted[begin]
    begin, length = begin[length > 0], length[length > 0]
    if len(length) and length.max() > LONGEST_RUN:
        pieces = -(-length // LONGEST_RUN)
        at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, length = np.repeat(begin, pieces) + at * LONGEST_RUN, np.minimum(LONGEST_RUN, np.repeat(length, pieces) - at * LONGEST_RUN)
        longer = np.repeat(pieces > 1, pieces)
    else:
        longer = np.zeros(len(begin), bool)
    chosen = key[begin]
    # The key's gram stands in the last string; if it came up first before the last start, it comes up twice.
    window = np.lib.stride_tricks.sliding_window_view(grams, size - GRAM + 1)[begin]
    first = begin + (window == chosen[:, None]).argmax(axis=1)
    return begin, length, chosen, span_hashes(total, begin, begin + length + size - 1), longer | (begin + length - 1 > first)


def slices(starts: np.ndarray, size: int):
    """Byte ranges of at most SLICE starts (and the bytes that their strings need) over several texts."""
    total = int(starts[-1])
    for at in range(0, total, SLICE):
        yield at, min(total, at + SLICE + size - 1)


def cut_runs(docs: DataFrame, size: int) -> DataFrame:
    """Step 1. ``document`` is the document's number, ``start`` a byte of its text."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, starts = text_buffers(batch.column("text"))
            document, variant = (np.asarray(batch.column(c), np.int64) for c in PLACE[:2])
            owner = np.repeat(np.arange(len(document)), np.diff(starts))
            for low, high in slices(starts, size):
                begin, length, key, content, selfish = runs_of(data[low:high], owner[low:high], size)
                if len(begin):
                    own = owner[low + begin]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(key.view(np.int64)), pa.array((content ^ length.astype(np.uint64)).view(np.int64)),
                        pa.array(document[own]), pa.array(variant[own]), pa.array(low + begin - starts[own]),
                        pa.array(length.astype(np.int32)), pa.array(selfish)], names=["key", "content", *PLACE, "n", "selfish"])

    small_batches(docs.sparkSession)
    return docs.select("document", "variant", "text").mapInArrow(run, RUN)


def judge_runs(runs: DataFrame) -> DataFrame:
    """Step 2: (key, document, variant, start, n, copy); runs that need no further look are left out.

    Sorted runs pass by; per key only the first run of the first content waits until the next
    content or key tells whether the key has more than one.
    """
    columns = ["key", "content", *PLACE, "n"]
    dealt = runs.repartition("key").sortWithinPartitions("key", "content", *PLACE)

    def run(batches):
        before, waits = None, None  # the last run, and the run that waits
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.asarray(batch.column(c), np.int64) for c in columns]
            selfish = np.asarray(batch.column("selfish").to_numpy(zero_copy_only=False), bool)
            changed = np.ones((3, len(selfish)), bool)  # from the run before: key, content, place
            ahead = [np.concatenate([[0 if before is None else before[i]], c[:-1]]) for i, c in enumerate(rows[:5])]
            changed[0] = rows[0] != ahead[0]
            changed[0, 0] |= before is None
            changed[1] = changed[0] | (rows[1] != ahead[1])
            changed[2] = changed[1] | np.any([a != b for a, b in zip(rows[2:5], ahead[2:])], axis=0)
            new_key, new_content, new_place = changed
            group = np.cumsum(new_key)
            contents = np.bincount(group, new_content & ~new_key)
            looked = new_content & (~new_key | (contents[group] > 0) | selfish)
            copies = new_place & ~new_content
            out = [[c[mask] for c in rows] + [np.full(mask.sum(), kind)] for mask, kind in ((looked, False), (copies, True))]
            if waits is not None and contents[0] > 0:
                out.append([np.array([x]) for x in waits] + [np.zeros(1, bool)])
                waits = None
            if new_key.any():
                last = int(np.flatnonzero(new_key)[-1])
                waits = None if looked[last] else [c[last] for c in rows]
            before = [c[-1] for c in rows]
            key, _, document, variant, start, n, copy = (np.concatenate(c) for c in zip(*out))
            if len(key):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in (key, document, variant, start, n.astype(np.int32), copy)], names=["key", *PLACE, "n", "copy"])

    small_batches(runs.sparkSession)
    return dealt.mapInArrow(run, "key long, document long, variant long, start long, n int, copy boolean")


def ranks_of(data: np.ndarray, size: int) -> np.ndarray:
    """Rank of each position's ``size`` bytes in suffix order; equal ones have equal ranks.

    By doubling: the rank of 2k bytes sorts by the ranks of k bytes here and k bytes on. Seven
    bytes at once fit a number, which is the first rank.
    """
    depth, packed = min(7, size), np.zeros(len(data), np.int64)
    for i in range(depth):
        packed <<= 8
        packed[:len(data) - i] |= data[i:]
    _, rank = np.unique(packed, return_inverse=True)
    while depth < size:
        step = min(depth, size - depth)
        follow = np.full(len(rank), -1, np.int64)
        follow[:-step] = rank[step:]
        _, rank = np.unique((rank << 32) | (follow + 1), return_inverse=True)
        depth += step
    return rank


def previous_factors(data: np.ndarray, position: np.ndarray, size: int) -> np.ndarray:
    """Whether each place's longest previous factor reaches ``size``.

    Places are sorted into suffix order; from each, pointers walk to the previous and to the next
    smaller position while what lies between shares ``size`` bytes or more. ``position`` numbers
    the places in the order of the corpus (-1: no string starts here).
    """
    used = np.flatnonzero(position >= 0)
    rank = ranks_of(data, size)[used]
    order = np.lexsort((used, rank))
    rank, place = rank[order], position[used][order]
    n, found = len(order), np.zeros(len(order), bool)
    for side in (-1, 1):
        pointer = np.arange(n) + side
        active = np.arange(n)
        while len(active):
            there = pointer[active]
            inside = (there >= 0) & (there < n)
            active, there = active[inside], there[inside]
            same = rank[there] == rank[active]
            active, there = active[same], there[same]
            smaller = place[there] < place[active]
            found[active[smaller]] = True
            active, there = active[~smaller], there[~smaller]
            # All between a place and its pointer lies later, so the pointer's pointer is as safe.
            pointer[active] = pointer[there]
    out = np.zeros(len(position), bool)
    out[used[order]] = found
    return out


def fetch(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Bytes of runs: (key, document, variant, start, n, crowd, bytes)."""
    # A document lists its own runs only. The texts stream past the lists without being sorted.
    listed = wanted.groupBy("document", "variant").agg(F.collect_list(F.struct("key", "start", "n", "crowd")).alias("runs"))
    rows = docs.select("document", "variant", "text").join(listed.hint("shuffle_hash"), ["document", "variant"])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, runs = batch.column("text").to_pylist(), batch.column("runs")
            counts = np.diff(np.asarray(runs.offsets))
            key, start, n, crowd = runs.flatten().flatten()
            document, variant = (np.repeat(np.asarray(batch.column(c), np.int64), counts) for c in PLACE[:2])
            parts, spans = [], zip(start.to_pylist(), n.to_pylist())
            for text, count in zip(texts, counts.tolist()):
                data = (text or "").encode()
                parts += [data[s:s + k + size - 1] for s, k in (next(spans) for _ in range(count))]
            yield pa.RecordBatch.from_arrays([key, pa.array(document), pa.array(variant), start, n, crowd, pa.array(parts, pa.binary())],
                                             names=["key", *PLACE, "n", "crowd", "bytes"])

    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, "key long, document long, variant long, start long, n int, crowd boolean, bytes binary")


def single_strings(fetched: DataFrame, size: int) -> DataFrame:
    """Runs of one start each, with two hashes of the string as key and content."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, starts = text_buffers(batch.column("bytes"))
            document, variant, start = (np.asarray(batch.column(c), np.int64) for c in PLACE)
            owner = np.repeat(np.arange(len(document)), np.diff(starts))
            for low, high in slices(starts, size):
                values = data[low:high]
                at = np.flatnonzero(owner[low:high - size + 1] == owner[low + size - 1:high])
                hashes = []
                for table in (BYTES, OTHER):
                    total = np.zeros(len(values) + 1, np.uint64)
                    np.cumsum(table[values] * UP[:len(values)], out=total[1:])
                    hashes.append(pa.array(span_hashes(total, at, at + size).view(np.int64)))
                own = owner[low + at]
                yield pa.RecordBatch.from_arrays(
                    [*hashes, pa.array(document[own]), pa.array(variant[own]), pa.array(start[own] + low + at - starts[own]),
                     pa.array(np.ones(len(at), np.int32)), pa.array(np.zeros(len(at), bool))], names=["key", "content", *PLACE, "n", "selfish"])

    small_batches(fetched.sparkSession)
    return fetched.mapInArrow(run, RUN)


def sort_suffixes(fetched: DataFrame, size: int) -> DataFrame:
    """Step 3: (document, variant, start, n) of runs of copies. The runs of a key are at most CROWD."""
    dealt = fetched.repartition("key").sortWithinPartitions("key", *PLACE)

    def copies(rows):
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        length = np.array([len(r[4]) for r in rows])
        begin = np.cumsum(length) - length
        document, variant, start, n = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        # Places are numbered in the order of the corpus, not of the keys in this lot.
        order = np.lexsort((start, variant, document))
        base = np.zeros(len(rows), np.int64)
        base[order] = np.cumsum(n[order]) - n[order]
        row = np.repeat(np.arange(len(rows)), n)
        inside = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        position = np.full(len(data), -1, np.int64)
        place = begin[row] + inside
        position[place] = base[row] + inside
        hit = previous_factors(data, position, size)[place]
        new = hit.copy()
        new[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        counts = np.bincount((np.cumsum(new) - 1)[hit], minlength=len(first))
        return pa.RecordBatch.from_arrays(
            [pa.array(document[row[first]]), pa.array(variant[row[first]]), pa.array(start[row[first]] + inside[first]),
             pa.array(counts.astype(np.int32))], names=[*PLACE, "n"])

    def run(batches):
        held, held_bytes, last = [], 0, None
        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", *PLACE, "n", "bytes"))):
                if held and key == last and row[:3] == held[-1][:3]:
                    continue  # the document's row came twice
                if held_bytes >= SORTED_BYTES and key != last:
                    yield copies(held)
                    held, held_bytes = [], 0
                held.append(row)
                held_bytes += len(row[4])
                last = key
        if held:
            yield copies(held)

    small_batches(fetched.sparkSession)
    return dealt.mapInArrow(run, "document long, variant long, start long, n int")


def numbered(docs: DataFrame) -> DataFrame:
    """(document, variant, text, row): a number that sorts like the id, one that tells texts of an id apart, and all columns."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("document"), "text", F.struct(*docs.columns).alias("row"))
    repeated = settle(rows.groupBy("document").count().where("count > 1").select("document", F.lit(True).alias("repeated")))
    if repeated.isEmpty():
        return rows.withColumn("variant", F.lit(0).cast("long"))
    return rows.join(repeated, "document", "left").withColumn("variant", F.when(
        F.col("repeated"), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(0)).drop("repeated")


def repeated_starts(docs: DataFrame, size: int) -> DataFrame:
    """(document, variant, start, n): runs of starts whose strings are copies."""
    judged = settle(judge_runs(cut_runs(docs, size)))
    open_runs = judged.where("NOT copy").drop("copy")
    crowded = open_runs.groupBy("key").count().where(F.col("count") > CROWD).select("key", F.lit(True).alias("crowd"))
    wanted = open_runs.join(crowded, "key", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    fetched = settle(fetch(docs, wanted, size))
    columns = [*PLACE, "n"]
    apart = judge_runs(single_strings(fetched.where("crowd"), size)).where("copy")
    sorted_out = sort_suffixes(fetched.where("NOT crowd").drop("crowd"), size)
    return judged.where("copy").select(*columns).unionByName(sorted_out).unionByName(apart.select(*columns))


def removed_spans(starts: pa.Array, n: pa.Array, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings cover."""
    spans: list[list[int]] = []
    for a, k in sorted(zip(starts.to_pylist(), n.to_pylist())):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], a + k + size - 1)
        else:
            spans.append([a, a + k + size - 1])
    return [tuple(s) for s in spans]


def with_copies(docs: DataFrame, size: int) -> DataFrame:
    """(row, copies): all columns of each document, and the runs of starts whose strings are copies."""
    if size <= GRAM or size > 4096:
        raise ValueError(f"size has to be over {GRAM} and at most 4096")
    rows = numbered(docs)
    copies = settle(repeated_starts(rows, size)).groupBy("document", "variant").agg(F.collect_list(F.struct("start", "n")).alias("copies"))
    return rows.drop("text").join(copies.hint("shuffle_hash"), ["document", "variant"], "left").select("row", "copies")


def cut(text: str | None, copies: pa.Scalar, size: int) -> tuple[bytes, int, list[tuple[int, int]]]:
    """What is left of a text, its length in bytes, and what was removed."""
    data, spans = (text or "").encode(), []
    if copies.is_valid:
        spans = removed_spans(*copies.values.flatten(), size)
    at, parts = 0, []
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]]), len(data), spans


def cut_repeats(docs: DataFrame, size: int = 100) -> DataFrame:
    """All columns of the documents, and ``kept`` (bytes), ``n_bytes``, ``n_removed``, ``spans`` (from, to)."""
    others = [f for f in docs.schema.fields if f.name not in ("kept", "n_bytes", "n_removed", "spans")]
    span = T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])
    schema = T.StructType(others + [T.StructField("kept", T.BinaryType()), T.StructField("n_bytes", T.LongType()),
                                    T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(span))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = batch.column("row")
        found = [cut(t, c, size) for t, c in zip(row.field("text").to_pylist(), batch.column("copies"))]
        return pa.RecordBatch.from_arrays(
            [row.field(f.name) for f in others]
            + [pa.array([k for k, _, _ in found], pa.binary()), pa.array([n for _, n, _ in found], pa.int64()),
               pa.array([sum(b - a for a, b in s) for *_, s in found], pa.int64()),
               pa.array([[{"from": a, "to": b} for a, b in s] for *_, s in found], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))],
            names=schema.names)

    return map_batches(with_copies(docs, size), run, schema)


def digest(cut: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of documents that were cut."""
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def with_cut_texts(docs: DataFrame, size: int = 100) -> DataFrame:
    """The documents, all columns, with what is left as ``text`` and its length as ``n_chars`` where there is one.

    A character that lost some of its bytes goes as a whole. A null text stays null.
    """
    schema = docs.schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = batch.column("row")
        texts = [None if t is None else cut(t, c, size)[0].decode("utf-8", "ignore")
                 for t, c in zip(row.field("text").to_pylist(), batch.column("copies"))]
        return pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.string()) if f.name == "text" else row.field(f.name) for f in schema.fields], names=schema.names)

    out = map_batches(with_copies(docs, size), run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return out
