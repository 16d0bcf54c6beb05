"""Benchmark decontamination by template windows.

Numbers, names (capitalised words; several in a row are one) and units (after a number) become typed
placeholders, other words are lower-cased. A window is the shortest stretch from a token on, or up
to a token, of at least ``window`` such tokens with at least ``literals`` words: number-heavy text has
longer windows. Windows are hash-joined between benchmark and documents. Where a window matches, its
slots tell what the document put in the place of each value. A match counts if its slots are the
item's own, or if over the whole alignment (document, item, reading, shift) each value of the item
became one value: a re-parameterised question. A document holds an item if the windows that count
cover ``tokens`` of its tokens (all, if it has fewer).

A capitalised word that begins a sentence may be a name or not, so texts are read both ways. An item
shorter than a window, or with ``few`` words or more but fewer than ``literals`` in all, is one window
of its length (from ``shortest`` tokens on). Windows of ``window`` tokens with fewer words, and whole
items shorter than that with fewer words, are looked for token by token: as verbatim copies, not as
templates. Items under ``shortest`` tokens are looked for if they hold a number, as a few words alone
occur anywhere.

Windows reach the join through a bit set of fixed size (``bits``), filled from the benchmark
whatever its size: it lets everything pass that the join can find and most other windows not.

Defined cases: null and empty texts hold nothing, a null id is an id like any other, an empty
benchmark or table gives no rows, repeated rows count once, extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import free_name, small_batches
from meterlens.session import settle

TOKENS = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?]")
UNITS = frozenset("""
mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds ml cl l
liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month
months year years percent degree degrees dollar dollars euro euros cent cents volt volts watt watts joule
joules newton newtons byte bytes kb mb gb meter meters metre metres
""".split())
LITERAL, TITLE, NUMBER, MARK, UNIT = range(5)
#: Sentence starts as words, as names, or every token as it is; the first two for whole items too.
WORDS, NAMES, VERBATIM, WORDS_WHOLE, NAMES_WHOLE = range(5)
STEP = 0xD1342543DE82EF95
SCHEMA = "id long, reading int, pos int, size int, hash long, slots array<long>, place int, span int, n_tokens int"


@dataclass(frozen=True)
class TemplateParams:
    window: int = 8
    literals: int = 5
    tokens: int = 12
    shortest: int = 5
    few: int = 3
    bits: int = 22


class Codes(dict):
    """A token's hash with its kind in the last three bits."""

    def __missing__(self, token: str) -> int:
        if token[0].isdecimal():
            kind, text = NUMBER, token
        elif token in ".!?":
            kind, text = MARK, token
        else:
            text = token.lower()
            kind = TITLE if len(token) > 1 and token[0].isupper() and token[1:].islower() else UNIT if token in UNITS else LITERAL
        code = (xxhash.xxh64_intdigest(text, 3) >> 4 << 3) | kind
        if len(self) > 300_000:
            self.clear()
        self[token] = code
        return code


_powers: dict[int, np.ndarray] = {}


def powers(step: int, n: int) -> np.ndarray:
    """The first powers of ``step`` modulo 2 ** 64, ``n`` at least."""
    if len(_powers.get(step, ())) < n:
        factors = np.full(2 * n + 1, step, np.uint64)
        factors[0] = 1
        _powers[step] = np.cumprod(factors)
    return _powers[step]


class Stream:
    """The tokens of some texts in one reading."""

    def __init__(self, reading: int, n_texts: int, owner, value, slot, initial):
        self.reading = reading
        # A name goes on where a capitalised word follows in the same sentence.
        joined = np.zeros(len(owner), bool)
        if reading != VERBATIM:
            joined[1:] = (slot[1:] == 3) & (slot[:-1] == 3) & (owner[1:] == owner[:-1]) & ~initial[1:]
        head = np.flatnonzero(~joined)
        counts = np.bincount(owner, minlength=n_texts)
        raw = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
        self.spans = np.diff(np.append(head, len(owner)))
        rank = np.arange(len(owner)) - np.repeat(head, self.spans)
        parts = value.astype(np.uint64) * powers(STEP, int(rank.max(initial=0)) + 1)[rank]
        self.value = (np.add.reduceat(parts, head) if len(head) else parts).view(np.int64)
        self.owner, self.slot, self.raw = owner[head], slot[head], raw[head]
        self.tokens = np.bincount(self.owner, minlength=n_texts)
        self.ends = np.cumsum(self.tokens)
        self.starts = self.ends - self.tokens
        self.words = np.concatenate([[0], np.cumsum(self.slot == 0)])
        placed = self.slot if reading != VERBATIM else np.zeros_like(self.slot)
        template = np.where(placed > 0, placed, self.value).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        template ^= template >> np.uint64(29)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(template * powers(STEP, len(template))[:len(template)], dtype=np.uint64)])

    def hashes(self, start: np.ndarray, size: np.ndarray, reading: int) -> np.ndarray:
        back = powers(pow(STEP, -1, 1 << 64), len(self.owner) + 1)
        found = (self.sums[start + size] - self.sums[start]) * back[start] + np.uint64(reading << 56 | reading)
        found ^= found >> np.uint64(32)
        found *= np.uint64(0xBF58476D1CE4E5B9)
        return found

    def windows(self, size: int, literals: int) -> tuple[np.ndarray, np.ndarray]:
        """The shortest windows from each token on and, where they are longer than ``size``, up to each token."""
        at, where = np.arange(len(self.owner)), np.flatnonzero(self.slot == 0)
        never = 4 * len(at) + size
        nth = self.words[:-1] + literals - 1
        stop = np.maximum(np.append(where, never)[np.minimum(nth, len(where))] + 1, at + size)
        on = stop <= self.ends[self.owner]
        nth = self.words[1:] - literals
        begin = np.minimum(np.where(nth >= 0, np.append(where, 0)[np.maximum(nth, 0)], -1), at + 1 - size)
        upto = (begin >= self.starts[self.owner]) & (at + 1 - begin > size)
        return np.concatenate([at[on], begin[upto]]), np.concatenate([stop[on] - at[on], at[upto] + 1 - begin[upto]])

    def fixed(self, size: int, least: int, below: int) -> np.ndarray:
        """Where windows of ``size`` tokens start that have ``least`` words or more, and fewer than ``below``."""
        at = np.arange(max(0, len(self.owner) - size + 1))
        words = self.words[at + size] - self.words[at]
        return at[(at + size <= self.ends[self.owner[at]]) & (words >= least) & (words < below)]


def streams_of(texts: list[str | None], codes: Codes) -> list[Stream]:
    found = [TOKENS.findall(t) if t else [] for t in texts]
    counts = np.array([len(x) for x in found], np.int64)
    code = np.fromiter((c for x in found for c in map(codes.__getitem__, x)), np.int64, int(counts.sum()))
    owner = np.repeat(np.arange(len(texts)), counts)
    kind, value = code & 7, code >> 3
    first = np.ones(len(code), bool)
    first[1:] = owner[1:] != owner[:-1]
    before = np.full(len(code), MARK)
    before[1:] = kind[:-1]
    before[first] = MARK
    initial, title = before == MARK, kind == TITLE
    slot = np.where(kind == NUMBER, 1, np.where((kind == UNIT) & (before == NUMBER), 2, 0))
    keep = kind != MARK
    owner, value, initial, title, slot = (x[keep] for x in (owner, value, initial, title, slot))
    words, names = np.where(title & ~initial, 3, slot), np.where(title, 3, slot)
    return [Stream(r, len(texts), owner, value, s, initial) for r, s in ((WORDS, words), (NAMES, names), (VERBATIM, words))]


def item_windows(stream: Stream, params: TemplateParams):
    """(reading, starts, sizes) of the windows of benchmark items."""
    words = stream.words[stream.ends] - stream.words[stream.starts]
    short, poor = stream.tokens < params.window, words < params.literals
    if stream.reading == VERBATIM:
        at = stream.fixed(params.window, 0, params.literals)
        yield VERBATIM, at, np.full(len(at), params.window)
        numbers = np.bincount(stream.owner[stream.slot == 1], minlength=len(words))
        whole, reading = short & poor & ((stream.tokens >= params.shortest) | (numbers > 0)), VERBATIM
    else:
        yield stream.reading, *stream.windows(params.window, params.literals)
        whole, reading = (short | poor) & (words >= params.few) & (stream.tokens >= params.shortest), stream.reading + 3
    yield reading, stream.starts[whole], stream.tokens[whole]


def document_windows(stream: Stream, params: TemplateParams, sizes: dict[int, list[int]]):
    """(reading, starts, sizes) of the windows of documents that have a size that occurs in the benchmark."""
    if stream.reading == VERBATIM:
        for size in sizes.get(VERBATIM, ()):
            at = stream.fixed(size, 0, params.literals)
            yield VERBATIM, at, np.full(len(at), size)
        return
    known = sizes.get(stream.reading, ())
    if known:
        at, size = stream.windows(params.window, params.literals)
        fit = np.isin(size, known)
        yield stream.reading, at[fit], size[fit]
    for size in sizes.get(stream.reading + 3, ()):
        at = stream.fixed(size, params.few, params.literals if size >= params.window else size + 1)
        yield stream.reading + 3, at, np.full(len(at), size)


def window_rows(df: DataFrame, id_column: str, params: TemplateParams,
                sizes: dict[int, list[int]] | None = None, bits: np.ndarray | None = None) -> DataFrame:
    """One row a window of the benchmark or, with ``sizes`` and ``bits``, of documents: only windows that may occur in it."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(np.packbits(bits)) if bits is not None else None
    shift = np.uint64(64 - params.bits)

    def run(batches):
        codes = Codes()
        allowed = np.unpackbits(shared.value).view(bool) if shared is not None else None
        for batch in batches:
            streams = streams_of(batch.column("text").to_pylist(), codes)
            tokens = streams[VERBATIM].tokens
            for stream in streams:
                for reading, at, size in item_windows(stream, params) if sizes is None else document_windows(stream, params, sizes):
                    hashes = stream.hashes(at, size, reading)
                    if allowed is not None:
                        fit = allowed[(hashes >> shift).astype(np.int64)]
                        at, size, hashes = at[fit], size[fit], hashes[fit]
                    if not len(at):
                        continue
                    ends = np.cumsum(size)
                    places = np.repeat(at - ends + size, size) + np.arange(ends[-1])
                    held = (stream.slot[places] > 0) & (reading != VERBATIM)
                    offsets = np.concatenate([[0], np.concatenate([[0], np.cumsum(held)])[ends]]).astype(np.int32)
                    own, last = stream.owner[at], at + size - 1
                    yield pa.RecordBatch.from_arrays([
                        batch.column("id").take(pa.array(own)), pa.array(np.full(len(at), reading, np.int32)),
                        pa.array((at - stream.starts[own]).astype(np.int32)), pa.array(size.astype(np.int32)),
                        pa.array(hashes.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(stream.value[places[held]])),
                        pa.array(stream.raw[at].astype(np.int32)),
                        pa.array((stream.raw[last] + stream.spans[last] - stream.raw[at]).astype(np.int32)),
                        pa.array(tokens[own].astype(np.int32))],
                        names=["id", "reading", "pos", "size", "hash", "slots", "place", "span", "n_tokens"])

    small_batches(spark)
    return df.select(F.col(id_column).cast("long").alias("id"), "text").mapInArrow(run, SCHEMA)


def find_leaks(docs: DataFrame, benchmark: DataFrame, params: TemplateParams = TemplateParams()) -> DataFrame:
    """(doc_id, item_id, n_tokens, item_tokens, verbatim_tokens, share): what documents hold of items."""
    items = settle(window_rows(benchmark, "item_id", params))
    # At most 2 ** bits values, whatever the benchmark.
    used = items.select(F.shiftrightunsigned("hash", 64 - params.bits).cast("int").alias("slot")).distinct().toPandas()["slot"]
    bits = np.zeros(1 << params.bits, bool)
    bits[used.to_numpy(np.int64)] = True
    # No more sizes than an item can have tokens.
    sizes: dict[int, list[int]] = {}
    for r in items.select("reading", "size").distinct().orderBy("reading", "size").collect():
        sizes.setdefault(r["reading"], []).append(r["size"])
    hits = window_rows(docs, "doc_id", params, sizes, bits)
    d, i = hits.alias("d"), items.alias("i")
    paired = d.join(i, (F.col("d.hash") == F.col("i.hash")) & (F.col("d.size") == F.col("i.size"))
                    & (F.col("d.reading") == F.col("i.reading"))).select(
        F.col("d.id").alias("doc_id"), F.col("i.id").alias("item_id"), F.col("i.reading").alias("reading"), (F.col("d.pos") - F.col("i.pos")).alias("shift"),
        F.col("i.place").alias("pos"), F.col("i.span").alias("size"), F.col("i.n_tokens").alias("item_tokens"),
        (F.col("d.slots") == F.col("i.slots")).alias("same"),
        F.arrays_zip(F.col("i.slots").alias("item"), F.col("d.slots").alias("doc")).alias("slots"))
    # An alignment has at most as many windows as its item.
    aligned = paired.groupBy("doc_id", "item_id", "reading", "shift", "item_tokens").agg(
        F.collect_set(F.struct("pos", "size", "same")).alias("windows"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    one_each = F.size(F.array_distinct("slots.item")) == F.size("slots")

    def covered(column):
        return F.flatten(F.transform(column, lambda w: F.sequence(w["pos"], w["pos"] + w["size"] - 1)))

    counted = aligned.withColumn("fits", one_each).select(
        "doc_id", "item_id", "item_tokens",
        F.array_distinct(covered(F.filter("windows", lambda w: w["same"] | F.col("fits")))).alias("held"),
        F.array_distinct(covered(F.filter("windows", lambda w: w["same"]))).alias("verbatim"))
    # A text that repeats an item has an alignment a copy: places are counted, not alignments.
    places = counted.select("doc_id", "item_id", "item_tokens", "verbatim", F.explode("held").alias("place")).groupBy(
        "doc_id", "item_id", "item_tokens", "place").agg(F.max(F.array_contains("verbatim", F.col("place"))).alias("same"))
    return places.groupBy("doc_id", "item_id", "item_tokens").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum(F.col("same").cast("long")).alias("verbatim_tokens"),
    ).where(F.col("n_tokens") >= F.least(F.lit(params.tokens), F.col("item_tokens"))).select(
        "doc_id", "item_id", "n_tokens", F.col("item_tokens").cast("long").alias("item_tokens"), "verbatim_tokens",
        (F.col("n_tokens") / F.col("item_tokens")).alias("share"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, params: TemplateParams = TemplateParams()) -> DataFrame:
    """The documents, all columns, that hold no item of the benchmark.

    Rows are judged by id and text: other texts of an id, or without one, stay.
    """
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    leaks = settle(find_leaks(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, params).select(F.col("doc_id").alias(key)).distinct())
    return keyed.join(leaks, key, "left_anti").select(*docs.columns)
