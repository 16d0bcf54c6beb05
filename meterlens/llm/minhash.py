"""Near-duplicates by MinHash: universal hash minima, banding, verified links, alternating stars.

A document's set is its distinct 4-word shingles (with fewer words, the whole sequence). Documents
link if 100 times the intersection of their sets is at least ``percent`` times the union, and a
component is what links reach.

1. ``HASHES`` universal hashes ``a * x + b mod 2 ** 64`` of the shingles' XXH64 are taken over the
   whole set; their minima are the signature, cut in ``BANDS`` bands of ``ROWS`` minima.
2. Documents of one set (two 64-bit hashes over it) are one class. Classes meet by band.
3. Stars: in every band each class is paired with the band's smallest class, then with the band's
   largest if it is not yet in the same component. That is linear in a band's size and joins
   nearly all there is to join.
4. A pair survives if sizes allow the similarity and ``AGREE`` minima agree; survivors are then
   confirmed on the full sets, made from the whole texts of both.
5. The rest: classes in bands that still hold several components. One of whose shingles too few
   stand in any other such set cannot link; that is counted exactly and takes most of them out. In the
   bands that are left every two classes of different components are compared by size, signature
   and full set, in the first band that they share, in pieces of ``MEET`` classes, two pieces a
   task. Pairs of one component say nothing new. A task gives links that span, not all pairs.

Two sets of similarity 0.8 share a band but once in 2e7 pairs, and fail ``AGREE`` but once in 1e8;
more similar ones less often. Components are found by large-star and small-star.

Defined cases: null texts and texts without a word have an empty set and link with nothing; a null
id counts as the smallest id and stays null in the result; other texts of an id are documents of
their own; rows are kept as often as they occur; an empty table gives no rows; extra columns are
ignored. Very long texts are hashed whole, in slices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import map_batches, small_batches, whole_groups
from meterlens.llm.graph import components
from meterlens.session import settle

HASHES, BANDS, ROWS, AGREE, MEET, NO_ID = 128, 32, 4, 75, 2048, -(1 << 63)
BIT_BYTES = 64 << 20
SLICE = 2048
FACTORS, SHIFTS = np.random.default_rng(128).integers(0, (1 << 64) - 1, (2, HASHES, 1), np.uint64)
FACTORS |= np.uint64(1)
MARK = "doc_id long, key long, n long, hi long, lo long, signature binary, bands array<long>"


def shingles(text: str | None, words: int) -> list[bytes]:
    """All shingles, repeats included; only A-Z are lower-cased, words are cut at ASCII blanks."""
    found = text.encode().lower().split() if text else []
    if not found:
        return []
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]).tolist()
    span = min(words, len(found))
    return [joined[a:b - 1] for a, b in zip([0, *ends], ends[span - 1:])]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The upper halves of the smallest value of each hash function over the set."""
    least = np.full(HASHES, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), SLICE):
        least = np.minimum(least, (hashes[at:at + SLICE] * FACTORS + SHIFTS).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def marked(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, n, hi, lo, signature, bands) of every row: a hash of the text, the set's size and hashes, minima, and bands' hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").to_pylist():
            digest = xxhash.xxh64_intdigest
            hashes = np.unique(np.array([digest(s, 42) for s in shingles(text, words)], np.uint64))
            if not len(hashes):
                rows.append((0, 0, 0, None, None))
                continue
            whole, minima = hashes.tobytes(), signature(hashes)
            bands = [digest(minima[k:k + ROWS].tobytes(), k) for k in range(0, HASHES, ROWS)]
            hi, lo, *bands = np.array([digest(whole, 1), digest(whole, 2), *bands], np.uint64).view(np.int64).tolist()
            rows.append((len(hashes), hi, lo, minima.astype(np.uint16).tobytes(), bands))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                                          names=["doc_id", "key", "n", "hi", "lo", "signature", "bands"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("key")), run, MARK)


def sizes_allow(percent: int):
    """Sets whose sizes differ more cannot be similar enough."""
    return F.lit(100) * F.least("n", "other_n") >= F.lit(percent) * F.greatest("n", "other_n")


def agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left == right).sum(axis=-1)


def signed(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES)


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of which ``AGREE`` minima agree."""
    both = pairs.join(classes.select(F.col("node").alias("a"), F.col("signature").alias("left")), "a").join(
        classes.select(F.col("node").alias("b"), F.col("signature").alias("right")), "b").select("a", "b", "left", "right")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = agreeing(signed(batch.column("left")), signed(batch.column("right"))) >= AGREE
        return batch.select(["a", "b"]).filter(pa.array(near))

    return map_batches(both, run, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets, made from the texts of both, are similar enough."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b").select("a", "b", "left", "right")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        near, last, kept = [], None, set()
        for a, left, right in zip(*(batch.column(c).to_pylist() for c in ("a", "left", "right"))):
            if a != last:
                last, kept = a, set(shingles(left, words))
            other = set(shingles(right, words))
            common = len(kept & other)
            near.append(100 * common >= percent * (len(kept) + len(other) - common))
        return batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return map_batches(both, run, "a long, b long")


def labelled(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that the edges reach."""
    return settle(classes.select("node").join(components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("label")))


def star_pairs(banded: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """Each class of a band (band, place, node, n, label) with the band's pivot, if that is of another component."""
    other = pivots.select("band", F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("label").alias("other_label"))
    return banded.join(other, "band").where(F.col("label") != F.col("other_label")).where(sizes_allow(percent)).select(
        F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def covered(sets: DataFrame, percent: int) -> DataFrame:
    """Nodes of which enough shingles also stand in another set; others can link with nothing."""
    listed = sets.select("node", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    common = listed.groupBy("gram").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1").select("gram")
    return listed.join(common, "gram").groupBy("node", "n").agg(F.count(F.lit(1)).alias("common")).where(
        F.lit(100) * F.col("common") >= F.lit(percent) * F.col("n")).select("node")


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """(node, grams): the hashes of the set of each text, sorted."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(t, words)], np.uint64)).view(np.int64)
                for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "grams"])

    return map_batches(texts.select("node", "text"), run, "node long, grams array<long>")


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between members and the smallest of their group that join what the links (left, right) join."""
    group = np.arange(n)
    while len(left):
        low = np.minimum(group[left], group[right])
        np.minimum.at(group, group[left], low)
        np.minimum.at(group, group[right], low)
        while (group[group] != group).any():
            group = group[group]
        new = group[left] != group[right]
        left, right = left[new], right[new]
    other = np.flatnonzero(group != np.arange(n))
    return group[other], other


class Sets:
    """Exact intersections of the sets of one meeting place, by bit sets of their common shingles where those fit."""

    def __init__(self, grams: list[np.ndarray]):
        self.grams, self.bits = grams, None
        codes, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *grams]), return_counts=True)
        codes = codes[counts > 1]
        words = -(-len(codes) // 64)
        if len(grams) * words * 8 <= BIT_BYTES:
            self.bits = np.zeros((len(grams), words), np.uint64)
            for row, own in zip(self.bits, grams):
                place = np.searchsorted(codes, own)
                place = place[(place < len(codes)) & (codes[np.minimum(place, len(codes) - 1)] == own)] if len(codes) else place[:0]
                np.bitwise_or.at(row, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.array([len(np.intersect1d(self.grams[a], self.grams[b], assume_unique=True)) for a, b in zip(x.tolist(), y.tolist())], np.int64)
        step = max(1, (1 << 20) // max(1, self.bits.shape[1]))
        parts = [np.bitwise_count(self.bits[x[at:at + step]] & self.bits[y[at:at + step]]).sum(axis=1, dtype=np.int64)
                 for at in range(0, len(x), step)]
        return np.concatenate([np.zeros(0, np.int64), *parts])


def other_links(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join whatever the links between classes of different components join.

    members: (band, place, node, n, label), place being the band's number. A pair is compared in the first
    band that both share: by sizes, by signature, then by the sets themselves.
    """
    mixed = members.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("low"), F.max("label").alias("high")).where(
        "low != high").select("band", F.ceil(F.col("members") / MEET).cast("int").alias("pieces"))
    placed = members.join(mixed, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    units = placed.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
        "band", "place", F.least("own", "partner").alias("i"), F.greatest("own", "partner").alias("j"), "own", "node", "n", "label")
    carried = classes.select("node", "signature").join(sets, "node")
    dealt = units.join(carried, "node").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")

    def run(batches):
        for batch, starts in whole_groups(batches, ["band", "i", "j"]):
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                found = links_of(batch.slice(s, e - s))
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b"])

    def links_of(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        node, n, label, own = (np.asarray(group.column(c)) for c in ("node", "n", "label", "own"))
        before = group.column("place")[0].as_py() * ROWS
        across = group.column("i")[0] != group.column("j")[0]
        minima, sets = signed(group.column("signature")), None
        pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(node), 64):
            left, right = np.arange(at, min(len(node), at + 64))[:, None], np.arange(at, len(node))[None, :]
            keep = (right > left) & (label[left] != label[right]) & (100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right]))
            if across:
                keep &= own[left] != own[right]
            left, right = np.nonzero(keep)
            for cut in range(0, len(left), 1 << 14):
                x, y = at + left[cut:cut + (1 << 14)], at + right[cut:cut + (1 << 14)]
                same = minima[x] == minima[y]
                near = same.sum(axis=1) >= AGREE
                if before:
                    near &= ~same[:, :before].reshape(len(x), -1, ROWS).all(axis=2).any(axis=1)
                x, y = x[near], y[near]
                if len(x):
                    sets = sets or Sets([np.asarray(g.values, np.int64) for g in group.column("grams")])
                    common = sets.common(x, y)
                    linked = 100 * common >= percent * (n[x] + n[y] - common)
                    pairs[0].append(x[linked])
                    pairs[1].append(y[linked])
        low, high = spanning(len(node), np.concatenate(pairs[0]), np.concatenate(pairs[1]))
        return node[low], node[high]

    small_batches(members.sparkSession)
    return dealt.mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, least) of every row: its set's size and its component's smallest id (NO_ID for null); an empty set has no component."""
    marks = settle(marked(docs, words))
    classes = marks.where("n > 0").groupBy("hi", "lo").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "key")).alias("first"), F.first("n").alias("n"),
        F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()))
    banded = classes.select("node", "n", F.posexplode("bands").alias("place", "band"))
    shared = settle(banded.groupBy("band").agg(F.min(F.struct("node", "n")).alias("low"), F.max(F.struct("node", "n")).alias("high")).where(
        "low.node != high.node"))
    members = settle(banded.join(shared.select("band"), "band"))
    wanted = classes.join(members.select("node").distinct(), "node").select("node", F.col("first.id").alias("id"), "first.key")
    texts = settle(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("key"), "text").join(
        wanted, ["id", "key"]).groupBy("node").agg(F.first("text").alias("text")))

    labels, edges, tested = classes.select("node", F.col("node").alias("label")), None, None
    for end in ("low", "high"):
        pivots = shared.select("band", f"{end}.*").join(labels, "node")
        pairs = star_pairs(members.join(labels, "node"), pivots, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        tested = settle(verified(pairs, classes))
        new = settle(confirmed(tested, texts, words, percent))
        edges = new if edges is None else edges.unionByName(new)
        labels = labelled(classes, edges)
    now = members.join(labels, "node")
    mixed = now.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("band")
    left = settle(now.join(mixed, "band"))
    sets = settle(sets_of(texts.join(left.select("node").distinct(), "node"), words))
    open_nodes = settle(covered(sets, percent))
    last = settle(other_links(left.join(open_nodes, "node"), classes, sets.join(open_nodes, "node"), percent))
    labels = labelled(classes, edges.unionByName(last))
    firsts = classes.join(labels, "node").groupBy("label").agg(F.min("first.id").alias("least"))
    named = settle(classes.join(labels, "node").join(firsts, "label").select("hi", "lo", "least"))
    return marks.select("doc_id", "key", "n", "hi", "lo").join(named, ["hi", "lo"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("least")).alias("least"))


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; kept: it is its component's smallest id."""
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.nullif("least", F.lit(NO_ID)))
    return grouped(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]) END AS s FROM worded),
single AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM single x JOIN single y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
edges AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
least AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM sizes LEFT JOIN least ON a = doc_id
"""
