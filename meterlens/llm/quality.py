"""Quality classifier: random-indexing word vectors pooled by document, then a two-layer network.

Tokens are words, runs of marks, and words in capitals, hashed to ``buckets``. Every bucket has a
sparse random index vector; a bucket's word vector sums the index vectors of its neighbours over
all documents. A document is pooled to mean and spread of its word vectors (frequent words weigh
less), its length and its shares of distinct tokens and pairs. A network of two layers, trained
in numpy on a bounded sample of labelled rows, scores it; one temperature, fitted on rows held
back from training, calibrates the probabilities.

Defined cases: a text without tokens (null and empty ones too) is pooled to zeros and scored like
any other; without rows of both labels every score is the rate of the label, 0 without any. Rows
are kept as often as they occur; of repeated labels the largest counts; a null label or id teaches
nothing; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import crc_remainder, map_batches, small_batches, unit_hash

TOKENS = re.compile(r"[^\W_]+|[^\w\s]+")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
SLICE = 512


@dataclass(frozen=True)
class QualityParams:
    buckets: int = 8192
    size: int = 48
    ones: int = 3
    reach: int = 2
    #: Bound of the training sample: documents a label (expected number).
    examples: int = 2500
    hidden: int = 24
    epochs: int = 60
    rate: float = 0.005
    seed: int = 5
    threshold: float = 0.3
    fold: int = 5


class Buckets(dict):
    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, token: str) -> int:
        shown = token.lower() + ("^" if len(token) > 1 and token.isupper() else "")
        found = xxhash.xxh64_intdigest(shown, 11) % self.n
        if len(self) > 500_000:
            self.clear()
        if len(token) <= 64:
            self[token] = found
        return found


def coded(texts: list[str | None], buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all tokens, and the number of tokens of each text."""
    found = [TOKENS.findall(t) if t else [] for t in texts]
    counts = np.array([len(x) for x in found], np.int64)
    return np.fromiter(map(buckets.__getitem__, chain.from_iterable(found)), np.int64, int(counts.sum())), counts


def index_vectors(params: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few entries of each bucket's index vector."""
    draw = np.random.default_rng(params.seed)
    places = np.argsort(draw.random((params.buckets, params.size)), axis=1)[:, :params.ones]
    return places, draw.choice(np.array([-1.0, 1.0]), places.shape)


def context_sums(docs: DataFrame, params: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """Word vectors and counts of all buckets over all documents.

    A task adds up its own texts; the sums of tasks are added slice by slice, in as many tasks as
    there are slices, one at a time. The result is of fixed size.
    """
    spark, width = docs.sparkSession, params.size + 1

    def gather(batches):
        buckets, (places, signs) = Buckets(params.buckets), index_vectors(params)
        total = np.zeros(params.buckets * width)
        seen = False
        for batch in batches:
            codes, counts = coded(batch.column("text").to_pylist(), buckets)
            owner = np.repeat(np.arange(len(counts)), counts)
            seen = seen or len(codes) > 0
            total[params.size::width] += np.bincount(codes, minlength=params.buckets)
            for step in range(1, params.reach + 1):
                same = owner[step:] == owner[:-step] if len(codes) > step else np.zeros(0, bool)
                left, right = codes[:len(same)][same], codes[step:step + len(same)][same]
                for word, near in ((left, right), (right, left)):
                    flat = (word * width)[:, None] + places[near]
                    total += np.bincount(flat.ravel(), signs[near].ravel(), params.buckets * width)
        if seen:
            rows = total.astype(np.float32).reshape(-1, SLICE * width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(rows)), pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["slice", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist()):
                part = np.frombuffer(data, np.float32).astype(np.float64)
                sums[k] = sums[k] + part if k in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["slice", "sums"])

    small_batches(spark)
    parts = docs.select("text").mapInArrow(gather, "slice long, sums binary")
    summed = parts.repartition(params.buckets // SLICE, "slice").mapInArrow(add, "slice long, sums binary")
    table = np.zeros((params.buckets // SLICE, SLICE * width))
    for row in summed.collect():
        table[row["slice"]] += np.frombuffer(row["sums"], np.float64)
    table = table.reshape(params.buckets, width)
    return table[:, :-1], table[:, -1]


def word_vectors(sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors without the part that all words share, of length 1, and the words' weights."""
    vectors = sums / np.maximum(counts, 1)[:, None]
    if counts.sum():
        vectors -= (vectors * counts[:, None]).sum(axis=0) / counts.sum()
    length = np.sqrt((vectors * vectors).sum(axis=1))
    vectors = vectors / np.maximum(length, 1e-9)[:, None]
    share = counts / max(counts.sum(), 1)
    return vectors.astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32)


def pooled(texts: list[str | None], buckets: Buckets, vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row a text."""
    codes, counts = coded(texts, buckets)
    size = vectors.shape[1]
    out = np.zeros((len(texts), 2 * size + 3))
    held = np.flatnonzero(counts)
    if len(held):
        n = counts[held]
        owner = np.repeat(np.arange(len(held)), n)
        # A bucket of a text is taken once and counts as often as it occurs; a row a dimension, so that sums run along memory.
        of, code, times = distinct(owner, codes)
        sizes = np.bincount(of, minlength=len(held))
        starts = np.cumsum(sizes) - sizes
        w = weights[code]
        mass = np.add.reduceat(w.astype(np.float64) * times, starts)[:, None]
        taken = np.take(np.ascontiguousarray(vectors.T), code, axis=1)
        weighed = taken * w
        mean = np.add.reduceat(weighed.astype(np.float64) * times, starts, axis=1).T / mass
        weighed *= taken
        square = np.add.reduceat(weighed.astype(np.float64) * times, starts, axis=1).T / mass
        pair = np.zeros(len(codes), np.int64)
        pair[:-1] = codes[:-1] * len(vectors) + codes[1:]
        out[held, :size] = mean
        out[held, size:2 * size] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[held, -3] = np.log1p(n)
        out[held, -2] = sizes / n
        out[held, -1] = np.bincount(distinct(owner, pair)[0], minlength=len(held)) / n
    return out


def distinct(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, value, occurrences) of each owner's different values, in order; values under 2**31 sort as one number with their owner."""
    key = np.sort((owner << 31) | values)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first] >> 31, key[first] & ((1 << 31) - 1), np.diff(first, append=len(key))


class QualityNetwork:
    """Two layers with a temperature; ``constant`` where there is nothing to learn."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, params: QualityParams):
        self.constant = float((y * weight).sum() / weight.sum()) if len(y) else 0.0
        if not len(y) or y.min() == y.max():
            return
        self.constant = None
        draw = np.random.default_rng(params.seed)
        self.center, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = self.standard(x)
        order = draw.permutation(len(y))
        back, train = order[:len(y) // 5], order[len(y) // 5:]
        self.layers = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], params.hidden)), np.zeros(params.hidden),
                       draw.normal(0, 1 / np.sqrt(params.hidden), params.hidden), np.zeros(1)]
        self.temperature = 1.0
        first, second, step = [np.zeros_like(p) for p in self.layers], [np.zeros_like(p) for p in self.layers], 0
        for epoch in range(params.epochs):
            for at in np.array_split(draw.permutation(train), max(1, len(train) // 64)):
                step += 1
                a, b, c, d = self.layers
                h = np.tanh(x[at] @ a + b)
                error = (1 / (1 + np.exp(-(h @ c + d[0]))) - y[at]) * weight[at] / weight[at].sum()
                dh = error[:, None] * c * (1 - h * h)
                grads = [x[at].T @ dh + 1e-4 * a, dh.sum(axis=0), h.T @ error + 1e-4 * c, np.array([error.sum()])]
                rate = params.rate * (1 - 0.9 * epoch / params.epochs)
                for i, g in enumerate(grads):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.layers[i] = self.layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        logits = self.logits(x[back])

        def loss(t):
            p = np.clip(1 / (1 + np.exp(-np.clip(logits / t, -40, 40))), 1e-9, 1 - 1e-9)
            return -(weight[back] * (y[back] * np.log(p) + (1 - y[back]) * np.log(1 - p))).sum()

        if len(back):
            self.temperature = float(min(np.geomspace(0.3, 6, 60), key=loss))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -6, 6)

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(x @ a + b) @ c + d[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.standard(x)) / self.temperature, -40, 40)))


def training_rows(docs: DataFrame, labels: DataFrame, vectors, weights, params: QualityParams):
    """Pooled rows, labels and weights of a bounded sample."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()
                         & (crc_remainder("doc_id", params.fold) != 0)).groupBy("doc_id").agg(
        F.max(F.col("quality").cast("long")).alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not counts:
        return np.zeros((0, 2 * params.size + 3)), np.zeros(0), np.zeros(0)
    share = F.when(F.col("quality") == 1, params.examples / counts.get(1, 1)).otherwise(params.examples / counts.get(0, 1))
    # Four times a label's number at most, whatever the table: 10,000 ids.
    chosen = (known.where(unit_hash("doc_id", F.lit("quality")) < share)
              .orderBy(F.xxhash64("doc_id", F.lit("order"))).limit(4 * params.examples))
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    # An id teaches once, by the text of the smallest hash, however many rows it has.
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def pool(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pooled(batch.column("text").to_pylist(), Buckets(params.buckets), vectors, weights)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array(list(found), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    # The sample's rows, each of fixed size.
    found = sorted(map_batches(rows.select("doc_id", "quality", "text"), pool, "doc_id long, quality long, x array<double>").collect())
    y = np.array([r["quality"] for r in found], float)
    stands_for = np.array([max(1.0, counts[r["quality"]] / params.examples) for r in found])
    return np.array([r["x"] for r in found]).reshape(len(found), 2 * params.size + 3), y, stands_for


def quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Learn word vectors from all texts, the network from labelled rows, and score every whole text."""
    vectors, weights = word_vectors(*context_sums(docs, params))
    net = QualityNetwork(*training_rows(docs, labels, vectors, weights, params), params)
    kept: dict[int, Buckets] = {}

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        buckets = kept.setdefault(0, Buckets(params.buckets))
        scores = net.scores(pooled(batch.column("text").to_pylist(), buckets, vectors, weights))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
             pa.array((scores >= params.threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = (crc_remainder("doc_id", params.fold) == 0).alias("held_out")
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", held), score, SCHEMA)
