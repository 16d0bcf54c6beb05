"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``window`` bytes in both directions, labels every byte and is
trained in numpy by backpropagation through time. A document's probabilities are the means of
its bytes' probabilities over the whole text.

Defined cases: a null text and a text without a letter get ``und`` and score 0. An empty table
gives an empty result; without a labelled row every text gets ``und``. Rows are kept as often
as they occur, extra columns are ignored, a null id counts as held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import crc_remainder, map_batches, text_buffers, unit_hash

UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, position_share double"


@dataclass(frozen=True)
class LanguageParams:
    #: Bound of the training sample: documents a language (expected number) and excerpts a document.
    documents_per_language: int = 700
    excerpts: int = 4
    hidden: int = 6
    window: int = 64
    steps: int = 300
    batch: int = 192
    rate: float = 0.02
    seed: int = 7
    fold: int = 5


class ByteNetwork:
    """Two gated recurrent layers (one a direction) and a linear labeller of positions.

    Gates are piecewise linear: clip(a + 0.5, 0, 1) for gates, clip(a, -1, 1) for candidates. A
    direction's update gate, reset gate and candidate are stacked, in this order, in the rows of
    one table of byte weights (with the biases) and one matrix of state weights.
    """

    def __init__(self, labels: list[str], hidden: int, seed: int):
        draw = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.weights: dict[str, np.ndarray] = {}
        bias = np.repeat([0.5, 0.5, 0.0], hidden)[:, None]
        for d in "fb":
            self.weights[f"{d}e"] = (draw.normal(0, 0.15, (3 * hidden, 256)) + bias).astype(np.float32)
            self.weights[f"{d}u"] = draw.normal(0, 0.6 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32)
            self.weights[f"{d}v"] = draw.normal(0, 0.3, (len(labels), hidden)).astype(np.float32)
        self.weights["c"] = np.zeros((len(labels), 1), np.float32)

    def _states(self, x: np.ndarray, d: str, keep: dict | None = None, real: np.ndarray | None = None) -> np.ndarray:
        """States after each byte, (window, hidden, texts).

        ``x`` is (window, texts), ``real`` the same with 1 for bytes of the text.
        """
        size, (steps, n) = self.hidden, x.shape
        byte_rows, state_rows = self.weights[f"{d}e"], self.weights[f"{d}u"]
        h, out = np.zeros((size, n), np.float32), np.empty((steps, size, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            from_byte = byte_rows.take(x[t], axis=1, mode="clip")
            a = state_rows @ h
            gates, candidate = a[:2 * size], a[2 * size:]
            gates += from_byte[:2 * size]
            if keep is not None:
                keep[d, t] = [h, gates.copy(), candidate.copy()]
            np.clip(gates, 0.0, 1.0, out=gates)
            candidate *= gates[size:]
            candidate += from_byte[2 * size:]
            if keep is not None:
                keep[d, t].append(candidate.copy())
            np.clip(candidate, -1.0, 1.0, out=candidate)
            new = out[t]
            np.subtract(h, candidate, out=new)
            new *= gates[:size]
            new += candidate
            if real is not None:
                new *= real[t]
            h = new
        return out

    def _softmax(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        p = self.weights["fv"] @ forward
        p += self.weights["bv"] @ backward
        p += self.weights["c"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def positions(self, x: np.ndarray, real: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of each position, (window, labels, texts)."""
        return self._softmax(self._states(x, "f", None, real), self._states(x, "b", None, real))

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradients; every position carries the label of its text."""
        w, size, (steps, n), keep = self.weights, self.hidden, x.shape, {}
        states = {d: self._states(x, d, keep) for d in "fb"}
        p = self._softmax(states["f"], states["b"])
        scale = (weight / (weight.sum() * steps)).astype(np.float32)
        loss = float(-(np.log(p[:, y, np.arange(n)] + 1e-9) * scale).sum())
        p[:, y, np.arange(n)] -= 1.0
        p *= scale
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["c"] = p.sum(axis=(0, 2))[:, None]
        for d in "fb":
            g[f"{d}v"] = np.einsum("tcn,thn->ch", p, states[d], optimize=True)
            through = w[f"{d}v"].T @ p
            back = np.zeros((size, n), np.float32)
            by_byte = np.empty((steps, 3 * size, n), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                h, gates, m, an = keep[d, t]
                z, r, c = np.clip(gates[:size], 0, 1), np.clip(gates[size:], 0, 1), np.clip(an, -1, 1)
                inside = (gates > 0) & (gates < 1)
                back = back + through[t]
                da = by_byte[t]
                dan = back * (1 - z) * (np.abs(an) < 1)
                da[:size] = back * (h - c) * inside[:size]
                da[size:2 * size] = dan * m * inside[size:]
                da[2 * size:] = dan * r
                g[f"{d}u"] += da @ h.T
                back = back * z + w[f"{d}u"].T @ da
                da[2 * size:] = dan
            flat = by_byte.transpose(1, 0, 2).reshape(3 * size, -1)
            codes = x.reshape(-1)
            for k in range(3 * size):
                g[f"{d}e"][k] = np.bincount(codes, flat[k], 256)
        return loss, g


def train(windows: np.ndarray, labels: np.ndarray, names: list[str], params: LanguageParams) -> ByteNetwork:
    """Fit by Adam; rare languages weigh as much as frequent ones. ``windows`` is (texts, window)."""
    net = ByteNetwork(names, params.hidden, params.seed)
    draw = np.random.default_rng(params.seed + 1)
    counts = np.bincount(labels, minlength=len(names))
    balance = (1.0 / np.maximum(counts, 1))[labels]
    balance /= balance.mean()
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, params.steps + 1):
        pick = draw.integers(0, len(labels), min(params.batch, max(1, len(labels))))
        _, grads = net.gradients(np.ascontiguousarray(windows[pick].T), labels[pick], balance[pick])
        norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
        rate = params.rate * min(1.0, 1.0 / (norm + 1e-9)) * (1 - 0.9 * step / params.steps)
        for k, v in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            net.weights[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def training_windows(docs: DataFrame, params: LanguageParams) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Byte windows at hashed places of a bounded sample of labelled documents."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
                       & (crc_remainder("doc_id", params.fold) != 0))
    # One row a language: a language code has few values.
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    names = sorted(counts)
    if not names:
        return np.zeros((0, params.window), np.uint8), np.zeros(0, np.int64), []
    share = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(params.documents_per_language / counts[k]))])
    length = F.greatest(F.length("text") - params.window, F.lit(1))
    excerpts = F.array(*[
        F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(i)), length) + 1).cast("int"), F.lit(params.window))
        for i in range(params.excerpts)])
    # An id teaches once a language, by the text of the smallest hash, however many rows it has.
    chosen = known.where(unit_hash("doc_id", F.lit("language")) < share[F.col("lang")]).groupBy("doc_id", "lang").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = chosen.select("doc_id", "lang", F.explode(excerpts).alias("part")).collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["part"]))
    windows, labels = np.zeros((len(rows), params.window), np.uint8), np.zeros(len(rows), np.int64)
    for i, row in enumerate(rows):
        data = np.frombuffer(row["part"].encode(), np.uint8)
        windows[i] = np.resize(data, params.window) if len(data) else 32
        labels[i] = names.index(row["lang"])
    return windows, labels, names


def label_texts(net: ByteNetwork, data: np.ndarray, starts: np.ndarray, window: int,
                block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Mean position probabilities and label counts of each text, (texts, labels) both."""
    texts, sizes = len(starts) - 1, np.diff(starts)
    pooled, votes = np.zeros((texts, len(net.labels))), np.zeros((texts, len(net.labels)))
    pieces = -(-sizes // window)
    owner = np.repeat(np.arange(texts), pieces)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, length = starts[owner] + inside * window, np.minimum(window, sizes[owner] - inside * window)
    for full in (True, False):
        chosen = np.flatnonzero((length == window) == full)
        for at in range(0, len(chosen), block):
            part = chosen[at:at + block]
            steps = np.arange(window if full else int(length[part].max()))[:, None]
            if full:
                x, real = data[begin[part] + steps], None
            else:
                real = (steps < length[part]).astype(np.float32)
                x = data[np.minimum(begin[part] + steps, len(data) - 1)]
            p = net.positions(x, real)
            best = p == p.max(axis=1, keepdims=True)
            if real is not None:
                p, best = p * real[:, None], best & (real[:, None] > 0)
            np.add.at(pooled, owner[part], p.sum(axis=0).T)
            np.add.at(votes, owner[part], best.sum(axis=0).T)
    return pooled / np.maximum(sizes, 1)[:, None], votes / np.maximum(sizes, 1)[:, None]


def identify(docs: DataFrame, net: ByteNetwork | None, params: LanguageParams) -> DataFrame:
    """Label every whole text. The network is a few tens of KB, whatever the corpus."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", (crc_remainder("doc_id", params.fold) == 0).alias("held_out"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        lettered = np.array(batch.column("lettered").to_pylist(), bool)
        names, scores, shares = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        if net is not None:
            data, starts = text_buffers(batch.column("text"))
            pooled, votes = label_texts(net, data, starts, params.window)
            best = pooled.argmax(axis=1)
            line = np.arange(len(best))
            names = [net.labels[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
            scores = np.where(lettered, np.clip(pooled[line, best], 0, 1), 0.0)
            shares = np.where(lettered, np.clip(votes[line, best], 0, 1), 0.0)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()),
             pa.array(scores), pa.array(shares)],
            names=["doc_id", "held_out", "lang_pred", "score", "position_share"])

    return map_batches(rows, score, SCHEMA)


def language_id(docs: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """Train on the rows that are not held out and label all rows."""
    windows, labels, names = training_windows(docs, params)
    return identify(docs, train(windows, labels, names, params) if names else None, params)
