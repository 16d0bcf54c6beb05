"""Toxicity by the nearest labelled examples under TF-IDF cosine, from a block-max inverted index.

Features are words and word beginnings: all that occur in a bounded sample of labelled documents,
whichever label they go with. Inverse document frequencies come from all documents; a term that
goes with a label, either one, counts more by the logarithm of its likelihood ratio. The examples'
vectors lie in an inverted index cut in blocks of similar examples: terms that most examples carry stand
in one table, those of many in plain postings, the others have, for each block, their largest weight and their
postings. The first two give partial scores of all examples; the rarer terms bound every block by those maxima. Blocks whose
bound is below the ``neighbours``-th partial score are skipped, the others scored. What then
reaches that score is scored again in full precision, so the neighbours found are the exact ones. Votes weigh by similarity; a logistic curve, fitted on examples that are judged
without themselves, turns the vote into a probability. The neighbours are the evidence.

Very long texts are read whole; an id of several texts teaches by one of them.

Defined cases: a text without any term of the examples (null and empty ones too) gets the rate among
such examples, drawn to the score of a text without a toxic neighbour; without a row of each label
every score is 0. Rows are kept as often as they occur; repeated labels of a document count once,
toxic if one says so; a null label or id teaches nothing; extra columns are ignored. Neighbours
that tie come by smaller id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import ROWS_PER_BATCH, crc_remainder, give_back, map_batches, mixed_array, small_batches, unit_hash

WORDS = re.compile(r"[^\W\d_]+")
BEGINNINGS, NOTHING, HYPHEN = (4, 5, 6), pa.scalar("", pa.large_string()), pa.scalar("-", pa.large_string())
#: Terms in the table, terms in it or scanned, texts searched at a time, and more than low precision can be wrong by.
TABLED, SCANNED, TOGETHER, MARGIN = 2048, 32768, 512, 1e-4
#: Places in a word that are told apart, bits of the slots of the terms' hashes, and characters whose words are looked up at a time.
LONGEST, SLOTS, CHARACTERS = 256, 20, 1 << 19
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, neighbours array<long>, similarities array<double>"


@dataclass(frozen=True)
class ToxicityParams:
    #: Bounds of the sample of labelled documents, by label (expected numbers).
    toxic_examples: int = 2000
    clean_examples: int = 4000
    neighbours: int = 15
    block: int = 16
    doubt: float = 0.25
    threshold: float = 0.7
    fold: int = 3
    held_out: int = 1


def features(words: pa.Array) -> list[pa.Array]:
    """For each word itself and its beginnings; null where a word is no longer than the beginning."""
    size = pc.utf8_length(words)
    return [words, *[pc.if_else(pc.greater(size, k), pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, k), NOTHING, HYPHEN), None)
                     for k in BEGINNINGS]]


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """A number drawn for each character, 0 for what no word holds, and an odd one for each place in a word (the last: all later)."""
    numbers = np.zeros(0x110000, np.uint64)
    for at in range(0, len(numbers), 1 << 14):
        some = mixed_array(np.arange(at, at + (1 << 14), dtype=np.uint64)) | np.uint64(1)
        for run in WORDS.finditer("".join(map(chr, range(at, at + (1 << 14))))):
            own = slice(at + run.start(), at + run.end())
            numbers[own] = some[run.start():run.end()]
    return numbers, mixed_array(np.arange(1 << 32, (1 << 32) + LONGEST, dtype=np.uint64)) | np.uint64(1)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words in lower case: the number of the text of each, and for words and each of their beginnings (numbers of words, 64-bit hashes)."""
    drawn, places = letters()
    low = [t.lower() for t in texts]
    numbers = drawn[np.frombuffer("\n".join(low).encode("utf-32-le"), np.uint32)]
    inside = numbers != 0
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), starts, "right")
    numbers, first = numbers[inside], np.cumsum(sizes) - sizes
    place = np.arange(len(numbers)) - np.repeat(first, sizes)
    numbers *= places[np.minimum(place, LONGEST - 1, out=place)]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(numbers, dtype=np.uint64)])
    found = [(np.arange(len(sizes)), sums[first + sizes] - sums[first])]
    for k in BEGINNINGS:
        longer = np.flatnonzero(sizes > k)
        found.append((longer, sums[first[longer] + k] - sums[first[longer]] + beginning_mark(k)))
    return text, found


def beginning_mark(k: int) -> np.uint64:
    """What a beginning of k letters has more than the word of these letters."""
    return mixed_array(np.full(1, (1 << 33) + k, np.uint64))[0]


class Terms:
    """Numbers of terms, looked up for all words of some texts at a time, by 64-bit hashes of their letters."""

    def __init__(self, terms: pa.Array):
        self.terms = terms

    def __len__(self) -> int:
        return len(self.terms)

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the terms in order, the terms' numbers, and where each slot of the hashes' first bits starts."""
        hashes = np.zeros(len(self.terms), np.uint64)
        for at in range(0, len(self.terms), 1 << 16):
            some = self.terms.slice(at, 1 << 16).to_pylist()
            number, parts = word_hashes(some)
            hashes[at + number] = parts[0][1]
            for k in BEGINNINGS:
                marked = [at + i for i, t in enumerate(some) if len(t) == k + 1 and t[-1] == "-"]
                hashes[marked] += beginning_mark(k)
        order = np.argsort(hashes, kind="stable")
        slots = (hashes[order] >> np.uint64(64 - SLOTS)).astype(np.int64)
        return hashes[order], order.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(slots, minlength=1 << SLOTS))]).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the term of each hash, or -1."""
        known, number, first = self.table
        slot = (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)
        at, end = first[slot], first[slot + 1]
        found, left = np.full(len(hashes), -1, np.int64), np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            same = known[here] == hashes[left]
            found[left[same]] = number[here[same]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return found

    def counts(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Terms of each text in order, and how often each occurs."""
        out, some, size = [], [], 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size >= CHARACTERS:
                out += self._counts(some)
                some, size = [], 0
        return out + self._counts(some) if some else out

    def _counts(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        text, parts = word_hashes(texts)
        terms = self.find(np.concatenate([hashes for _, hashes in parts]))
        keys = (text[np.concatenate([word for word, _ in parts])] * len(self.terms) + terms)[terms >= 0]
        keys, counts = np.unique(keys, return_counts=True)
        ends = np.searchsorted(keys, np.arange(1, len(texts) + 1) * len(self.terms))
        return [(k - i * len(self.terms), c) for i, (k, c) in enumerate(zip(np.split(keys, ends[:-1]), np.split(counts, ends[:-1])))]


def vector(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weights = (1 + np.log(counts)) * idf[terms]
    length = np.sqrt((weights * weights).sum())
    return terms, weights / length if length else weights


class BlockMaxIndex:
    """The examples' vectors: by example, by term and block with the block's largest weight, and the most frequent terms as a table."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: list[int], n_terms: int, block: int):
        starts = np.concatenate([[0], np.cumsum([len(t) for t, _ in vectors], dtype=np.int64)]).astype(np.int64)
        terms = np.concatenate([np.zeros(0, np.int32), *[t.astype(np.int32) for t, _ in vectors]])
        weights = np.concatenate([np.zeros(0), *[w for _, w in vectors]])
        #: Place of each example, alike ones side by side, so that the maxima of a block are near its weights.
        order = alike(starts, terms, weights, n_terms, block)
        self.numbers, self.ids = order, np.array(ids, np.int64)[order]
        sizes = np.diff(starts)[order]
        ends = np.cumsum(sizes)
        spread = np.repeat(starts[order] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        self.starts, self.terms, self.weights = np.concatenate([[0], ends]), terms[spread], weights[spread]
        self.n_terms, self.block = n_terms, block
        self.blocks_seen = self.blocks_scored = 0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The examples' terms and weights by number, as views."""
        place = np.empty(len(self.numbers), np.int64)
        place[self.numbers] = np.arange(len(place))
        return [(self.terms[self.starts[p]:self.starts[p + 1]], self.weights[self.starts[p]:self.starts[p + 1]]) for p in place]

    @cached_property
    def tables(self):
        made = self._tables()
        give_back()
        return made

    def _tables(self):
        """Place of each term in the table (-1: scanned, -2: rarer) and the table; the scanned terms' postings; where each
        rarer term's blocks start, with their numbers, largest weights and where their postings start; and those postings.
        """
        frequency = np.bincount(self.terms, minlength=self.n_terms)
        by_frequency = np.argsort(-frequency, kind="stable")
        often = by_frequency[:TABLED]
        place = np.full(self.n_terms, -2, np.int32)
        place[by_frequency[TABLED:SCANNED]] = -1
        place[often] = np.arange(len(often))
        blocks = -(-len(self.ids) // self.block)
        table = np.zeros((len(often), blocks * self.block), np.float32)
        scanned, rest = [], []
        # Some examples at a time, as what is made on the way would be larger than the tables.
        for at in range(0, len(self.ids), 256):
            starts = self.starts[at:at + 257]
            terms, weights = self.terms[starts[0]:starts[-1]], self.weights[starts[0]:starts[-1]].astype(np.float32)
            owner, own = np.repeat(np.arange(at, at + len(starts) - 1, dtype=np.int32), np.diff(starts)), place[terms]
            tabled = own >= 0
            table[own[tabled], owner[tabled]] = weights[tabled]
            for parts, mark in ((scanned, -1), (rest, -2)):
                parts.append(tuple(x[own == mark] for x in (terms, owner, weights)))
        (terms, owner, weights), (rare, rare_owner, rare_weights) = ([np.concatenate(x) for x in zip(*parts)] for parts in (scanned, rest))
        del scanned, rest, parts
        order = np.argsort(terms, kind="stable").astype(np.int32)
        # A posting is one number, the bits of its weight above its owner.
        posted = np.stack([owner[order], weights[order].view(np.int32)], axis=1).astype("<i4", copy=False)
        scan = np.concatenate([[0], np.cumsum(np.where(place == -1, frequency, 0))]).astype(np.int32), posted.view("<i8").ravel()
        del terms, owner, weights, order, posted
        key = rare.astype(np.int64) * blocks + rare_owner // self.block
        order = np.argsort(key, kind="stable").astype(np.int32)
        key, rare_owner, rare_weights = key[order], rare_owner[order], rare_weights[order]
        del rare, order
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
        largest = np.maximum.reduceat(rare_weights, first) if len(first) else np.zeros(0, np.float32)
        offsets = np.searchsorted(key[first] // blocks, np.arange(self.n_terms + 1)).astype(np.int32)
        return (place, table, scan, offsets, (key[first] % blocks).astype(np.int16 if blocks < 1 << 15 else np.int32), largest,
                np.append(first, len(key)).astype(np.int32), rare_owner, rare_weights)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None) -> list[tuple[float, int, int]]:
        """The k examples of the largest cosine: (cosine, id, number of the example); all positive."""
        return self.nearest_many([(terms, weights)], k, None if without is None else [without])[0]

    def nearest_many(self, vectors, k: int, without: list[int | None] | None = None) -> list[list[tuple[float, int, int]]]:
        if not len(self.ids):
            return [[] for _ in vectors]
        place, table, scan = self.tables[:3]
        found, query = [], np.zeros(self.n_terms)
        for at in range(0, len(vectors), TOGETHER):
            some = vectors[at:at + TOGETHER]
            dense = np.zeros((len(some), len(table)), np.float32)
            places = [place[terms] for terms, _ in some]
            for row, own, (_, weights) in zip(dense, places, some):
                tabled = own >= 0
                row[own[tabled]] = weights[tabled]
            low = dense @ table
            for i, (terms, weights) in enumerate(some):
                left_out = -1 if without is None or without[at + i] is None else int(np.flatnonzero(self.numbers == without[at + i])[0])
                rare, scanned = places[i] == -2, places[i] == -1
                self._scan(low[i], scan, terms[scanned], weights[scanned])
                hit = self._candidates(low[i], terms[rare], weights[rare].astype(np.float32), k, left_out)
                query[terms] = weights
                exact = self._exact(query, hit)
                query[terms] = 0.0
                number = self.numbers[hit]
                order = np.lexsort((number, self.ids[hit], -exact))[:k]
                found.append([(s, d, n) for s, d, n in zip(exact[order].tolist(), self.ids[hit[order]].tolist(), number[order].tolist()) if s > 0])
        return found

    def _exact(self, query: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """The scores of some examples in full precision."""
        out, first, stop = np.zeros(len(hit)), self.starts[hit], self.starts[hit + 1]
        room = np.empty((stop - first).max(initial=0))
        for i, (a, b) in enumerate(zip(first.tolist(), stop.tolist())):
            # "clip" spares a check: all terms are places of the query.
            products = query.take(self.terms[a:b], out=room[:b - a], mode="clip")
            products *= self.weights[a:b]
            out[i] = products[0] + products[1:].sum()
        return np.round(out, 12)

    @staticmethod
    def _scan(low: np.ndarray, scan: tuple, terms: np.ndarray, weights: np.ndarray) -> None:
        """Add what the scanned terms give to the scores."""
        offsets, posted = scan
        first, stop = offsets[terms], offsets[terms + 1]
        if len(terms):
            # Slices are copied as they lie, which costs less than to pick each posting.
            found = np.concatenate([posted[a:b] for a, b in zip(first.tolist(), stop.tolist())])
            given = found.view(np.float32)[1::2] * np.repeat(weights.astype(np.float32), stop - first)
            low += np.bincount(found & 0xFFFFFFFF, given, len(low))

    def _candidates(self, low: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, left_out: int) -> np.ndarray:
        """Places of all examples that can be among the first k.

        ``low`` has the scores by the table's and the scanned terms. The rarer terms bound a block by its largest weights; blocks
        whose bound is below the k-th of those scores are skipped.
        """
        offsets, block_of, largest, postings, owner, posted = self.tables[3:]
        blocks = len(low) // self.block
        counts = offsets[terms + 1] - offsets[terms]
        ends = np.cumsum(counts)
        entry = np.repeat(offsets[terms] - ends + counts, counts)
        entry += np.arange(len(entry), dtype=entry.dtype)
        weight = np.repeat(weights, counts)
        of = block_of[entry]
        by_block = low.reshape(blocks, self.block)
        bound = np.bincount(of, largest[entry] * weight, blocks) + by_block.max(axis=1) + MARGIN
        # No weight is negative, so the k-th score by the frequent terms alone is one that the k-th score cannot fall below.
        if left_out >= 0:
            low[left_out] = 0.0
        least = max(0.0, np.partition(low, len(low) - k)[len(low) - k] - 2 * MARGIN) if len(low) >= k else 0.0
        scored = bound > least
        now = np.flatnonzero(scored)
        mine = np.flatnonzero(scored[of])
        first = postings[entry[mine]]
        size = postings[entry[mine] + 1] - first
        stop = np.cumsum(size)
        spread = np.repeat(first - stop + size, size)
        spread += np.arange(len(spread), dtype=spread.dtype)
        rest = np.bincount(owner[spread], posted[spread] * np.repeat(weight[mine], size), len(low))
        places = (now[:, None] * self.block + np.arange(self.block)).ravel()
        scores = low[places] + rest[places]
        if left_out >= 0:
            scores[places == left_out] = 0.0
        if len(scores) >= k:
            least = max(0.0, np.partition(scores, len(scores) - k)[len(scores) - k] - 2 * MARGIN)
        self.blocks_seen += blocks
        self.blocks_scored += int(scored.sum())
        return np.sort(places[scores > least])


def alike(starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int, block: int) -> np.ndarray:
    """Examples in an order that puts similar ones next to each other: by the nearest of a few centres of seeded projections."""
    n = len(starts) - 1
    if n <= block:
        return np.arange(n)
    rng = np.random.default_rng(31)
    axes = rng.standard_normal((n_terms, 32), np.float32)
    points = np.zeros((n, 32), np.float32)
    for at in range(n):
        own = slice(starts[at], starts[at + 1])
        points[at] = weights[own].astype(np.float32) @ axes[terms[own]]
    centres = points[rng.choice(n, -(-n // block) // 4 + 1, replace=False)]
    for _ in range(5):
        own = (points @ centres.T).argmax(axis=1)
        centres = np.stack([points[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-9
    return np.argsort((points @ centres.T).argmax(axis=1), kind="stable")


class ToxicityModel:
    def __init__(self, terms: Terms, idf, vectors, ids, labels, weights, params: ToxicityParams):
        self.terms, self.params, self.idf = terms, params, idf
        self.labels, self.weights = np.array(labels, float), np.array(weights, float)
        vectors = list(vectors)
        used, rest = [i for i, v in enumerate(vectors) if len(v[0])], [i for i, v in enumerate(vectors) if not len(v[0])]
        self.number = np.array(used, np.int64)
        self.prior = float((self.labels * self.weights).sum() / self.weights.sum())
        self.index = BlockMaxIndex([vectors[i] for i in used], [ids[i] for i in used], len(terms), params.block)
        # From here on the index has the only copy of the vectors, unless the caller keeps them.
        del vectors
        votes = np.array([self.vote(f) for f in self.index.nearest_many(self.index.vectors(), params.neighbours, list(range(len(used))))])
        # Tasks make their own tables; the driver needs none any more.
        self.index.__dict__.pop("tables", None)
        self.slope, self.shift = fit_curve(votes, self.labels[used], self.weights[used])
        self.without_terms = float(((self.labels * self.weights)[rest].sum() + 0.5 * self.curve(0.0)) / (self.weights[rest].sum() + 0.5))

    def vote(self, found: list[tuple[float, int, int]]) -> float:
        near = self.number[[n for *_, n in found]] if found else np.zeros(0, np.int64)
        mass = np.array([s for s, *_ in found]) ** 2 * self.weights[near] if found else np.zeros(0)
        doubt = self.params.doubt
        return float((mass @ self.labels[near] + doubt * self.prior) / (mass.sum() + doubt))

    def curve(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * (vote - 0.5) + self.shift))))

    def score_many(self, texts: list[str | None]) -> list[tuple[float, list[tuple[float, int, int]]]]:
        vectors = [vector(*c, self.idf) for c in self.terms.counts(texts)]
        found = self.index.nearest_many(vectors, self.params.neighbours)
        return [(self.curve(self.vote(f)) if len(v[0]) else self.without_terms, f) for v, f in zip(vectors, found)]


def fit_curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """A logistic curve over the votes by Newton steps, slightly drawn to slope 8 and shift 0."""
    beta = np.array([8.0, 0.0])
    if not len(votes):
        return 8.0, 0.0
    x, w = np.stack([votes - 0.5, np.ones(len(votes))], axis=1), weights / weights.mean()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (labels - p)) - 0.05 * (beta - [8.0, 0.0])
        bend = (x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, params: ToxicityParams) -> tuple[DataFrame, dict[int, float]] | None:
    """Documents of a bounded sample with label, and how many documents one of a label stands for."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()
                         & (crc_remainder("doc_id", params.fold) != params.held_out)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return None
    wanted = {0: params.clean_examples, 1: params.toxic_examples}
    share = F.when(F.col("toxic") == 1, wanted[1] / counts.get(1, 1)).otherwise(wanted[0] / counts.get(0, 1))
    # Twice the wanted number at most, whatever the table: 2 x 6,000 ids.
    chosen = (known.where(unit_hash("doc_id", F.lit("toxicity")) < share)
              .orderBy(F.xxhash64("doc_id", F.lit("order"))).limit(2 * sum(wanted.values())))
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    # An id teaches once, by the text of the smallest hash, however many rows it has.
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return rows, {k: max(1.0, counts[k] / wanted[k]) for k in counts}


def terms_of(rows: DataFrame) -> pa.Array:
    """All features of the sample, in order."""

    def list_terms(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = pa.array(sorted({w for t in batch.column("text").to_pylist() if t for w in WORDS.findall(t.lower()) if len(w) <= 64}), pa.large_string())
        terms = pa.concat_arrays([f.drop_null() for f in features(words)]).unique()
        return pa.RecordBatch.from_arrays([terms.cast(pa.string())], names=["term"])

    # As many as the bounded sample has.
    found = map_batches(rows.select("text"), list_terms, "term string").distinct().toArrow().column("term").to_pylist()
    return pa.array(sorted(found), pa.large_string())


def inverse_frequencies(docs: DataFrame, terms: Broadcast) -> np.ndarray:
    """Over all documents; a task adds up its counts, of which there are as many as terms."""
    n_terms = len(terms.value)

    def count(batches):
        seen = np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            for texts in (batch.column("text").slice(at, ROWS_PER_BATCH).to_pylist() for at in range(0, batch.num_rows, ROWS_PER_BATCH)):
                for found, _ in terms.value.counts(texts):
                    seen[found] += 1
                seen[-1] += len(texts)
        names = np.flatnonzero(seen)
        for at in range(0, len(names), 1 << 16):
            some = names[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["term", "n"])

    small_batches(docs.sparkSession)
    # At most one row a term.
    rows = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(n_terms + 1)
    seen[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    return np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1


def emphasis(terms: list[np.ndarray], labels: list[int], n_terms: int) -> np.ndarray:
    """1 for a term that is as frequent in either label's examples, else more; no term gets less."""
    toxic = np.array(labels) == 1
    n1, n0 = float(toxic.sum()), float((~toxic).sum())
    a, b = (np.bincount(np.concatenate([np.zeros(0, np.int64), *[t for t, x in zip(terms, toxic) if x == label]]), minlength=n_terms)
            for label in (True, False))
    rate = (a + b) / (n1 + n0)

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-9)), 0.0)

    ratio = 2 * (part(a, n1 * rate) + part(b, n0 * rate) + part(n1 - a, n1 * (1 - rate)) + part(n0 - b, n0 * (1 - rate)))
    return 1 + np.log1p(np.maximum(ratio, 0))


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel | None:
    """The model over the bounded sample; None without a row of each label."""
    sample = labelled_sample(docs, labels, params)
    if sample is None:
        return None
    rows, weight = sample
    terms = terms_of(rows)
    labels_seen = {r["toxic"] for r in rows.select("toxic").distinct().collect()}
    if not terms or labels_seen != {0, 1}:
        return None
    known = Terms(terms)
    # Made here, so that workers get it as it is.
    known.table  # noqa: B018
    shared = docs.sparkSession.sparkContext.broadcast(known)  # bounded by the sample
    idf = inverse_frequencies(docs, shared)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value.counts(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.array([t.astype(np.int32).tobytes() for t, _ in found], pa.binary()),
             pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary())], names=["doc_id", "toxic", "terms", "n"])

    # The sample's rows, eight bytes for each of their terms.
    examples = map_batches(rows.select("doc_id", "toxic", "text"), count, "doc_id long, toxic long, terms binary, n binary").toArrow().to_pylist()
    shared.unpersist()
    examples.sort(key=lambda r: (r["doc_id"], r["terms"], r["n"]))
    ids, toxic = [r["doc_id"] for r in examples], [r["toxic"] for r in examples]
    found = [np.frombuffer(r["terms"], np.int32) for r in examples]
    idf *= emphasis(found, toxic, len(terms))
    # Made as the model takes them, so that the rows they come from can go.
    vectors = (vector(t, np.frombuffer(r["n"], np.int32), idf) for t, r in zip(found, examples))
    del found, examples
    return ToxicityModel(known, idf, vectors, ids, toxic, [weight[label] for label in toxic], params)


def score_texts(docs: DataFrame, model: ToxicityModel | None, params: ToxicityParams) -> DataFrame:
    """Score every whole text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample
    held = (crc_remainder("doc_id", params.fold) == params.held_out).alias("held_out")

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        found = shared.value.score_many(texts) if shared.value else [(0.0, [])] * len(texts)
        scores, near = [s for s, _ in found], [f for _, f in found]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
             pa.array([int(s >= params.threshold) for s in scores], pa.int32()),
             pa.array([[i for _, i, _ in f] for f in near], pa.list_(pa.int64())),
             pa.array([[s for s, *_ in f] for f in near], pa.list_(pa.float64()))],
            names=["doc_id", "held_out", "score", "predicted", "neighbours", "similarities"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", held), score, SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    return score_texts(docs, fit(docs, labels, params), params)


def drop_toxic(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The documents, all columns, that are not predicted toxic; texts are judged where they lie."""
    model = fit(docs, labels, params)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([s < params.threshold for s, _ in shared.value.score_many(batch.column("text").to_pylist())]))

    return map_batches(docs, judge, docs.schema)
