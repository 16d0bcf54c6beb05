"""Phrases of words that go together, counted by bidirectional FM-indexes over word ids.

1. Texts are cut into pieces and words where they are read; a task fills shards of about ``SHARD``
   bytes, one language each, as word ids with a 0 between pieces. No text is shuffled.
2. Words are summed over the shards, in parts dealt out by hash; only those that occur ``least`` times
   can be part of a candidate. Every shard learns which of its words those are.
3. A shard's text over those words, and its reverse, are sorted by the first ``DEPTH`` symbols of every
   suffix; the symbols before them are the two Burrows-Wheeler transforms. An n-gram is an interval of
   either order. Extending it to the left splits its interval by the symbols of the one transform
   (their counts are those of the longer n-grams), the rank of a symbol gives the new interval, and
   the symbols below it the new interval in the other order; extending to the right is the same with
   the orders changed round. All intervals of a length are extended at once.
4. Pairs are summed over the shards like the words, and each shard learns which of its pairs
   are frequent. It extends those right, left and right again, where the pair at the new end is
   frequent too (its interval has to lie in that of such a pair), and the counts are summed.
5. Cuts, scores and contained phrases come from joins of the frequent phrases with each other.

No count is pruned but by the frequency of a part, so all sums are exact. A task holds one shard
(``SHARD`` bytes of text; a longer text is cut between pieces) or one part of the pairs, of which
there are as many as shards.

Defined cases: null and empty texts have no word; a null language is ``und``; neither ids nor other
columns matter; repeated rows count as often as they occur; ties end with the phrase in byte order;
an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlens.llm.common import discard, small_batches
from meterlens.session import settle

SHARD, DEPTH, LONGEST, END = 6 << 20, 8, 5, b"\xff"
#: A-Z become a-z, and all that ends a piece becomes a byte that no text has.
FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + END * 10)
TEXTS = "lang string, shard long, tokens long, words array<string>, counts array<long>, text binary"
#: Packets hold arrays; what they are is said where they are made.
PACKET = "shard long, part long, lang string, a binary, b binary, c binary"
PACKETS = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("lang", pa.string()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
WORDS = ["w1", "w2", "w3", "w4", "w5"]


def packed(data: bytes | np.ndarray) -> bytes:
    data = data if isinstance(data, bytes) else data.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind=None) -> bytes | np.ndarray:
    data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return data if kind is None else np.frombuffer(data, kind)


def packet(shard, part, lang, *arrays) -> dict:
    return dict(zip(PACKETS.names, (shard, part, lang, *(packed(x) for x in arrays), *[None] * (3 - len(arrays)))))


def one_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=PACKETS)


def parts_of(values: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """Places of the values of each part, in order."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(values[order]) > 0)) if len(order) else np.zeros(0, int)
    return [(int(values[order[s]]), order[s:e]) for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)])]


# --- shards

def pieces_of(text: str) -> list[bytes]:
    """A text, cut between pieces where it is longer than a shard."""
    data, out = text.encode().translate(FOLD), []
    while len(data) > SHARD and (cut := data.rfind(END, 1, SHARD)) > 0:
        out.append(data[:cut])
        data = data[cut + 1:]
    return [*out, data]


def shard_row(lang: str, number: int, texts: list[bytes]) -> dict:
    tokens = END.join(texts).replace(END, b" \xff ").split()
    names: defaultdict[bytes, int] = defaultdict()
    names.default_factory = names.__len__
    names[END]
    ids = np.fromiter(map(names.__getitem__, tokens), np.int32, len(tokens))
    counts = np.bincount(ids, minlength=len(names))[1:]
    return {"lang": lang, "shard": number, "tokens": int(counts.sum()), "words": [w.decode() for w in names if w != END],
            "counts": counts.tolist(), "text": packed(ids)}


def shards(docs: DataFrame) -> DataFrame:
    """Word ids of the texts (0 ends a piece, else the place in ``words`` from 1), many texts a row."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("shard", pa.int64()), ("tokens", pa.int64()),
                        ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("text", pa.binary())])

    def run(batches):
        waiting, sizes = defaultdict(list), defaultdict(int)
        number = TaskContext.get().partitionId() << 32

        def row(lang):
            nonlocal number
            number += 1
            sizes[lang] = 0
            return pa.RecordBatch.from_pylist([shard_row(lang, number, waiting.pop(lang))], schema=schema)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for data in pieces_of(text) if text else ():
                    waiting[lang].append(data)
                    sizes[lang] += len(data) + 1
                    if sizes[lang] >= SHARD:
                        yield row(lang)
        for lang in sorted(waiting):
            yield row(lang)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, TEXTS)


def word_packets(texts: DataFrame, parts: int) -> DataFrame:
    """By part: a shard's words, how often each occurs, and its place."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                words = [w.encode() for w in r["words"]]
                counts = np.array(r["counts"], np.int64)
                part = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64) % np.uint64(parts)
                for k, some in parts_of(part.astype(np.int64), parts):
                    yield one_batch([packet(r["shard"], k, r["lang"], b" ".join(words[i] for i in some), counts[some], some)])

    small_batches(texts.sparkSession)
    return texts.select("shard", "lang", "words", "counts").mapInArrow(run, PACKET)


def frequent_words(packets: DataFrame, least: int) -> DataFrame:
    """By shard: places and numbers of the words that occur ``least`` times in their language; without a shard: the words, counts and numbers."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rows.sort(key=lambda r: (r["lang"], r["shard"]))
        out = []
        for lang in dict.fromkeys(r["lang"] for r in rows):
            own = [r for r in rows if r["lang"] == lang]
            words = [unpacked(r["a"]).split(b" ") for r in own]
            names, code = np.unique(np.array([w for ws in words for w in ws], object), return_inverse=True)
            sums = np.bincount(code, np.concatenate([unpacked(r["b"], np.int64) for r in own])).astype(np.int64)
            often = np.flatnonzero(sums >= least)
            number = np.zeros(len(names), np.int64)
            # Parts number their words apart from each other, and languages one after the other.
            number[often] = (own[0]["part"] << 32) + sum(len(unpacked(r["c"], np.int64)) for r in out if r["shard"] is None) + np.arange(1, len(often) + 1)
            if len(often):
                out.append(packet(None, own[0]["part"], lang, b" ".join(names[often].tolist()), sums[often], number[often]))
            at = 0
            for r, ws in zip(own, words):
                mine = number[code[at:at + len(ws)]]
                at += len(ws)
                if mine.any():
                    out.append(packet(r["shard"], r["part"], lang, unpacked(r["c"], np.int64)[mine > 0], mine[mine > 0]))
        return pa.Table.from_pylist(out, schema=PACKETS)

    return packets.groupBy("part").applyInArrow(run, PACKET)


def words_of(found: DataFrame) -> DataFrame:
    """(lang, word, f, id) of the frequent words."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                words = [w.decode() for w in unpacked(r["a"]).split(b" ")]
                yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(words)), pa.array(words), pa.array(unpacked(r["b"], np.int64)),
                                                  pa.array(unpacked(r["c"], np.int64))], names=["lang", "word", "f", "id"])

    return found.where("shard IS NULL").select("lang", "a", "b", "c").mapInArrow(run, "lang string, word string, f long, id long")


def by_shard(packets: DataFrame, name: str) -> DataFrame:
    return packets.where("shard IS NOT NULL").groupBy("shard").agg(F.collect_list(F.struct("a", "b")).alias(name))


# --- the index

def order_of(text: np.ndarray) -> np.ndarray:
    """Places of the text in the order of the first ``DEPTH`` symbols from there on."""
    rank, span, n = text.astype(np.int64), 1, len(text)
    while True:
        key = rank * (int(rank.max(initial=0)) + 2)
        key[:n - span] += rank[span:] + 1
        order = np.argsort(key, kind="stable")
        if 2 * span >= DEPTH:
            return order
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        span *= 2


def transform(text: np.ndarray) -> np.ndarray:
    """The symbol before each suffix, in the order of the suffixes."""
    return text[order_of(text) - 1].astype(np.int32)


def last_to_first(bwt: np.ndarray) -> np.ndarray:
    """Where the suffix goes that starts one symbol earlier: smaller symbols, and the same symbol's rank."""
    out = np.empty(len(bwt), np.int64)
    out[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    return out


def extended(bwt: np.ndarray, steps: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray):
    """Intervals (start; other: in the order of the other direction) extended by each symbol before them.

    Returns the interval each comes from, the symbol, start, size and other start.
    """
    ends = np.cumsum(size)
    rows = np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
    owner = np.repeat(np.arange(len(size)), size)
    symbol = bwt[rows]
    order = np.argsort(owner * (int(symbol.max(initial=0)) + 1) + symbol, kind="stable")
    owner, symbol, rows = owner[order], symbol[order], rows[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(rows)), bool), (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])]))
    count = np.diff(np.append(first, len(rows)))
    below = first - (ends - size)[owner[first]]
    word = symbol[first] > 0
    first, count, below = first[word], count[word], below[word]
    return owner[first], symbol[first], steps[rows[first]], count, other[owner[first]] + below


def within(place: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a place lies in one of the intervals, which don't overlap."""
    if not len(start):
        return np.zeros(len(place), bool)
    order = np.argsort(start)
    start, size = start[order], size[order]
    at = np.searchsorted(start, place, "right") - 1
    return (at >= 0) & (place < start[at] + size[at])


def pairs_of(forward: np.ndarray, words: int):
    """All pairs of words: second and first word, start, count and other start, in the order of second and first."""
    size = np.bincount(forward, minlength=words + 1)
    start = (np.cumsum(size) - size)[1:]
    second, first, start, count, other = extended(forward, last_to_first(forward), start, size[1:], start)
    return second + 1, first.astype(np.int64), start, count, other


def index_of(texts: DataFrame, found: DataFrame) -> DataFrame:
    """A shard's index over its frequent words: both transforms and the words' numbers."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                text = unpacked(r["text"], np.int32)
                place, ids = (np.concatenate([unpacked(p[k], np.int64) for p in r["known"]]) for k in "ab")
                order = np.argsort(ids)
                place, ids = place[order], ids[order]
                local = np.zeros(max(int(text.max(initial=0)), int(place.max()) + 1) + 1, np.int32)
                local[place + 1] = np.arange(1, len(place) + 1)
                text = local[text]
                # One 0 is enough wherever none of the words stands.
                text = np.concatenate([[0], text[(text > 0) | np.append(True, text[:-1] > 0)], [0]]).astype(np.int32)
                yield one_batch([packet(r["shard"], None, None, transform(text), transform(text[::-1]), ids)])

    small_batches(texts.sparkSession)
    return texts.select("shard", "text").join(by_shard(found, "known"), "shard").mapInArrow(run, PACKET)


def pair_packets(indexes: DataFrame, parts: int) -> DataFrame:
    """By part: a shard's pairs, second and first word, and how often they occur."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                forward, ids = unpacked(r["a"], np.int32), unpacked(r["c"], np.int64)
                second, first, _, count, _ = pairs_of(forward, len(ids))
                one, two = ids[first - 1], ids[second - 1]
                mix = one.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ two.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                part = ((mix >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)
                for k, some in parts_of(part, parts):
                    yield one_batch([packet(r["shard"], k, None, two[some], one[some], count[some])])

    small_batches(indexes.sparkSession)
    return indexes.select("shard", "a", "c").mapInArrow(run, PACKET)


def frequent_pairs(packets: DataFrame, least: int) -> DataFrame:
    """By shard: its pairs (second and first word) that occur ``least`` times over all shards; without a shard: such pairs and their sums."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        rows.sort(key=lambda r: r["shard"])
        parts = [[unpacked(r[k], np.int64) for k in "abc"] for r in rows]
        two, one, count = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((one, two))
        first = np.flatnonzero(np.append(True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)))
        sums = np.add.reduceat(count[order], first)
        often = np.empty(len(order), bool)
        often[order] = np.repeat(sums >= least, np.diff(np.append(first, len(order))))
        some = order[first[sums >= least]]
        out, at = [], 0
        if len(some):
            out.append(packet(None, rows[0]["part"], None, two[some], one[some], sums[sums >= least]))
        for r, (second, first_word, _) in zip(rows, parts):
            keep = often[at:at + len(second)]
            at += len(second)
            if keep.any():
                out.append(packet(r["shard"], r["part"], None, second[keep], first_word[keep]))
        return pa.Table.from_pylist(out, schema=PACKETS)

    return packets.groupBy("part").applyInArrow(run, PACKET)


def sums_of(packets: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(r[k], np.int64)) for k in "bac"], names=["w1", "w2", "f"])

    return packets.where("shard IS NULL").select("a", "b", "c").mapInArrow(run, "w1 long, w2 long, f long")


def longer(indexes: DataFrame, pairs: DataFrame, parts: int) -> DataFrame:
    """By part: n-grams of three to five words (0: no word), all of whose pairs are frequent, and how often the shard has them."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                grams, counts = zip(*longer_of(r))
                grams, counts = np.concatenate(grams), np.concatenate(counts)
                mix = np.zeros(len(grams), np.uint64)
                for column in grams.T:
                    mix = (mix ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    mix ^= mix >> np.uint64(29)
                for k, some in parts_of(((mix >> np.uint64(24)) % np.uint64(parts)).astype(np.int64), parts):
                    some = some[np.lexsort(grams[some].T[::-1])]
                    yield one_batch([packet(r["shard"], k, None, np.ascontiguousarray(grams[some].T), counts[some])])

    small_batches(indexes.sparkSession)
    return indexes.select("shard", "a", "b", "c").join(by_shard(pairs, "pairs"), "shard").mapInArrow(run, PACKET)


def longer_of(r: dict):
    """(n-grams, counts) of one shard, by length."""
    forward, backward = (unpacked(r[k], np.int32) for k in "ab")
    numbers = unpacked(r["c"], np.int64)
    two, one = (np.concatenate([unpacked(p[k], np.int64) for p in r["pairs"]]) for k in "ab")
    second, first, start, size, other = pairs_of(forward, len(numbers))
    wide = len(numbers) + 1
    wanted = (np.searchsorted(numbers, two) + 1) * wide + np.searchsorted(numbers, one) + 1
    at = np.searchsorted(second * wide + first, np.sort(wanted))
    second, first, start, size, other = (x[at] for x in (second, first, start, size, other))
    ids = np.concatenate([[0], numbers])
    ahead, back = (start, size), (other, size)
    steps = {True: (backward, last_to_first(backward)), False: (forward, last_to_first(forward))}
    grams = np.stack([ids[first], ids[second]], axis=1)
    for to_right in (True, False, True):
        a, b = (other, start) if to_right else (start, other)
        owner, symbol, a, size, b = extended(*steps[to_right], a, size, b)
        keep = within(a, *(back if to_right else ahead))
        owner, symbol, a, size, b = (x[keep] for x in (owner, symbol, a, size, b))
        other, start = (a, b) if to_right else (b, a)
        new = ids[symbol][:, None]
        grams = np.concatenate([grams[owner], new] if to_right else [new, grams[owner]], axis=1)
        yield np.pad(grams, ((0, 0), (0, LONGEST - grams.shape[1]))), size


def frequent_grams(packets: DataFrame, least: int) -> DataFrame:
    """(w1, ..., w5, f) of the n-grams that occur ``least`` times over all shards."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        grams = np.concatenate([unpacked(r["a"], np.int64).reshape(LONGEST, -1) for r in rows], axis=1)
        counts = np.concatenate([unpacked(r["b"], np.int64) for r in rows])
        order = np.lexsort(grams[::-1])
        grams, counts = grams[:, order], counts[order]
        first = np.flatnonzero(np.append(True, (grams[:, 1:] != grams[:, :-1]).any(axis=0)))
        sums = np.add.reduceat(counts, first)
        often = sums >= least
        return pa.table({**{w: column for w, column in zip(WORDS, grams[:, first[often]])}, "f": sums[often]})

    return packets.groupBy("part").applyInArrow(run, ", ".join(f"{w} long" for w in [*WORDS, "f"]))


# --- phrases

def frequent(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all words and phrases that occur ``least`` times, and (lang, n)."""
    texts = settle(shards(docs))
    totals = settle(texts.groupBy("lang").agg(F.sum("tokens").alias("n")))
    parts = max(1, texts.count())
    found = settle(frequent_words(word_packets(texts, parts), least))
    words = settle(words_of(found))
    indexes = settle(index_of(texts, found))
    # What is not read again goes, so that the disk holds few of these tables at a time.
    discard(texts)
    discard(found)
    pairs = settle(frequent_pairs(pair_packets(indexes, parts), least))
    grams = settle(frequent_grams(longer(indexes, pairs, parts), least))
    discard(indexes)
    grams = grams.unionByName(sums_of(pairs).withColumns({w: F.lit(0).cast("long") for w in WORDS[2:]}))
    grams = settle(grams.withColumn("gram", F.monotonically_increasing_id()))
    spelt = grams.select("gram", "f", F.posexplode(F.filter(F.array(*WORDS), lambda x: x > 0)).alias("pos", "id")).join(
        words.select("id", "lang", "word"), "id").groupBy("gram", "f", "lang").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    phrases = spelt.select("lang", F.col("w.word").alias("words"), "f").unionByName(words.select("lang", F.array("word").alias("words"), "f"))
    phrases = settle(phrases.select("lang", F.array_join("words", " ").alias("phrase"), "words", "f"))
    return phrases, totals


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases of two to five words.

    a is the phrase's count, l and r those of its parts at the cut of the lowest score
    floor(1000 a n / (l r)), n all words of the language. A phrase inside a longer one that occurs as
    often is left out: it is enough to look at those longer by one word, which lie between.
    """
    phrases, totals = frequent(docs, least)
    wide = "decimal(19,0)"
    candidates = phrases.where(F.size("words") > 1).withColumnRenamed("f", "a")
    counts = phrases.select("lang", "phrase", "f")

    def part(start, length, name):
        return F.array_join(F.slice("words", start, length), " ").alias(name)

    size = F.size("words")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k"), "head"), part(F.col("k") + 1, size - F.col("k"), "tail"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(
        counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang")
    score = F.expr(f"(CAST(1000 * a AS {wide}) * CAST(n AS {wide})) DIV (CAST(l AS {wide}) * CAST(r AS {wide}))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.where(size > 2).select("lang", "a", F.explode(F.array(part(F.lit(1), size - 1, "x"), part(F.lit(2), size - 1, "x"))).alias("phrase"))
    kept = lowest.join(inner.distinct(), ["lang", "phrase", "a"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM placed, range(1, 6) t(k) WHERE i + k - 1 <= len(w)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE k > 1 AND f >= 100),
cuts AS (SELECT lang, phrase, w, a, unnest(range(1, len(w))) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(w[c.k + 1:], ' ') JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM candidates c WHERE c.lang = s.lang AND c.phrase <> s.phrase AND 100 * c.a >= 100 * s.a
      AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
