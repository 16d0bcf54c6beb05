"""Collocations against SQL and plain counting, with their defined cases."""

import re
from collections import Counter

import numpy as np
import pytest

from checks.compare import canonical, connect
from meterlens.llm import phrases
from meterlens.llm.common import table
from tests.llm.helpers import CLASHES, documents, empty_documents, odd_documents
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def plain(rows, least, top=2000):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        low = (text or "").encode().lower().decode()
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            counts.update((lang or "und", tuple(words[i:i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    often = {c: f for c, f in counts.items() if len(c[1]) > 1 and f >= least}
    out = []
    for (lang, words), a in often.items():
        inside = any(lang == other and len(longer) > len(words) and f >= a
                     and any(longer[i:i + len(words)] == words for i in range(len(longer))) for (other, longer), f in often.items())
        cuts = [(1000 * a * n[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        if not inside:
            out.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, seen = [], Counter()
    for r in out:
        seen[r[0]] += 1
        if seen[r[0]] <= top:
            ranked.append((r[0], seen[r[0]], *r[1:]))
    return ranked


def found(df):
    return sorted((tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()), key=lambda r: r[:2])


def made(seed, n):
    rng = np.random.default_rng(seed)
    words = np.array(["a", "B", "cc", "Dé", "e", "f7", "北京", "g-h"])
    ends = np.array([" ", " ", "  ", "\t", ". ", ",", "\n", " ! "])
    return ["".join(w + e for w, e in zip(words[rng.zipf(1.6, 60) % 8], ends[rng.integers(0, 8, 60)])) for _ in range(n)]


def with_langs(spark, rows):
    df = spark.createDataFrame([(k, t, g) for k, (g, t) in enumerate(rows)], "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(1) for c in CLASHES if c not in ("text",)})


def test_equals_its_sql_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    got = phrases.collocations(table(spark, folder, "documents")).toPandas()
    want = connect(folder).execute(phrases.ORACLE).df()
    assert canonical(got) == canonical(want) and len(want) > 20


@pytest.mark.parametrize("shard", [8 << 20, 700])
def test_against_plain_counting(spark, monkeypatch, shard):
    """Whole, and with shards so small that texts are cut and all counts are sums over many."""
    monkeypatch.setattr(phrases, "SHARD", shard)
    rows = [("en" if k % 3 else None if k % 2 else "de", t) for k, t in enumerate(made(1, 90))] + [("en", None), ("en", ""), (None, "one")]
    rows += [("en", "and so on and so forth. " * 40)]
    want = plain(rows, 12)
    assert found(phrases.collocations(with_langs(spark, rows).repartition(5), 12)) == want and len(want) > 30
    assert found(phrases.collocations(with_langs(spark, rows), 12, top=3)) == [r for r in want if r[1] <= 3]


def test_index_counts_every_gram():
    rng = np.random.default_rng(1)
    text = np.concatenate([[0], rng.integers(0, 6, 3000), [0]]).astype(np.int32)
    forward, backward = phrases.transform(text), phrases.transform(text[::-1])
    steps = {True: (backward, phrases.last_to_first(backward)), False: (forward, phrases.last_to_first(forward))}
    size = np.bincount(forward, minlength=6)
    start = other = (np.cumsum(size) - size)[1:]
    size, grams = size[1:], [(k,) for k in range(1, 6)]
    for n, to_right in enumerate((False, True, False, True), 2):
        a, b = (other, start) if to_right else (start, other)
        owner, symbol, a, size, b = phrases.extended(*steps[to_right], a, size, b)
        other, start = (a, b) if to_right else (b, a)
        grams = [(*grams[o], s) if to_right else (s, *grams[o]) for o, s in zip(owner.tolist(), symbol.tolist())]
        want = Counter(g for g in zip(*(text[k:].tolist() for k in range(n))) if 0 not in g)
        assert dict(zip(grams, size.tolist())) == want


def test_counts_beyond_64_bits_are_exact(spark, monkeypatch):
    many = 3_000_000_000_000
    rows = [("en", "x y", ["x", "y"], many), ("en", "x", ["x"], many + 1), ("en", "y", ["y"], many + 2)]
    df = spark.createDataFrame(rows, "lang string, phrase string, words array<string>, f long")
    totals = spark.createDataFrame([("en", 900_000_000_000_001)], "lang string, n long")
    monkeypatch.setattr(phrases, "frequent", lambda docs, least: (df, totals))
    (row,) = phrases.collocations(None).collect()
    assert row["score"] == 1000 * many * 900_000_000_000_001 // ((many + 1) * (many + 2))


def test_defined_cases(spark):
    assert phrases.collocations(empty_documents(spark)).count() == 0
    odd = odd_documents(spark)
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert found(phrases.collocations(odd)) == plain(rows, 100)
    assert found(phrases.collocations(documents(spark, [(1, None), (2, "")]))) == []
