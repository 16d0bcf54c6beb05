"""Language, toxicity and quality: accuracy on rows that were held out, and defined cases."""

import weakref
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlens.llm import language, quality, toxicity
from meterlens.llm.common import table
from tests.llm.helpers import documents, empty_documents, odd_documents


def remainder(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


@pytest.fixture(scope="module")
def folder():
    return "/root/testdata/sf0.01"


def test_language_of_held_out_rows(spark, folder):
    docs = table(spark, folder, "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    found = language.language_id(docs, language.LanguageParams(documents_per_language=100, steps=150)).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(truth)
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in found)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in found if r["held_out"]]
    assert np.mean(held) > 0.97


def test_gradients_of_the_byte_network():
    net = language.ByteNetwork(["a", "b"], 3, 1)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    draw = np.random.default_rng(0)
    x, y, weight = draw.integers(0, 256, (6, 4)).astype(np.uint8), np.array([0, 1, 1, 0]), np.ones(4)
    _, grads = net.gradients(x, y, weight)
    for name, place in (("fu", (1, 2)), ("bu", (7, 0)), ("fv", (0, 1)), ("fe", (2, int(x[0, 0]))), ("c", (1, 0))):
        losses = []
        for step in (1e-3, -1e-3):
            net.weights[name][place] += step
            losses.append(net.gradients(x, y, weight)[0])
            net.weights[name][place] -= step
        assert abs((losses[0] - losses[1]) / 2e-3 - grads[name][place]) < 2e-3


def test_language_defined_cases(spark, folder):
    params = language.LanguageParams(documents_per_language=20, steps=20)
    docs = table(spark, folder, "documents").limit(100)
    windows, labels, names = language.training_windows(docs, params)
    net = language.train(windows, labels, names, params)
    rows = language.identify(odd_documents(spark), net, params).collect()
    assert len(rows) == 13
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (900, 901, 902, 903))
    assert all(by_id[i]["lang_pred"] in names for i in (904, 905, 908, 909, None))
    assert by_id[906]["score"] == by_id[907]["score"] and by_id[None]["held_out"]
    assert language.language_id(empty_documents(spark)).count() == 0
    untaught = odd_documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.language_id(untaught).collect()} == {"und"}


def test_toxicity_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    found = [r for r in toxicity.toxicity(docs, labels).collect()]
    assert len(found) == docs.count()
    held = [(r["predicted"], truth[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in truth]
    assert sum(p for p, t in held if t) / sum(t for _, t in held) > 0.7
    assert sum(p for p, t in held if not t) / sum(1 - t for _, t in held) < 0.01
    assert all(r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (remainder(r["doc_id"], 3) == 1) for r in found)


def test_block_max_search_is_exact():
    draw = np.random.default_rng(2)
    vectors = []
    for _ in range(300):
        terms = np.sort(draw.choice(40, draw.integers(1, 6), replace=False))
        weights = np.round(draw.random(len(terms)), 1) + 0.1
        vectors.append((terms, weights / np.sqrt((weights * weights).sum())))
    ids = draw.permutation(1000)[:300].tolist()
    index = toxicity.BlockMaxIndex(vectors, ids, 40, 16)
    dense = np.zeros((300, 40))
    for row, (t, w) in zip(dense, vectors):
        row[t] = w
    for terms, weights in vectors[:60]:
        query = np.zeros(40)
        query[terms] = weights
        scores = np.round(dense @ query, 12)
        want = sorted(((-s, i) for s, i in zip(scores, ids) if s > 0))[:7]
        got = index.nearest(terms, weights, 7)
        assert [i for _, i, _ in got] == [i for _, i in want]
        assert np.allclose([s for s, *_ in got], [-s for s, _ in want])


def test_toxicity_defined_cases(spark):
    labels = spark.createDataFrame([(None, 1, 1), (3, None, None), (4, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(odd_documents(spark), labels).collect()
    assert len(rows) == 13 and {r["score"] for r in rows} == {0.0}
    assert toxicity.toxicity(empty_documents(spark), labels).count() == 0
    assert toxicity.toxicity(odd_documents(spark), labels.limit(0)).count() == 13
    # One bad word among clean documents of the same kind.
    good = [(i, f"some plain words number {i} here") for i in range(200)]
    bad = [(1000 + i, f"some plain grubword number {i} here") for i in range(100)]
    docs = odd_documents(spark).unionByName(documents(spark, good + bad))
    marks = spark.createDataFrame([(i, 1, int(i >= 1000)) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks).collect()}
    assert all(found[i]["predicted"] == int(i >= 1000) for i, _ in good + bad)
    assert found[900]["score"] == found[901]["score"] == found[904]["score"] < 0.1
    assert found[1000]["neighbours"] and found[901]["neighbours"] == []
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 100


def test_quality_of_held_out_rows(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    found = quality.quality(docs, labels).collect()
    assert len(found) == docs.count()
    held = [(r["predicted"], truth[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == t for p, t in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (remainder(r["doc_id"], 5) == 0) for r in found)


def test_quality_defined_cases(spark):
    labels = spark.createDataFrame([(None, 1, 1), (3, None, None), (904, 1, 0), (904, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality(odd_documents(spark), labels).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.quality(empty_documents(spark), labels).count() == 0
    assert {r["score"] for r in quality.quality(odd_documents(spark), labels.limit(0)).collect()} == {0.0}


def test_context_sums_against_a_plain_count(spark):
    params = quality.QualityParams(buckets=512, size=8, ones=2)
    texts = ["one two three", None, "", "two two !! TWO"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sums, counts = quality.context_sums(docs, params)
    places, signs = quality.index_vectors(params)
    want, seen, buckets = np.zeros((512, 8)), np.zeros(512), quality.Buckets(512)
    for text in texts:
        codes = [buckets[t] for t in quality.TOKENS.findall(text or "")]
        for i, a in enumerate(codes):
            seen[a] += 1
            for j, b in enumerate(codes):
                if i != j and abs(i - j) <= params.reach:
                    want[a, places[b]] += signs[b]
    assert np.array_equal(sums, want) and np.array_equal(counts, seen)


def test_toxicity_searches_by_all_terms(spark):
    # Words of clean examples only: their texts are searched too, and the nearest shares the rarest words.
    good = [(i, f"some plain words number {'abcdefghij'[i % 10] * 8} here") for i in range(200)]
    bad = [(1000 + i, "grubword grubword and nothing else") for i in range(100)]
    docs = documents(spark, good + bad + [(5000, "plain words bbbbbbbb")], extra=False)
    marks = spark.createDataFrame([(i, 1, int(i >= 1000)) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks).collect()}
    assert all(found[i]["neighbours"] for i in found)
    near = found[5000]["neighbours"][:5]
    assert near and all(i % 10 == 1 and i < 200 for i in near) and found[5000]["predicted"] == 0


def test_a_bucket_of_a_text_is_taken_once():
    owner, values, times = quality.distinct(np.array([0, 0, 0, 2]), np.array([7, 3, 7, 7]))
    assert (owner.tolist(), values.tolist(), times.tolist()) == ([0, 0, 2], [3, 7, 7], [1, 2, 1])
    draw = np.random.default_rng(2)
    vectors, weights = draw.normal(size=(64, 5)).astype(np.float32), draw.random(64).astype(np.float32)
    texts = ["a b a, A a b", None, "one", "", "x y z x y z! x"]
    got = quality.pooled(texts, quality.Buckets(64), vectors, weights)
    for text, row in zip(texts, got):
        codes = [quality.Buckets(64)[t] for t in quality.TOKENS.findall(text or "")]
        if not codes:
            assert not row.any()
            continue
        v, w = vectors[codes].astype(float), weights[codes].astype(float)[:, None]
        mean = (v * w).sum(axis=0) / w.sum()
        spread = np.sqrt(np.maximum((v * v * w).sum(axis=0) / w.sum() - mean ** 2, 0))
        pairs = {*zip(codes, codes[1:]), 0}  # the last token of a batch's text pairs with what follows
        assert np.allclose(row[:10], [*mean, *spread], atol=1e-3)
        assert np.isclose(row[-3], np.log1p(len(codes))) and np.isclose(row[-2], len(set(codes)) / len(codes))
        assert abs(row[-1] * len(codes) - len(pairs)) <= 1


def test_toxicity_model_keeps_one_copy_of_the_vectors(monkeypatch):
    draw, seen = np.random.default_rng(4), []

    def made():
        for _ in range(40):
            weights = draw.random(6)
            yield np.sort(draw.choice(30, 6, replace=False)), weights / np.sqrt((weights * weights).sum())

    search = toxicity.BlockMaxIndex.nearest_many

    def checked(self, *args, **kwargs):
        alive.append(sum(r() is not None for r in seen))
        return search(self, *args, **kwargs)

    alive = []
    monkeypatch.setattr(toxicity.BlockMaxIndex, "nearest_many", checked)
    toxicity.ToxicityModel([""] * 30, np.ones(30), ((t, seen.append(weakref.ref(w)) or w) for t, w in made()), list(range(40)),
                           [i % 2 for i in range(40)], [1.0] * 40, toxicity.ToxicityParams())
    assert alive == [0]
