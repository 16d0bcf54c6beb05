"""The block-max index over real texts: the neighbours of a dense search, with blocks skipped."""

import numpy as np

from meterlens.llm import toxicity
from meterlens.llm.common import table


def test_neighbours_equal_a_dense_search_and_blocks_are_skipped(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    vectors = [toxicity.vector(*c, model.idf) for c in model.terms.counts(texts)]
    index = model.index
    examples = np.zeros((len(index.ids), index.n_terms), np.float32)
    for row, a, b in zip(examples, index.starts[:-1], index.starts[1:]):
        row[index.terms[a:b]] = index.weights[a:b]
    index.blocks_seen = index.blocks_scored = 0
    found = index.nearest_many(vectors, 15)
    wrong = 0
    for (terms, weights), near in zip(vectors, found):
        query = np.zeros(index.n_terms, np.float32)
        query[terms] = weights
        low = examples @ query
        least = np.sort(low)[::-1][min(14, len(low) - 1)]
        # Candidates by single precision, in whole precision.
        exact = []
        for k in np.flatnonzero(low > max(0.0, least - 1e-4)).tolist():
            own = slice(index.starts[k], index.starts[k + 1])
            whole = np.zeros(index.n_terms)
            whole[terms] = weights
            exact.append((-round(float(index.weights[own] @ whole[index.terms[own]]), 12), int(index.ids[k])))
        want = [(i, -s) for s, i in sorted(exact)[:15] if s < 0]
        wrong += [i for _, i, _ in near] != [i for i, _ in want] or not np.allclose([s for s, *_ in near], [s for _, s in want])
    assert wrong == 0
    assert index.blocks_scored < 0.9 * index.blocks_seen


def test_an_id_of_many_rows_teaches_once(spark):
    """An id that a third of all rows hold reaches the driver as one row."""
    rows = [(1, f"copy number {k} of one id") for k in range(300)] + [(i, f"plain words {i}") for i in range(2, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1, 600)], "doc_id long, toxic int")
    sample, _ = toxicity.labelled_sample(docs, labels, toxicity.ToxicityParams())
    counts = {r["doc_id"]: r["count"] for r in sample.groupBy("doc_id").count().collect()}
    assert set(counts.values()) == {1} and len(counts) > 300


def test_counts_of_a_batch_are_those_of_each_text(spark):
    texts = [None, "", "Émile walks walking walked", "123 !!", "walked " * 5, "İstanbul straße 北京"]
    import pyarrow as pa
    terms = toxicity.Terms(pa.array(sorted(["walk-", "walked", "walki-", "émil-", "straß-", "北京"]), pa.large_string()))
    got = [{terms.terms[int(t)].as_py(): int(n) for t, n in zip(*c)} for c in terms.counts(texts)]
    assert got[0] == got[1] == got[3] == {} and got[4] == {"walk-": 5, "walked": 5}
    assert got[2] == {"walk-": 3, "walked": 1, "walki-": 1, "émil-": 1} and got[5] == {"straß-": 1, "北京": 1}
    assert [dict(zip(*map(tuple, c))) for c in terms.counts(texts)] == [dict(zip(*map(tuple, terms.counts([t])[0]))) for t in texts]


def test_words_are_told_by_their_letters():
    """Hashed words give the counts that words and beginnings as strings give, at every cut of the texts."""
    import pyarrow as pa
    texts = ["walk walks walking", "Ünïcode ünïcodes 北京市 北京", "a_b 1x2 x", "", None, "w" * 300 + " " + "w" * 299, "ΣΑΣ σας"] * 3
    words = [toxicity.WORDS.findall((t or "").lower()) for t in texts]
    every = sorted({w for one in words for w in one} | {w[:k] + "-" for one in words for w in one for k in toxicity.BEGINNINGS if len(w) > k})
    every = [t for t in every if len(t) <= 64]
    terms = toxicity.Terms(pa.array(every, pa.large_string()))
    whole = terms.counts(texts)
    for one, (numbers, counts) in zip(words, whole):
        want = {}
        for w in one:
            for term in [w, *[w[:k] + "-" for k in toxicity.BEGINNINGS if len(w) > k]]:
                want[term] = want.get(term, 0) + (term in set(every))
        assert {every[n]: c for n, c in zip(numbers.tolist(), counts.tolist())} == {t: c for t, c in want.items() if c}
    assert [tuple(map(tuple, terms.counts([t])[0])) for t in texts] == [tuple(map(tuple, c)) for c in whole]


def test_blocks_are_bounded_by_the_partial_scores():
    """One round over the blocks is enough: no block is scored that falls below the k-th score by frequent terms."""
    rng = np.random.default_rng(5)
    n_terms = toxicity.SCANNED + 4000
    vectors = []
    for _ in range(400):
        own = np.unique(np.concatenate([rng.integers(0, 300, 60), rng.integers(0, n_terms, 60)]))
        weights = rng.random(len(own)) + 0.1
        vectors.append((own, weights / np.sqrt((weights * weights).sum())))
    index = toxicity.BlockMaxIndex(vectors, list(range(400)), n_terms, 16)
    dense = np.zeros((400, n_terms))
    for row, (own, weights) in zip(dense, vectors):
        row[own] = weights
    for left_out in (None, 7):
        found = index.nearest_many(vectors[:50], 15, None if left_out is None else [left_out] * 50)
        for i, near in enumerate(found):
            scores = dense @ dense[i]
            if left_out is not None:
                scores[left_out] = 0.0
            assert [n for *_, n in near] == sorted(range(400), key=lambda j: (-round(scores[j], 12), j))[:15]


def test_the_table_of_the_terms_is_made_once():
    """Every batch finds the table that the first one made, and a broadcast model brings it along."""
    import pickle

    import pyarrow as pa
    terms = toxicity.Terms(pa.array(["walk", "walk-"], pa.large_string()))
    terms.counts(["walk walks"])
    table = terms.table
    assert [n.tolist() for n, _ in terms.counts(["walks", "walk"])] == [[1], [0]] and terms.table is table
    assert "table" in pickle.loads(pickle.dumps(terms)).__dict__
