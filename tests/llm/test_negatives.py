"""Hard negatives against SQL and all scores, with their defined cases."""

import math

import numpy as np
import pytest

from checks.compare import canonical, connect
from meterlens.llm import negatives
from meterlens.llm.common import table

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, score double, variant int, vec string"


def plain(rows):
    """All scores in whole numbers; rows are (id, vector, label)."""
    kept = []
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = int(math.fmod(label + 1, 10)) if math.fmod(i, 7) == 0 else label
        kept.append((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in e)))
    kept = sorted(set(kept))
    out = []
    for i, label, e in kept:
        if math.fmod(i, 100):
            continue
        scored = sorted((-sum(x * y for x, y in zip(e, f)), j, other) for j, other, f in kept if j != i)
        for score, positive, other in [s for s in scored if s[2] == label][:5]:
            fits = [(-n, j) for n, j, other in scored if other != label and 30 * -score <= 100 * -n <= 90 * -score][:10]
            out += [(i, positive, k + 1, j, -score, n) for k, (n, j) in enumerate(fits)]
    return sorted(out)


def found(spark, rows, params=negatives.NegativeParams()):
    df = spark.createDataFrame([(i, e, label, 1.0, 2, "x") for i, e, label in rows], VECTORS)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, params).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def random_rows(n, width, seed=0, labels=10):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, width)) * rng.uniform(0.01, 1, (n, 1)) / math.sqrt(width)
    return [(k, v.tolist(), int(rng.integers(labels))) for k, v in enumerate(vectors.astype(np.float32))]


def test_equals_its_sql(spark):
    got = negatives.hard_negatives(table(spark, SMALL, "embeddings")).toPandas()
    want = connect(SMALL).execute(negatives.ORACLE).df()
    assert canonical(got) == canonical(want) and len(want) > 50


def test_against_all_scores_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 150)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rows = random_rows(700, 19)
    rows += [(1000 + k, rows[k % 3][1], 3) for k in range(40)] + [(1100, [0.0] * 19, 1), (1200, [-x for x in rows[0][1]], 2)]
    want = plain(rows)
    assert found(spark, rows) == want and len(want) > 200


def test_a_third_of_all_rows_is_one_vector(spark):
    rows = random_rows(200, 8) + [(500 + k, [0.3] * 8, k % 2) for k in range(100)]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("width", [1, 8, 21])
def test_no_pair_that_reaches_its_threshold_is_pruned(width):
    rng = np.random.default_rng(width)
    rows = np.floor(256 * rng.normal(size=(300, width)) * rng.uniform(0, 1, (300, 1)))
    anchors = np.floor(256 * rng.normal(size=(40, width)))
    scores = anchors @ rows.T
    least = np.quantile(scores, 0.98, axis=1)
    allowed = rng.random((40, 300)) < 0.7
    a, r = negatives.reaching(rows, anchors, least, allowed)
    pairs = set(zip(a.tolist(), r.tolist()))
    assert len(pairs) == len(a) and set(zip(*(x.tolist() for x in np.nonzero(allowed & (scores >= least[:, None]))))) <= pairs
    assert all(allowed[x] for x in pairs)
    assert width == 1 or len(pairs) < allowed.sum() / 2
    everything = negatives.reaching(rows, anchors, np.full(40, -np.inf), allowed)
    assert len(everything[0]) == allowed.sum()


def test_defined_cases(spark):
    rows = [(0, [0.5, 0.25], 1), (0, [0.5, 0.25], 1), (0, [0.1, 0.9], 1), (1, [1.0, 1.0], 1), (2, [0.4, None], 1), (3, None, 1), (4, [0.5, 0.5], None),
            (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 2), (None, [1.0, 1.0], 2), (8, [0.5], 2), (9, [], 2), (10, [0.6, 0.2, 5.0], 2),
            (11, [0.3, 0.3], 2), (12, [0.3, 0.3], 2), (15, [3e30, 3e30], 2), (16, [2e30, -3e30], 2), (-100, [0.7, 0.7], 1)]
    want = [r for r in plain(rows)]
    limit = (1 << 63) - 1
    got = found(spark, rows)
    assert [r for r in got if abs(r[4]) < limit and abs(r[5]) < limit] == [r for r in want if abs(r[4]) < limit and abs(r[5]) < limit]
    assert found(spark, []) == [] and found(spark, [(0, [1.0], 1)]) == []
