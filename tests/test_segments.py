"""Partition-independent K-Means, knees, the tiled silhouette and the segments' measures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlens.operators import kmeans, segment
from meterlens.plans.segmentation import Segments
from tests.conftest import rows


def cloud(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 3)) * 4
    points = centres[rng.integers(0, 5, n)] + rng.normal(size=(n, 3))
    return spark.createDataFrame([(f"c{i}", *p.tolist()) for i, p in enumerate(points)], "cliente_id string, a double, b double, c double")


def test_labels_do_not_depend_on_partitions(spark):
    data = cloud(spark)
    for k in (2, 4, 6):
        found = [rows(segment.fit_clusters(data.repartition(n, F.rand(n)), ["a", "b", "c"], k)) for n in (1, 7, 64)]
        assert found[0] == found[1] == found[2] and len({r[1] for r in found[0]}) == k


def test_start_spreads_and_steps_reach_a_fixed_point(spark):
    points = cloud(spark).select("cliente_id", F.array("a", "b", "c").alias("v")).cache()
    centres = np.array(kmeans.fit_centres(points, "cliente_id", "v", [3, 5])[5])
    x = np.array([r["v"] for r in points.collect()])
    own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    means = np.array([x[own == i].mean(axis=0) for i in range(5)])
    assert np.allclose(means, centres, atol=1e-3)
    assert ((x - centres[own]) ** 2).sum(axis=1).mean() < 4


def test_fewer_points_than_centres_and_none(spark):
    few = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0)], "cliente_id string, x double")
    assert rows(segment.fit_clusters(few, ["x"], 3)) == [("a", 0), ("b", 0), ("c", 1)]
    assert segment.try_clusters(few.limit(0), ["x"], 2) is None
    assert segment.score_candidates(few.limit(0), ["x"], [2, 3], "elbow") == []
    holed = spark.createDataFrame([("a", None), ("b", float("nan")), ("c", 5.0)], "cliente_id string, x double")
    assert rows(segment.fit_clusters(holed, ["x"], 2)) == [("a", 0), ("b", 0), ("c", 1)]


def plain_knee(x, y, sensitivity=1.0):
    """The difference curve walked point by point."""
    x, y = np.array(x, float), np.array(y, float)
    d = 1 - (y - y.min()) / (y.max() - y.min()) - (x - x.min()) / (x.max() - x.min())
    near = np.pad(d, 1, mode="edge")
    top, low = (d >= near[:-2]) & (d >= near[2:]), (d <= near[:-2]) & (d <= near[2:])
    limit = knee = None
    for i in range(len(x) - 1):
        if top[i]:
            limit, knee = d[i] - sensitivity / (len(x) - 1), x[i]
        if low[i]:
            limit = 0.0
        if knee is not None and limit is not None and d[i + 1] < limit:
            return int(knee)
    return None


CURVES = [([2, 3, 4, 5, 6, 7], [100, 40, 30, 25, 22, 20]), ([1, 2, 3, 4, 5, 6, 7, 8], [9, 8, 7, 6, 5, 4, 3, 2]),
          ([1, 2, 4, 8, 16, 32], [1000, 500, 200, 100, 90, 80]), ([2, 3, 4], [5, 5, 1]), ([1, 2, 3, 4, 5, 6], [50, 20, 19, 6, 5, 4])]


@pytest.mark.parametrize("sensitivity", [0.5, 1.0, 2.0])
def test_knees_of_many_curves(spark, sensitivity):
    data = [(c, k, float(w)) for c, (xs, ys) in enumerate(CURVES) for k, w in zip(xs, ys)] + [(9, 1, 3.0), (10, 1, 2.0), (10, 2, 2.0)]
    df = spark.createDataFrame(data, "curva int, k int, w double").repartition(3)
    got = {r["curva"]: r["codo"] for r in segment.knees(df, "k", "w", sensitivity, ["curva"]).collect()}
    assert got == {**{c: plain_knee(*curve, sensitivity) for c, curve in enumerate(CURVES)}, 9: None, 10: None}


def test_k_from_the_knee(spark):
    scores = list(zip(*CURVES[0]))
    assert segment.choose_k(scores, "elbow", "difference") == plain_knee(*CURVES[0]) == 3
    assert segment.choose_k([(2, 1.0), (3, 1.0), (4, 1.0)], "elbow", "difference") == 3
    assert segment.choose_k(scores, "elbow", "chord") == 3 and segment.choose_k(scores, "elbow") == 5


def test_silhouette_of_equal_and_far_points(spark):
    """Matrix products lose digits far from 0 and between equal points; distances must not."""
    data = [([1e7 + i // 4, 1e7], i // 20) for i in range(60)]
    df = spark.createDataFrame([(v, l) for v, l in data], "v array<double>, l int")
    x, labels = np.array([v for v, _ in data]), np.array([l for _, l in data])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = []
    for i in range(len(x)):
        a = d[i][labels == labels[i]].sum() / ((labels == labels[i]).sum() - 1)
        b = min(d[i][labels == other].mean() for other in set(labels) - {labels[i]})
        want.append((b - a) / max(a, b))
    for block in (1000, 13):
        assert segment.silhouette(df, "v", "l", block).first()[0] == pytest.approx(np.mean(want), abs=1e-9)


def test_silhouette_is_one_job_without_broadcast(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(v.tolist(), int(i % 3)) for i, v in enumerate(rng.normal(size=(900, 2)))], "v array<double>, l int")
    plan = segment.silhouette(df, "v", "l", 100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1


def test_segments_know_their_quality(spark):
    scaled = cloud(spark, 60)
    found = segment.fit_clusters(scaled, ["a", "b", "c"], 4)
    row = Segments(found, 4, scaled, scaled).quality().first()
    vectors = scaled.join(found, "cliente_id").select(F.array("a", "b", "c").alias("v"), "cluster_id")
    assert row["silueta"] == pytest.approx(segment.silhouette(vectors, "v", "cluster_id").first()[0])
    assert row["davies_bouldin"] == pytest.approx(segment.davies_bouldin(vectors, "v", "cluster_id").first()[0])
    assert (row["clientes"], row["clusters"]) == (60, 4)
    alone = Segments(segment.one_cluster(scaled), 1, scaled, scaled).quality().first()
    assert alone["silueta"] is None and alone["clusters"] == 1
    assert Segments(found, 4).quality() is None
