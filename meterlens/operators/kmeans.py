"""K-Means whose start and steps are aggregates, so that the result does not depend on partitions.

The start is k-means||: in each of ``STEPS`` rounds a point becomes a candidate with a probability in
proportion to its squared distance to the candidates so far. The draw is a hash of the point's key, so it
is the same however the points are dealt out. The candidates, about ``2 k`` a round, weighed by the points
nearest to them, are reduced to k on the driver. Lloyd's steps then are one aggregate each.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS, ROUNDS, CLOSE = 2, 20, 1e-4
Centres = list[tuple[float, ...]]


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a.cast("array<double>"), b, lambda x, y: (x - y) * (x - y)),
        F.lit(0.0), lambda total, d: total + d)


def distances(vector: str, centres: Sequence[Sequence[float]]) -> Column:
    return F.array(*[squared_distance(F.col(vector), F.array(*[F.lit(float(x)) for x in c])) for c in centres])


def nearest(vector: str, centres: Sequence[Sequence[float]]) -> Column:
    """Number of the nearest centre; the first of equally near ones."""
    near = distances(vector, centres)
    return (F.array_position(near, F.array_min(near)) - 1).cast("int")


def _draw(key: str, seed: int, step: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed), F.lit(step)), F.lit(1 << 40)) / float(1 << 40)


def start_centres(points: DataFrame, key: str, vector: str, ks: Sequence[int], seed: int) -> dict[int, Centres]:
    """For each k as many centres to start from (fewer if there are fewer different points), out of the same candidates."""
    first = points.agg(F.min_by(vector, F.struct(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key))).first()[0]
    if first is None:
        raise ValueError("there are no points")
    candidates: Centres = [tuple(first)]
    for step in range(STEPS):
        cost = F.array_min(distances(vector, candidates))
        total = points.agg(F.sum(cost)).first()[0]
        if not total:
            break
        # About 2 k rows, k being the largest.
        drawn = points.where(_draw(key, seed, step) < F.lit(2.0 * max(ks)) * cost / F.lit(total)).select(vector).distinct().collect()
        candidates = sorted({*candidates, *(tuple(r[0]) for r in drawn)})
    weights = np.zeros(len(candidates))
    for row in points.groupBy(nearest(vector, candidates).alias("c")).count().collect():
        weights[row["c"]] = row["count"]
    return {k: _reduced(np.array(candidates), weights, k, seed) for k in ks}


def _reduced(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> Centres:
    """Weighted k-means++ and a few of Lloyd's steps among the candidates."""
    if len(candidates) <= k:
        return [tuple(c) for c in candidates.tolist()]
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    while len(chosen) < k:
        cost = ((candidates[:, None] - candidates[chosen][None]) ** 2).sum(axis=2).min(axis=1) * weights
        if not cost.sum():
            break
        chosen.append(int(rng.choice(len(candidates), p=cost / cost.sum())))
    centres = candidates[chosen]
    for _ in range(ROUNDS):
        own = ((candidates[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([np.average(candidates[own == c], axis=0, weights=weights[own == c]) if weights[own == c].sum() else centres[c]
                            for c in range(len(centres))])
    return [tuple(c) for c in centres.tolist()]


def fit_centres(points: DataFrame, key: str, vector: str, ks: Sequence[int], seed: int = 42) -> dict[int, Centres]:
    """For each k the sorted centres after Lloyd's steps until none moves by more than ``CLOSE``, ``ROUNDS`` at most.

    A step is one job for all k that are not done. Means are rounded at the ninth place, so that the order in
    which a sum was added up is lost. A centre that no point is nearest to stays where it is. ``points``
    should be a written table.
    """
    centres = start_centres(points, key, vector, ks, seed)
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col(vector))))
    moving = list(dict.fromkeys(ks))
    for _ in range(ROUNDS):
        labels = F.array(*[F.struct(F.lit(k).alias("k"), nearest(vector, centres[k]).alias("c")) for k in moving])
        # One row a centre.
        found = {(r["k"], r["c"]): tuple(round(x, 9) + 0.0 for x in r["m"])
                 for r in points.select(vector, F.inline(labels)).groupBy("k", "c").agg(mean.alias("m")).collect()}
        shifts = {}
        for k in moving:
            moved = [found.get((k, i), c) for i, c in enumerate(centres[k])]
            shifts[k] = max(sum((x - y) ** 2 for x, y in zip(a, b)) for a, b in zip(centres[k], moved))
            centres[k] = moved
        moving = [k for k in moving if shifts[k] > CLOSE ** 2]
        if not moving:
            break
    return {k: sorted(set(c)) for k, c in centres.items()}
