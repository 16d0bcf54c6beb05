"""Customer segments: choice of k, K-Means, and quality of a given labelling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlens.operators.kmeans import fit_centres, nearest, squared_distance
from meterlens.params import CLUSTER, KEY
from meterlens.session import settle

#: Points of a block, and rows of a tile whose distances are held at a time.
POINT_BLOCK, TILE_ROWS = 4096, 256


# --- assignment ---------------------------------------------------------------------------

def one_cluster(df: DataFrame) -> DataFrame:
    """Fallback: every customer in cluster 0."""
    return df.select(KEY).distinct().withColumn(CLUSTER, F.lit(0))


def fit_clusters(scaled: DataFrame, columns: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """K-Means on the scaled profile as (customer, cluster_id).

    k of 0 or less, or data that K-Means refuses, puts everyone in cluster 0; any other failure
    is raised. Ids are numbered by the sorted centres.
    """
    found = try_clusters(scaled, columns, k, seed)
    return one_cluster(scaled) if found is None else found


def try_clusters(scaled: DataFrame, columns: Sequence[str], k: int, seed: int = 42) -> DataFrame | None:
    """The same, or None where K-Means refuses."""
    return try_many(scaled, columns, [k], seed).get(k)


def try_many(scaled: DataFrame, columns: Sequence[str], ks: Sequence[int], seed: int = 42) -> dict[int, DataFrame]:
    """Assignments for each k, stepped together; a k that K-Means refuses is left out."""
    ks = [k for k in ks if k > 0]
    values = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)) for c in columns])
    points = scaled.select(KEY, values.alias("_v"))
    if not ks:
        return {}
    try:
        centres = fit_centres(points, KEY, "_v", ks, seed)
    except ValueError as error:
        print(f"K-Means with k of {ks} refused the data: {error}")
        return {}
    return {k: points.select(KEY, nearest("_v", c).alias(CLUSTER)) for k, c in centres.items()}


def clamp_k(k: int, customers: int) -> int:
    """At least 1, and no more than there are customers."""
    return max(1, min(k, customers)) if customers else max(1, k)


def usable_candidates(candidates: Sequence[int], method: str, customers: int) -> list[int]:
    """Candidates that fit the number of customers, in the order given."""
    if method == "silhouette":
        low, high = 2, (customers - 1 if customers > 1 else 1)
    else:
        low, high = 1, customers
    return [k for k in candidates if low <= k <= high]


def resolve_k(scaled: DataFrame, columns: Sequence[str], candidates: Sequence[int], method: str,
              fixed_k: int | None = None, seed: int = 42, knee: str = "middle",
              metric: str = "euclidean", fits: dict[int, DataFrame] | None = None) -> int:
    """A fixed k wins; else the best candidate; without one, two clusters or fewer.

    ``fits`` collects the assignments of the candidates that were tried, for reuse.
    """
    customers = scaled.count()
    if fixed_k is not None:
        return clamp_k(int(fixed_k), customers)
    usable = usable_candidates(candidates, method, customers)
    if not usable:
        return clamp_k(min(2, customers) or 1, customers)
    scores = score_candidates(scaled, columns, usable, method, seed, metric, fits)
    if not scores:
        return clamp_k(min(2, customers) or 1, customers)
    return clamp_k(choose_k(scores, method, knee), customers)


def score_candidates(scaled: DataFrame, columns: Sequence[str], candidates: Sequence[int],
                     method: str, seed: int = 42, metric: str = "euclidean",
                     fits: dict[int, DataFrame] | None = None) -> list[tuple[int, float]]:
    """(k, score): mean silhouette (-1 when only one label came out) or sum of squares; a k that fails is left out."""
    scores = []
    vectors = scaled.select(KEY, F.array(*[F.col(c) for c in columns]).alias("_v"))
    found = try_many(scaled, columns, candidates, seed)
    for k in (k for k in candidates if k in found):
        labelled = settle(vectors.join(found[k], KEY))
        if fits is not None:
            fits[k] = labelled.select(KEY, CLUSTER)
        if method != "silhouette":
            score = within_squares(labelled, "_v", CLUSTER).first()[0]
        elif labelled.select(CLUSTER).distinct().count() > 1:
            score = (squared_silhouette(labelled, "_v", CLUSTER) if metric == "squared"
                     else silhouette(labelled, "_v", CLUSTER).first()[0])
        else:
            score = -1.0
        scores.append((k, score))
    return scores


def choose_k(scores: Sequence[tuple[int, float]], method: str, knee: str = "middle") -> int:
    """First best silhouette, or the elbow of the sum of squares.

    ``knee="middle"`` takes the middle candidate, ``"difference"`` the knee of the difference curve (see
    ``knees``), ``"chord"`` the point farthest below the line between the ends of the curve (see
    ``curve_drop``); the middle one where there is none.
    """
    if method == "silhouette":
        best = max(score for _, score in scores)
        return next(k for k, score in scores if score == best)
    ks = [k for k, _ in scores]
    middle = ks[len(ks) // 2]
    if knee == "middle" or len(ks) < 3:
        return middle
    curve = SparkSession.builder.getOrCreate().createDataFrame([(int(k), float(w)) for k, w in scores], "k int, wcss double")
    if knee == "difference":
        row = knees(curve, "k", "wcss").first()
    else:
        row = curve_drop(curve, "k", "wcss").where("es_codo").select(F.col("k").alias("codo")).first()
    return middle if row is None or row["codo"] is None else row["codo"]


def knees(curves: DataFrame, x: str, y: str, sensitivity: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, codo): the knee of each convex decreasing curve, NULL where it has none.

    Both axes are scaled to [0, 1]; the difference curve is how far the turned curve lies above the
    diagonal. Every local maximum of it sets a threshold, ``sensitivity`` mean steps below itself, and a local
    minimum sets it to 0; the first point below the threshold in force makes the last maximum the knee. Ends
    count as maxima or minima if their one neighbour allows. A curve has a row per candidate.
    """
    keys = list(keys)
    by = keys or [F.lit(0)]
    order = Window.partitionBy(*by).orderBy(x)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(whole), F.max(c).over(whole)
        return F.try_divide(F.col(c) - low, (high - low).cast("double"))

    curve = curves.select(*keys, x, y).withColumn("_d", F.lit(1.0) - scaled(y) - scaled(x)).withColumn(
        "_step", F.try_divide(F.lit(float(sensitivity)), F.count(F.lit(1)).over(whole) - 1))
    before, after = F.coalesce(F.lag("_d").over(order), F.col("_d")), F.coalesce(F.lead("_d").over(order), F.col("_d"))
    curve = curve.withColumns({"_top": (F.col("_d") >= before) & (F.col("_d") >= after),
                               "_low": (F.col("_d") <= before) & (F.col("_d") <= after), "_next": F.lead("_d").over(order)})
    event = F.when(F.col("_low"), F.lit(0.0)).when(F.col("_top"), F.col("_d") - F.col("_step"))
    curve = curve.withColumns({"_limit": F.last(event, ignorenulls=True).over(so_far),
                               "_knee": F.last(F.when(F.col("_top"), F.col(x)), ignorenulls=True).over(so_far)})
    falls = F.col("_knee").isNotNull() & (F.col("_next") < F.col("_limit"))
    first = F.min(F.when(falls, F.struct(F.col(x).alias("x"), F.col("_knee").alias("k"))))["k"].alias("codo")
    return curve.groupBy(*keys).agg(first) if keys else curve.agg(first)


def curve_drop(curve: DataFrame, x: str, y: str) -> DataFrame:
    """Depth of each point of a decreasing curve below its chord, both axes scaled to [0, 1].

    The curve has one row per candidate, a few dozen at most, so one window is enough.
    """
    whole = Window.partitionBy(F.lit(0)).orderBy(x).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {"_x0": F.first(x).over(whole), "_x1": F.last(x).over(whole),
            "_y0": F.first(y).over(whole), "_y1": F.last(y).over(whole)}
    across = F.try_divide(F.col(x) - F.col("_x0"), F.col("_x1") - F.col("_x0"))
    height = F.try_divide(F.col(y) - F.col("_y1"), F.col("_y0") - F.col("_y1"))
    deep = curve.withColumns(ends).withColumn("profundidad", F.lit(1.0) - across - height)
    knee = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("profundidad"), x)) == 1
    return deep.withColumn("es_codo", knee & (F.col("profundidad") > 0)).drop(*ends)


# --- quality of a labelling ---------------------------------------------------------------

def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean vector per label: one row per cluster."""
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return df.groupBy(label).agg(vector_to_array(mean).alias("_centre"))


def within_squares(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Sum of squared distances to the own centre."""
    joined = df.join(settle(centroids(df, vector, label)), label)
    return joined.agg(F.sum(squared_distance(F.col(vector), F.col("_centre"))).alias("wcss"))


def davies_bouldin(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / centre distance with another cluster.

    Rows only meet their own centre. The centres, one per cluster, are then compared inside
    one array.
    """
    joined = df.join(settle(centroids(df, vector, label)), label)
    spread = F.avg(F.sqrt(squared_distance(F.col(vector), F.col("_centre"))))
    clusters = joined.groupBy(label).agg(spread.alias("_s"), F.first("_centre").alias("_c"))
    listed = clusters.agg(F.collect_list(F.struct(F.col(label).alias("l"), "_s", "_c")).alias("_all"))

    def worst(one: Column) -> Column:
        others = F.filter("_all", lambda other: other["l"] != one["l"])
        return F.array_max(F.transform(others, lambda other: F.try_divide(
            one["_s"] + other["_s"], F.sqrt(squared_distance(one["_c"], other["_c"])))))

    ratios = F.transform("_all", lambda one: F.coalesce(worst(one), F.lit(0.0)))
    total = F.aggregate(ratios, F.lit(0.0), lambda t, x: t + x)
    return listed.select(F.try_divide(total, F.size("_all")).alias("davies_bouldin"))


def silhouette(df: DataFrame, vector: str, label: str, block: int = POINT_BLOCK) -> DataFrame:
    """Exact mean silhouette with Euclidean distance; a cluster of one scores 0.

    Every point needs its distance to every other, but no pair is ever a row: points lie in blocks of
    about ``block``, and every two blocks are a tile, a task of one job that multiplies their
    matrices and gives each point its distances to the other block summed by label. Those sums are
    added per point before they are shuffled. Cost is quadratic in the points (customers,
    not readings); ``squared_silhouette`` is the linear-time alternative.
    """
    points = settle(df.select(F.col(vector).cast("array<double>").alias("_v"), F.col(label).alias("_l"))
                    .withColumn("_id", F.monotonically_increasing_id()))
    # One row a cluster.
    sizes = {r[0]: r[1] for r in points.groupBy("_l").count().collect()}
    labels = sorted(sizes)
    blocks = max(1, -(-sum(sizes.values()) // block))
    number = F.element_at(F.create_map(*[F.lit(x) for i, l in enumerate(labels) for x in (l, i)]), F.col("_l"))
    numbered = points.select("_id", "_v", number.alias("_own"), F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int").alias("_b"))
    left = numbered.withColumn("_i", F.col("_b")).withColumn("_j", F.explode(F.sequence("_b", F.lit(blocks - 1))))
    right = numbered.withColumn("_j", F.col("_b")).withColumn("_i", F.explode(F.sequence(F.lit(0), "_b")))
    tiles = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(
        partial(_tile, n_labels=len(labels)), "_id long, _sums array<double>")
    sums = tiles.groupBy("_id").agg(vector_to_array(Summarizer.sum(array_to_vector("_sums"))).alias("_sums"))
    counts = F.array(*[F.lit(float(sizes[l])) for l in labels])
    means = F.transform(F.zip_with("_sums", counts, lambda s, n: s / n),
                        lambda x, i: F.when(i != F.col("_own"), x))
    scored = numbered.select("_id", "_own").join(sums, "_id").select(
        F.get(counts, F.col("_own")).alias("_n"),
        F.try_divide(F.get("_sums", F.col("_own")), F.get(counts, F.col("_own")) - 1).alias("_a"),
        F.array_min(means).alias("_b"))
    score = F.when(F.col("_n") <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0)))
    return scored.agg(F.avg(score).alias("silueta"))


def _tile(left: pa.Table, right: pa.Table, n_labels: int) -> pa.Table:
    """Per point of two blocks, its distances to the points of the other one (or of its own) by label."""
    out = [np.zeros(0, np.int64)], [np.zeros((0, n_labels))]
    if left.num_rows and right.num_rows:
        a, b = (np.stack(t.column("_v").to_numpy()) for t in (left, right))
        centre = a.mean(axis=0)
        a, b = a - centre, b - centre
        own_a, own_b = (np.eye(n_labels)[np.asarray(t.column("_own"))] for t in (left, right))
        back = np.zeros((len(b), n_labels))
        for at in range(0, len(a), TILE_ROWS):
            rows = a[at:at + TILE_ROWS]
            distances = _distances(rows, b)
            out[0].append(np.asarray(left.column("_id"))[at:at + TILE_ROWS])
            out[1].append(distances @ own_b)
            back += distances.T @ own_a[at:at + TILE_ROWS]
        if left.column("_i")[0] != left.column("_j")[0]:
            out[0].append(np.asarray(right.column("_id")))
            out[1].append(back)
    ids, sums = np.concatenate(out[0]), np.concatenate(out[1])
    return pa.table({"_id": pa.array(ids, pa.int64()), "_sums": pa.array(list(sums), pa.list_(pa.float64()))})


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances by a matrix product; those so small that it loses digits come from differences."""
    lengths = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
    squares = lengths - 2 * (a @ b.T)
    i, j = np.nonzero(squares < 1e-6 * lengths)
    for at in range(0, len(i), 1 << 16):
        some = slice(at, at + (1 << 16))
        squares[i[some], j[some]] = ((a[i[some]] - b[j[some]]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(squares, 0.0))


def squared_silhouette(df: DataFrame, vector: str, label: str) -> float:
    """Mean silhouette with squared Euclidean distance, in one pass over the points."""
    points = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v"),
                       F.col(label).cast("double").alias("_l"))
    return ClusteringEvaluator(
        featuresCol="_v", predictionCol="_l", metricName="silhouette").evaluate(points)


def project_plane(scaled: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two principal components of the scaled profile; the largest loading of each is positive."""
    points = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(scaled)
    centre = points.select(Summarizer.mean(F.col("_v"))).first()[0].toArray()
    axes = PCA(k=2, inputCol="_v", outputCol="_p").fit(points).pc.toArray()
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), [0, 1]] < 0, -1.0, 1.0)
    values = [(F.col(c) - F.lit(float(m))) for c, m in zip(columns, centre)]
    out = [sum((v * F.lit(float(w)) for v, w in zip(values, axes[:, i])), F.lit(0.0)).alias(f"PC{i + 1}")
           for i in range(2)]
    keep = [c for c in (KEY, CLUSTER) if c in scaled.columns]
    return points.select(*keep, *out)
