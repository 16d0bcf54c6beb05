"""Approximate nearest neighbours by inner product: NN-descent as Spark joins, then greedy graph search.

Equal vectors are one node; a node keeps the smallest ids it stands for. The graph starts from
neighbours within cells of random hyperplanes (a crowded cell is cut into pieces). A round of
descent brings, to every node, its neighbours and a sample of those whose neighbour it is, with
their vectors rounded to bytes; all of them that have not met there before are compared, and a
pair that is better than what one of them has is proposed to it. Rounds end when hardly anything
improves or after ``rounds``. A query starts from its own node's neighbours; in each step of the search its
unvisited best nodes compare all their neighbours with it, until nothing better turns up or after
``steps``. Scores are then computed in double precision on the original vectors.

The graph indexes every vector; ``degree`` bounds neighbours, as the method has it. Recall against
brute force is measured by the tests (0.9 or more). Python tasks hold one group at a time: a cell
piece (``2 * cell`` vectors) or one node's lists (``2 * degree`` on average).

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part,
nor do those of another length than the most frequent one (ties: the larger) or rows with a null
id. Repeated rows of an id and vector count once. Fewer candidates than asked for give fewer rows;
an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlens.llm.common import small_batches, unit_hash, whole_groups
from meterlens.session import settle

#: Queries that a node answers in one task.
CALLERS = 4096
EDGE = "node long, other long, score double, fresh boolean"


@dataclass(frozen=True)
class GraphParams:
    degree: int = 48
    trees: int = 8
    cell: int = 1024
    per_cell: int = 14
    rounds: int = 6
    proposals: int = 8
    #: A round that improves less than this share of all edges is the last.
    settled: float = 0.01
    steps: int = 3
    seed: int = 41


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec) of vectors that take part; vec is the components as doubles."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e")).where(
        "vec_id IS NOT NULL AND size(e) > 0 AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) "
        "AND exists(e, x -> x != 0)")
    size = rows.groupBy(F.size("e").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size("e") == (size["size"] if size else 0))

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                # Adding 0.0 makes the two zeros one.
                values = np.asarray(batch.column("e").flatten()).reshape(batch.num_rows, -1) + 0.0
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([v.tobytes() for v in values], pa.binary())], names=["vec_id", "vec"])

    small_batches(vectors.sparkSession)
    return rows.mapInArrow(pack, "vec_id long, vec binary")


def as_matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, n, vec, code, scale): distinct vectors under their smallest id, and rounded to bytes."""
    distinct = rows.groupBy("vec").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("n"))

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                vec = as_matrix(batch.column("vec"))
                scale = np.abs(vec).max(axis=1) / 127
                codes = np.rint(vec / scale[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), batch.column("vec"),
                                                  pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale)],
                                                 names=["node", "n", "vec", "code", "scale"])

    return distinct.select("node", "n", "vec").mapInArrow(code, "node long, n long, vec binary, code binary, scale double")


def members(rows: DataFrame, nodes: DataFrame, keep: int) -> DataFrame:
    """(node, vec_id) of the smallest ``keep`` ids of nodes that stand for several rows.

    Tasks keep the smallest ids of what they read, so little is left of a node that is a third of all rows.
    """
    several = nodes.where("n > 1").select("node", "vec")
    pairs = rows.join(several, "vec").select("node", "vec_id")

    def smallest(batches):
        for batch in batches:
            if batch.num_rows:
                node, ids = np.unique(np.stack([np.asarray(batch.column(c)) for c in ("node", "vec_id")]), axis=1)
                starts = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, int)
                rank = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
                yield pa.RecordBatch.from_arrays([pa.array(node[rank < keep]), pa.array(ids[rank < keep])], names=["node", "vec_id"])

    few = pairs.mapInArrow(smallest, "node long, vec_id long").distinct()
    order = Window.partitionBy("node").orderBy("vec_id")
    return few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).drop("rank")


def similarities(codes: np.ndarray, scales: np.ndarray, other: np.ndarray, other_scales: np.ndarray) -> np.ndarray:
    """Products of bytes are whole numbers below 2 ** 24, so single precision adds them exactly."""
    return (codes @ other.T).astype(np.float64) * (scales[:, None] * other_scales)


def edges_batch(node, other, score, fresh=True) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(other), pa.array(score), pa.array(np.full(len(node), fresh))],
                                      names=["node", "other", "score", "fresh"])


def first_edges(nodes: DataFrame, n: int, params: GraphParams) -> DataFrame:
    """Neighbours within cells of random hyperplanes."""
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / params.cell))))

    def cells(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = as_matrix(batch.column("code"), np.int8).astype(np.float32)
            for tree in range(params.trees):
                planes = np.random.default_rng([params.seed, tree]).normal(size=(codes.shape[1], bits)).astype(np.float32)
                cell = ((codes @ planes) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(codes), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell * params.trees + tree), batch.column("node"), batch.column("code"), batch.column("scale")],
                    names=["cell", "node", "code", "scale"])

    placed = settle(nodes.select("node", "code", "scale").mapInArrow(cells, "cell long, node long, code binary, scale double"))
    crowded = placed.groupBy("cell").count().where(F.col("count") > 2 * params.cell).select(
        "cell", F.ceil(F.col("count") / params.cell).alias("pieces"))
    dealt = placed.join(crowded, "cell", "left").withColumn(
        "piece", F.pmod(F.xxhash64("node"), F.coalesce("pieces", F.lit(1)))).select("cell", "piece", "node", "code", "scale")
    dealt = dealt.repartition("cell", "piece").sortWithinPartitions("cell", "piece", "node")

    def compare(batches):
        for batch, starts in whole_groups(batches, ["cell", "piece"]):
            node, scale = np.asarray(batch.column("node")), np.asarray(batch.column("scale"))
            codes = as_matrix(batch.column("code"), np.int8).astype(np.float32)
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
                if b - a < 2:
                    continue
                scores = similarities(codes[a:b], scale[a:b], codes[a:b], scale[a:b])
                np.fill_diagonal(scores, -np.inf)
                k = min(params.per_cell, b - a - 1)
                best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                yield edges_batch(np.repeat(node[a:b], k), node[a:b][best.ravel()], np.take_along_axis(scores, best, axis=1).ravel())

    return dealt.mapInArrow(compare, EDGE)


def best_edges(edges: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` best distinct neighbours of each node; an edge that was there before is not fresh."""
    dealt = edges.repartition("node").sortWithinPartitions("node", F.desc("score"), "other", "fresh")

    def cut(batches):
        for batch, starts in whole_groups(batches, ["node"]):
            node, other, score = (np.asarray(batch.column(c)) for c in ("node", "other", "score"))
            new = np.ones(len(node), bool)
            new[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
            starts = starts[starts < len(node)]
            counted = np.cumsum(new)
            rank = counted - np.repeat(counted[starts], np.diff(np.append(starts, len(node))))
            yield batch.filter(pa.array(new & (rank < degree)))

    return dealt.mapInArrow(cut, EDGE)


def neighbourhoods(edges: DataFrame, degree: int, turn: int) -> DataFrame:
    """(at, node, fresh): who meets at a node, its neighbours and about ``degree`` of those it is a neighbour of."""
    back = edges.select(F.col("other").alias("at"), "node", "fresh")
    popular = back.groupBy("at").count().where(F.col("count") > degree).select("at", (F.lit(float(degree)) / F.col("count")).alias("share"))
    sampled = back.join(popular, "at", "left").where(
        F.col("share").isNull() | (unit_hash("at", "node", F.lit(turn)) < F.col("share"))).drop("share")
    return edges.select(F.col("node").alias("at"), F.col("other").alias("node"), "fresh").unionByName(sampled)


def with_vectors(lists: DataFrame, edges: DataFrame, nodes: DataFrame, degree: int) -> DataFrame:
    """Adds code, scale and ``worst``, the score that a proposal to the node has to beat."""
    worst = edges.groupBy("node").agg(F.when(F.count(F.lit(1)) >= degree, F.min("score")).otherwise(float("-inf")).alias("worst"))
    known = nodes.select("node", "code", "scale").join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf"))))
    return lists.join(known, "node")


def descend(edges: DataFrame, nodes: DataFrame, params: GraphParams, turn: int) -> DataFrame:
    """Edges after one round."""
    met = with_vectors(neighbourhoods(edges, params.degree, turn), edges, nodes, params.degree)
    dealt = met.repartition("at").sortWithinPartitions("at", "node", "fresh")

    def compare(batches):
        for batch, starts in whole_groups(batches, ["at"]):
            node, scale, worst = (np.asarray(batch.column(c)) for c in ("node", "scale", "worst"))
            fresh = np.asarray(batch.column("fresh").to_numpy(zero_copy_only=False), bool)
            codes = as_matrix(batch.column("code"), np.int8).astype(np.float32)
            out = []
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
                rows = a + np.flatnonzero(np.append(True, node[a + 1:b] != node[a:b - 1]))
                if len(rows) < 2:
                    continue
                scores = similarities(codes[rows], scale[rows], codes[rows], scale[rows])
                new = np.logical_or.reduceat(fresh[a:b], rows - a)
                scores[~(new[:, None] | new)] = -np.inf
                np.fill_diagonal(scores, -np.inf)
                k = min(params.proposals, len(rows) - 1)
                best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                score = np.take_along_axis(scores, best, axis=1)
                i, j = np.nonzero(score > worst[rows][:, None])
                out.append((node[rows[i]], node[rows[best[i, j]]], score[i, j]))
            if out:
                yield edges_batch(*(np.concatenate(c) for c in zip(*out)))

    proposals = dealt.mapInArrow(compare, EDGE)
    return best_edges(edges.withColumn("fresh", F.lit(False)).unionByName(proposals), params.degree)


def build_graph(nodes: DataFrame, params: GraphParams = GraphParams()) -> DataFrame:
    """(node, other, score, fresh): the neighbour graph of all nodes."""
    small_batches(nodes.sparkSession)
    n = nodes.count()
    edges = settle(best_edges(first_edges(nodes, n, params), params.degree))
    for turn in range(params.rounds):
        edges = settle(descend(edges, nodes, params, turn))
        changed = edges.agg(F.count_if("fresh"), F.count(F.lit(1))).first()
        if changed[0] <= params.settled * changed[1]:
            break
    return edges


def search(queries: DataFrame, edges: DataFrame, nodes: DataFrame, params: GraphParams = GraphParams()) -> DataFrame:
    """(node, other, score): the best nodes found from each query node, by rounded vectors.

    A step sends the query's vector to those of its best nodes that it has not visited; each compares
    its neighbours with all queries that came. ``fresh`` marks what is not visited yet.
    """
    found = settle(edges.join(queries, "node", "left_semi").withColumn("fresh", F.lit(True)))
    near = neighbourhoods(edges, params.degree, -1)
    for _ in range(params.steps):
        asks = found.where("fresh").select(F.col("other").alias("at"), "node")
        # A node that very many queries visit answers them in pieces.
        pieces = settle(asks.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / CALLERS).alias("pieces")))
        asking = with_vectors(asks, found, nodes, params.degree).join(pieces, "at").select(
            "at", F.pmod(F.xxhash64("node"), F.col("pieces")).alias("piece"), "node", "code", "scale", "worst", F.lit(True).alias("asks"))
        asked = with_vectors(near.join(pieces.select("at"), "at", "left_semi"), edges, nodes, params.degree).join(pieces, "at").select(
            "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), "node", "code", "scale",
            F.lit(0.0).alias("worst"), F.lit(False).alias("asks"))
        dealt = asking.unionByName(asked).repartition("at", "piece").sortWithinPartitions("at", "piece", "asks", "node")

        def compare(batches):
            for batch, starts in whole_groups(batches, ["at", "piece"]):
                node, scale, worst = (np.asarray(batch.column(c)) for c in ("node", "scale", "worst"))
                asks = np.asarray(batch.column("asks").to_numpy(zero_copy_only=False), bool)
                codes = as_matrix(batch.column("code"), np.int8).astype(np.float32)
                out = []
                for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
                    middle = a + int((~asks[a:b]).sum())
                    if middle in (a, b):
                        continue
                    scores = similarities(codes[middle:b], scale[middle:b], codes[a:middle], scale[a:middle])
                    i, j = np.nonzero((scores > worst[middle:b, None]) & (node[middle:b, None] != node[a:middle]))
                    out.append((node[middle + i], node[a + j], scores[i, j]))
                if out:
                    yield edges_batch(*(np.concatenate(c) for c in zip(*out)))

        found = settle(best_edges(found.withColumn("fresh", F.lit(False)).unionByName(dealt.mapInArrow(compare, EDGE)), params.degree))
        if not found.where("fresh").limit(1).count():
            break
    return found.select("node", "other")


def exact_scores(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, other, score) with the inner products of the original vectors in double precision."""
    vectors = nodes.select("node", "vec")
    rows = found.join(vectors, "node").join(vectors.select(F.col("node").alias("other"), F.col("vec").alias("other_vec")), "other")

    def product(batches):
        for batch in batches:
            if batch.num_rows:
                score = (as_matrix(batch.column("vec")) * as_matrix(batch.column("other_vec"))).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("other"), pa.array(score)], names=["node", "other", "score"])

    return rows.select("node", "other", "vec", "other_vec").mapInArrow(product, "node long, other long, score double")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, params: GraphParams = GraphParams()) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is divisible by ``every`` the k nearest others found."""
    rows = settle(usable(vectors))
    nodes = settle(nodes_of(rows.distinct()))
    queries = settle(rows.where(F.col("vec_id") % every == 0).distinct().join(nodes.select("node", "vec"), "vec").select(
        F.col("vec_id").alias("query_id"), "node"))
    asked = settle(queries.select("node").distinct())
    found = search(asked, build_graph(nodes, params), nodes, params)
    # The query's own node stands for other rows, too.
    scored = settle(exact_scores(found.unionByName(asked.select("node", F.col("node").alias("other"))).distinct(), nodes))
    several = settle(members(rows, nodes, k + 1))
    every_id = nodes.select("node", F.col("node").alias("vec_id")).unionByName(several).distinct()
    best = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    answers = settle(scored.join(every_id.select(F.col("node").alias("other"), "vec_id"), "other").withColumn(
        "place", F.row_number().over(best)).where(F.col("place") <= k + 1).select("node", "vec_id", "score", "place"))
    own = queries.join(answers, "node").where("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy("place")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
