"""Hard negatives by threshold joins: an inverted index behind norm bounds, and thresholds that fall until windows fill.

Components x become floor(256 x), and a score is the integer inner product. For every anchor the
``positives`` best rows of its label are sought, then for each of those the ``negatives`` best rows of
other labels whose score lies in a window below the positive's.

A join finds, for every anchor, the rows whose score reaches its threshold. Rows and anchors meet in
pieces (``ROWS`` rows, ``ANCHORS`` anchors, each pair of pieces in a task of its own). A task indexes its
rows by dimension, the strongest dimension first; a row's last dimensions are left out as soon as the
norm of what is left of it, times an anchor's, cannot reach any threshold of the task. Anchors go
through the index a few dimensions at a time and gather partial scores; a pair is dropped when the
partial score and the product of the remaining norms stay below its threshold. What is left is
scored in full, exactly.

Thresholds start high. Anchors (or windows) that did not fill go on to the next round with a lower
threshold, the last of which is the window's lower end, or none at all for positives. A task returns
its best few of each window only, which is all that can be among the best overall, so no group is
large, and equal vectors in any number do no harm. Starting points come from an approximate median
norm; they change the work, not the result.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part, nor
do rows without an id. Equal rows count once; other rows of an id are rows of their own, but an
anchor's own id is never its partner. Vectors of different lengths meet in the dimensions that both
have; an empty vector scores 0. A positive score below 0 has an empty window. Scores beyond 64 bits
are held at its ends. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlens.session import settle

#: Rows and anchors that meet in a task, dimensions taken at a time, and up to where doubles add whole numbers exactly.
ROWS, ANCHORS, STEP, EXACT = 4096, 1024, 8, float(1 << 52)
#: Thresholds of positives as shares of the anchor's norm times the median norm, and how much of a window is open, by round.
FALLING, OPEN = (0.8, 0.56, 0.4, 0.28, 0.2, 0.1, None), (0.05, 0.15, 0.4, 1.0)
FOUND = "anchor_id long, variant long, slot int, vec_id long, other long, score long"
FOUND_FIELDS = pa.schema([("anchor_id", pa.int64()), ("variant", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()),
                          ("other", pa.int64()), ("score", pa.int64())])
ANCHOR = ["anchor_id", "variant"]


@dataclass(frozen=True)
class NegativeParams:
    anchor_every: int = 100
    positives: int = 5
    negatives: int = 10
    #: The window, in hundredths of the positive's score.
    low: int = 30
    high: int = 90
    #: Rows whose id this divides get the next of ``labels`` labels.
    relabel_every: int = 7
    labels: int = 10


def usable(vectors: DataFrame, params: NegativeParams) -> DataFrame:
    """(vec_id, variant, label, vec, norm) of the rows that take part; variant tells rows of an id apart."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("e")).where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND forall(e, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    moved = F.when(F.col("vec_id") % params.relabel_every == 0, (F.col("label") + 1) % params.labels).otherwise(F.col("label"))
    # From 2 ** 44 on, 256 x is whole.
    whole = F.transform("e", lambda x: F.when(F.abs(x) < float(1 << 44), F.floor(x * 256).cast("double")).otherwise(x * 256))
    rows = rows.select("vec_id", moved.alias("label"), whole.alias("vec"))
    rows = rows.withColumn("variant", F.xxhash64("label", "vec")).dropDuplicates(["vec_id", "variant"])
    return rows.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors side by side, short ones filled with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = np.asarray(column.flatten())
    return out


def reaching(rows: np.ndarray, anchors: np.ndarray, least: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row), of those that are allowed, that may score ``least`` of the anchor or more.

    Rows lie by how many dimensions of theirs are indexed, so the postings of a dimension are the
    first rows, and anchors take the postings of ``STEP`` dimensions at a time.
    """
    strongest = np.argsort(-(rows * rows).sum(axis=0), kind="stable")
    rows, anchors = rows[:, strongest], anchors[:, strongest]
    width, slack = rows.shape[1], 1 + 1e-9

    def remaining(x: np.ndarray) -> np.ndarray:
        """Norm of each vector from each dimension on."""
        squares = np.concatenate([np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1)
        return np.sqrt(squares) * slack

    left, mine = remaining(rows), remaining(anchors)
    # What is left of a row from here on reaches no anchor's threshold.
    ratio = np.min(least / np.maximum(mine[:, 0], 1e-300)) if len(least) else 0.0
    depth = (~(left[:, :-1] < ratio)).sum(axis=1)
    depth = np.minimum(-(-depth // STEP) * STEP, width)
    by_depth = np.argsort(-depth, kind="stable")
    rows, left, depth, allowed = rows[by_depth], left[by_depth], depth[by_depth], allowed[:, by_depth]
    n = int((depth > 0).sum())
    partial = np.zeros((len(anchors), n))
    alive = allowed[:, :n].copy()
    pairs = []
    for at in range(0, width, STEP):
        n = int((depth > at).sum())
        if n < partial.shape[1]:
            # The index ends for these rows; what may still come is bounded by both norms.
            pairs.append(np.argwhere(alive[:, n:]) + [0, n])
            partial, alive = partial[:, :n], alive[:, :n]
        if not n:
            break
        partial += anchors[:, at:at + STEP] @ rows[:n, at:at + STEP].T
        end = min(width, at + STEP)
        # Bounds with room for rounding; one that is no number drops nothing.
        rest = mine[:, [end, 0]] @ (left[:n, [end, 0]] * [1, 1e-12]).T
        alive &= ~(partial + rest < least[:, None])
        if alive.sum() * 16 < alive.size:
            # Few are left: they are scored one by one.
            pairs.append(np.argwhere(alive))
            partial = partial[:, :0]
            break
    if partial.shape[1]:
        pairs.append(np.argwhere(alive))
    found = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    return found[:, 0], by_depth[found[:, 1]]


def exact_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of pairs as whole numbers, held within 64 bits."""
    out = np.empty(len(anchors), np.int64)
    bound = np.sqrt((anchors * anchors).sum(axis=1)) * np.sqrt((rows * rows).sum(axis=1))
    small = bound < EXACT
    out[small] = np.einsum("ij,ij->i", anchors[small], rows[small]).astype(np.int64)
    for k in np.flatnonzero(~small).tolist():
        whole = sum(int(x) * int(y) for x, y in zip(anchors[k].tolist(), rows[k].tolist()))
        out[k] = max(-(1 << 63), min((1 << 63) - 1, whole))
    return out


def threshold_join(rows: DataFrame, anchors: DataFrame, keep: int, other_label: bool, params: NegativeParams) -> DataFrame:
    """The best ``keep`` rows that each task finds for every window of an anchor.

    anchors: (anchor_id, variant, label, vec, windows), windows being a list of (slot, least, upper):
    scores from least (null: any) to ``high`` hundredths of upper (null: any), none below ``low`` hundredths.
    """

    def pieces(table: DataFrame, size: int) -> int:
        return max(1, -(-table.count() // size))

    row_pieces, anchor_pieces = pieces(rows, ROWS), pieces(anchors, ANCHORS)

    def dealt(table: DataFrame, id_column: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return table.withColumn(own, F.pmod(F.xxhash64(id_column, "variant"), F.lit(n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def run(anchor: pa.Table, row: pa.Table) -> pa.Table:
        if not anchor.num_rows or not row.num_rows:
            return FOUND_FIELDS.empty_table()
        width = max(1, *(int(max(np.asarray(t.column("vec").combine_chunks().value_lengths()), default=0)) for t in (anchor, row)))
        left, right = matrix(anchor.column("vec"), width), matrix(row.column("vec"), width)
        ids, own, variants, others = (np.asarray(t.column(c)) for t, c in (
            (row, "vec_id"), (anchor, "anchor_id"), (row, "variant"), (anchor, "variant")))
        same = np.asarray(anchor.column("label"))[:, None] == np.asarray(row.column("label"))[None, :]
        allowed = (same != other_label) & (own[:, None] != ids[None, :])
        windows = anchor.column("windows").to_pylist()
        least = np.array([min(-np.inf if w["least"] is None else w["least"] for w in ws) for ws in windows])
        out = []
        order = np.argsort(-least / np.maximum(np.sqrt((left * left).sum(axis=1)), 1e-300), kind="stable")
        for at in range(0, len(order), 128):
            some = order[at:at + 128]
            a, r = reaching(right, left[some], least[some], allowed[some])
            for cut in range(0, 128):
                mine = r[a == cut] if len(a) else r
                if not len(mine):
                    continue
                k = some[cut]
                scores = exact_scores(np.broadcast_to(left[k], (len(mine), width)), right[mine])
                best = np.lexsort((variants[mine], ids[mine], -scores))
                mine, scores = mine[best], scores[best]
                for w in windows[k]:
                    fits = np.ones(len(mine), bool)
                    if w["upper"] is not None:
                        # Whole numbers: Python's, where hundredfold scores may pass 64 bits.
                        low, high = -(-params.low * w["upper"] // 100), params.high * w["upper"] // 100
                        fits &= (scores >= low) & (scores <= high)
                    if w["least"] is not None:
                        fits &= scores >= w["least"]
                    chosen = np.flatnonzero(fits)[:keep]
                    out.append((np.full(len(chosen), own[k]), np.full(len(chosen), others[k]), np.full(len(chosen), w["slot"], np.int32),
                                ids[mine[chosen]], variants[mine[chosen]], scores[chosen]))
        if not out:
            return FOUND_FIELDS.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*out), FOUND_FIELDS)], schema=FOUND_FIELDS)

    asked = dealt(anchors.select(*ANCHOR, "label", "vec", "windows"), "anchor_id", "j", anchor_pieces, "i", row_pieces)
    given = dealt(rows.select("vec_id", "variant", "label", "vec"), "vec_id", "i", row_pieces, "j", anchor_pieces)
    return asked.groupBy("i", "j").cogroup(given.groupBy("i", "j")).applyInArrow(run, FOUND)


def first_of(found: DataFrame, keep: int) -> DataFrame:
    """With rank: the first ``keep`` of each window by score, ties by smaller id."""
    order = Window.partitionBy(*ANCHOR, "slot").orderBy(F.desc("score"), "vec_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def in_rounds(rows: DataFrame, windows: DataFrame, anchors: DataFrame, keep: int, other_label: bool, least: list[Column], params: NegativeParams) -> DataFrame:
    """The first ``keep`` rows of every window (anchor, slot, upper), from thresholds that fall."""
    done, waiting = None, windows
    for k, threshold in enumerate(least):
        asked = waiting.groupBy(*ANCHOR).agg(F.collect_list(F.struct("slot", threshold.cast("long").alias("least"), "upper")).alias("windows"))
        found = settle(first_of(threshold_join(rows, settle(anchors.join(asked, ANCHOR)), keep, other_label, params), keep))
        if k + 1 == len(least):
            filled = found
        else:
            full = found.groupBy(*ANCHOR, "slot").count().where(F.col("count") >= keep).drop("count")
            filled = found.join(full, [*ANCHOR, "slot"])
            waiting = settle(waiting.join(full, [*ANCHOR, "slot"], "left_anti"))
        done = filled if done is None else done.unionByName(filled)
        if k + 1 < len(least) and waiting.isEmpty():
            break
    return done


def hard_negatives(vectors: DataFrame, params: NegativeParams = NegativeParams()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = settle(usable(vectors, params))
    # One row.
    median = rows.agg(F.percentile_approx("norm", 0.5).alias("m")).first()["m"] or 0.0
    anchors = settle(rows.where(F.col("vec_id") % params.anchor_every == 0).withColumnRenamed("vec_id", "anchor_id"))
    scale = F.least(F.ceil(F.col("norm") * median), F.lit(float(1 << 62)))
    windows = anchors.select(*ANCHOR, "norm", F.lit(0).alias("slot"), F.lit(None).cast("long").alias("upper"))
    falling = [F.lit(None) if s is None else F.lit(s) * scale for s in FALLING]
    positives = settle(in_rounds(rows, windows, anchors, params.positives, False, falling, params))
    upper = F.col("upper").cast("double")
    open_to = [upper * params.high / 100 - F.lit(share * (params.high - params.low) / 100) * upper - F.lit(1e-9) * upper - 1 for share in OPEN]
    windows = positives.where("score >= 0").select(*ANCHOR, F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("upper"))
    negatives = in_rounds(rows, windows.drop("positive_id"), anchors, params.negatives, True, open_to, params)
    return negatives.join(windows.withColumnRenamed("upper", "positive_score"), [*ANCHOR, "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH rows AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
