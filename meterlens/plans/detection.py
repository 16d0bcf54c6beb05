"""Train one reconstruction model per cluster and score every reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.operators.blocks import score_blocks, training_blocks, unpacked, unpacked_training
from meterlens.operators.grams import fit_components, gram_of_blocks
from meterlens.operators.reconstruct import ERROR, MODEL_SCHEMA, block_errors, fit_thresholds, flag, grid_of_grams
from meterlens.operators.scale import apply_scaler, fit_scaler
from meterlens.operators.split import SPLIT, split_chronologically
from meterlens.params import CLUSTER, Bands, EtlParams, ModelParams
from meterlens.session import settle
from meterlens.sources.sinks import FittedModel

INTERNAL = ("_pos", "_total", "_chunk", "_cluster_pos", SPLIT)


def place(readings: DataFrame, params: ModelParams, unit: str = "auto") -> DataFrame:
    """Rows that have a cluster, with position and split label of their customer's series."""
    kept = readings.where(F.col(CLUSTER) != -1)
    return split_chronologically(kept, params.test_size, params.validation_size, unit)


def train(placed: DataFrame, etl: EtlParams, params: ModelParams, rank_zero: bool = False
          ) -> tuple[FittedModel, DataFrame | None]:
    """Scaler, model and thresholds per cluster, and the grid that was tried.

    ``placed`` should be a written table. It is read twice, whatever the number of clusters and ranks: for
    the Gram table, from which models and grid losses follow, and for the errors behind the
    thresholds. Windows exist in the tasks only. A cluster without training windows gets no
    model and so no flags; its scaler is kept.
    """
    columns = etl.numeric_columns(placed.columns)
    basis = placed.where(F.col(SPLIT) == "train") if params.fit_on == "train" else placed
    scaler = settle(fit_scaler(basis.drop("cliente_id"), columns, params.scaling))
    scaled = apply_scaler(placed, columns, scaler)
    width = len(params.features)
    blocks = training_blocks(scaled, params.features, params.seq_len, params.boundary)
    grams = settle(gram_of_blocks(blocks, params.seq_len, width))
    grid = None
    if rank_zero:
        model = settle(fit_components(grams, 0).select(*MODEL_SCHEMA.names))
    else:
        model, grid = grid_of_grams(grams, params.grid)
    errors = unpacked_training(block_errors(blocks, model, params.seq_len, width), ERROR, ERROR)
    thresholds = settle(fit_thresholds(errors, params.detection_sigma).where("umbral IS NOT NULL"))
    return FittedModel(model, scaler, thresholds), grid


def detect(placed: DataFrame, fitted: FittedModel, etl: EtlParams, params: ModelParams,
           bands: Bands) -> DataFrame:
    """Score all rows of all clusters in one plan, training rows included."""
    scaled = apply_scaler(placed, etl.numeric_columns(placed.columns), fitted.scaler)
    if any(f not in scaled.columns for f in params.features):
        scaled = scaled.limit(0)  # without its features a cluster is left out of the result
    blocks = score_blocks(scaled, params.features, params.seq_len, params.boundary)
    errors = unpacked(block_errors(blocks, fitted.model, params.seq_len, len(params.features)), ERROR, ERROR)
    scored = flag(errors, fitted.thresholds, bands, params.label)
    return scored.drop(*INTERNAL)
