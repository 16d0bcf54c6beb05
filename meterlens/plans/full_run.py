"""The whole batch: clean, segment, train, detect, report, evaluate."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.operators.evaluate import acceptance, compliance, evaluate, join_assignments
from meterlens.operators.explore import anomaly_report
from meterlens.operators.reports import ObservedReports
from meterlens.params import CLUSTER, METRIC_COLUMNS, Acceptance, Bands, EtlParams, ModelParams, SegmentParams
from meterlens.plans.detection import detect, place, train
from meterlens.plans.etl import clean_readings
from meterlens.plans.segmentation import Segments, segment_customers
from meterlens.session import discard, run_folder, settle
from meterlens.sources.sinks import FittedModel


@dataclass(frozen=True)
class RunParams:
    etl: EtlParams = field(default_factory=EtlParams)
    segment: SegmentParams = field(default_factory=SegmentParams)
    model: ModelParams = field(default_factory=ModelParams)
    bands: Bands = field(default_factory=Bands)
    acceptance: Acceptance = field(default_factory=Acceptance)
    rank_zero: bool = False


@dataclass(frozen=True)
class RunResult:
    readings: DataFrame
    segments: Segments
    fitted: FittedModel
    grid: DataFrame | None
    scored: DataFrame
    report: DataFrame
    metrics: DataFrame | None
    acceptance: DataFrame | None
    compliance: DataFrame | None
    stage_seconds: dict[str, float]
    reports: DataFrame
    #: The folder of all tables that the run wrote for itself.
    folder: str

    def release(self) -> None:
        """Delete the run's tables, after the results that are to be kept were written elsewhere."""
        discard(self.scored.sparkSession, self.folder)

    def times(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.stage_seconds.items()), "etapa string, segundos double")


def run(raw: DataFrame, order, date: str, params: RunParams | None = None,
        labels: DataFrame | None = None, assignments: DataFrame | None = None,
        detected_at: datetime | None = None) -> RunResult:
    """Run every stage. Readings and scored rows are written once; all else is small.

    All tables of the run lie in one folder, until ``release``. ``compliance`` is given without labels, too; only the
    latency is known then. ``reports`` has the quality of the readings after every step of the cleaning, counted in the jobs that
    write them.

    Given ``assignments`` replace the segmentation. ``detected_at`` stamps the report, so that
    a repeated run gives the same rows.
    """
    params = params or RunParams()
    with run_folder(raw.sparkSession) as folder:
        return _run(raw, order, date, params, labels, assignments, detected_at, folder)


def _run(raw: DataFrame, order, date: str, params: RunParams, labels: DataFrame | None, assignments: DataFrame | None,
         detected_at: datetime | None, folder: str) -> RunResult:
    spark = raw.sparkSession
    clock: dict[str, float] = {}

    def timed(name: str, work):
        start = time.monotonic()
        result = work()
        clock[name] = round(time.monotonic() - start, 2)
        return result

    stages = ObservedReports()
    readings = timed("etl_pipeline_seconds",
                     lambda: settle(clean_readings(raw, params.etl, order, date, stages)))

    def segment():
        found = Segments(settle(assignments), 0) if assignments is not None else \
            segment_customers(readings, params.segment)
        joined = join_assignments(readings, found.assignments)
        placed = settle(place(joined, params.model, params.etl.chunk), [CLUSTER])
        return found, placed

    segments, placed = timed("clustering_pipeline_seconds", segment)
    fitted, grid = timed("training_lstm_parallel_seconds",
                         lambda: train(placed, params.etl, params.model, params.rank_zero))
    scored = timed("anomaly_detection_seconds",
                   lambda: settle(detect(placed, fitted, params.etl, params.model, params.bands), [CLUSTER]))
    moment = detected_at or datetime.now()
    flagged = scored.where("anomalia_predicha").withColumn("timestamp_deteccion", F.lit(moment))

    # Without labels the time of detection is all there is to judge.
    metrics = checks = None
    unknown = spark.range(1).select(*[F.lit(None).cast("double").alias(c) for c in METRIC_COLUMNS])
    report = compliance(unknown, params.acceptance, clock["anomaly_detection_seconds"])
    if labels is not None and not labels.isEmpty():
        metrics = timed("system_evaluation_seconds", lambda: settle(evaluate(scored, labels)))
        checks = acceptance(metrics, params.acceptance)
        report = compliance(metrics, params.acceptance, clock["anomaly_detection_seconds"])
    return RunResult(readings, segments, fitted, grid, scored, anomaly_report(flagged), metrics,
                     checks, report, clock, stages.table(spark), folder)
