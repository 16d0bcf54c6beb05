"""Time the headline stages and queries; prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1); BENCH_CPUS: local threads.
The batch runs stage by stage as in production: readings are cleaned and written, customers
are segmented, one model per segment is trained, every reading is scored, the scores are
evaluated. Exploration queries then run over the written tables. One untimed pass over a
smaller copy of the tables, where there is one, warms the JVM up.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from meterlens.operators import explore as x  # noqa: E402
from meterlens.operators.clean import READING_ALIASES, rename_aliases  # noqa: E402
from meterlens.operators.evaluate import evaluate, join_assignments  # noqa: E402
from meterlens.operators.outliers import cap_outliers  # noqa: E402
from meterlens.operators.profile import build_profile  # noqa: E402
from meterlens.operators.quality import describe  # noqa: E402
from meterlens.params import CLUSTER, Bands, EtlParams, Filters, ModelParams, SegmentParams  # noqa: E402
from meterlens.plans.dashboard import explore  # noqa: E402
from meterlens.plans.detection import detect, place, train  # noqa: E402
from meterlens.plans.etl import clean_readings  # noqa: E402
from meterlens.plans.segmentation import segment_customers  # noqa: E402
from meterlens.session import build_session, scratch, settle  # noqa: E402
from meterlens.sources import fixtures as fx  # noqa: E402


def stages(spark, folder: str) -> tuple[dict[str, float], int]:
    etl, model, bands = EtlParams(), ModelParams(), Bands()
    clock: dict[str, float] = {}

    def timed(name, work):
        start = time.perf_counter()
        result = work()
        clock[name] = round(time.perf_counter() - start, 3)
        return result

    raw = fx.readings_raw(spark, folder)
    readings = timed("etl", lambda: settle(clean_readings(raw, etl, "seq", "fecha_txt")))
    rows = readings.count()
    found = timed("segmentation", lambda: segment_customers(readings, SegmentParams()))
    placed = timed("split", lambda: settle(
        place(join_assignments(readings, found.assignments), model, etl.chunk), [CLUSTER]))
    fitted, _ = timed("training", lambda: train(placed, etl, model))
    scored = timed("detection", lambda: settle(detect(placed, fitted, etl, model, bands)))
    timed("detection_rank_zero", lambda: settle(
        detect(placed, train(placed, etl, model, rank_zero=True)[0], etl, model, bands)))
    labels = settle(fx.ground_truth(spark, folder))
    timed("evaluation", lambda: evaluate(scored, labels).collect())

    view = rename_aliases(scored, READING_ALIASES)
    alerts = settle(x.with_row_id(view.where("anomalia_predicha"), ["cliente_id", "datetime"]))
    selection = Filters(cluster_id=0, variable="Volumen")

    def panels():
        for panel in explore(view, alerts, selection).values():
            panel.collect()

    timed("dashboard", panels)
    lines = fx.table(spark, folder, "lineitem")
    meter = lines.selectExpr("cast(l_suppkey AS string) AS cliente_id", "cast(l_shipdate AS timestamp) AS Fecha",
                             "l_extendedprice AS Volumen", "l_quantity AS Presion", "l_discount AS Temperatura")
    timed("describe_order_lines", lambda: describe(
        lines.select("l_quantity", "l_extendedprice", "l_discount", "l_tax")).collect())
    timed("profile_order_lines", lambda: build_profile(
        meter, ["Volumen_mean", "Volumen_std", "Presion_median", "Volumen_cv"]).collect())
    timed("cap_order_lines", lambda: cap_outliers(
        meter, ["Volumen", "Presion"], EtlParams(chunk="year")).write.format("noop").mode("overwrite").save())
    timed("correlation_order_lines", lambda: x.correlation(meter).collect())
    timed("monthly_pattern_order_lines", lambda: x.temporal_pattern(
        meter.selectExpr("month(Fecha) AS mes", "Volumen"), "mes", "Volumen").collect())
    return clock, rows


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # At this size every partition is below AQE's usual minimum and would be merged into one
    # task; a smaller minimum keeps the cores busy and still merges the tiny tables.
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
        spark__sql__adaptive__coalescePartitions__minPartitionSize="128k",
        spark__sql__codegen__cache__maxEntries="2000")
    spark.sparkContext.setLogLevel("ERROR")
    small = Path(folder).parent / "sf0.001"
    if small.exists() and small != Path(folder):
        with scratch(spark):
            stages(spark, str(small))
    with scratch(spark):
        clock, rows = stages(spark, folder)
    batch = ("etl", "segmentation", "split", "training", "detection", "evaluation")
    print(json.dumps({
        "metric": "batch run and exploration, wall-clock", "value": round(sum(clock.values()), 3), "unit": "sec",
        "queries": clock, "sf": Path(folder).name.removeprefix("sf"), "readings": rows,
        "batch_seconds": round(sum(clock[k] for k in batch), 3),
        "readings_per_second": {k: round(rows / clock[k]) for k in ("etl", "detection")}}))


if __name__ == "__main__":
    main()
