"""Sources, sinks, exploration edge cases, full runs and the shape of the plans."""

import re
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import queries as q
from meterlens.operators import explore as x
from meterlens.operators.clean import keep_first
from meterlens.operators.evaluate import join_assignments
from meterlens.operators.impute import fill_gaps
from meterlens.params import REPORT_COLUMNS, EtlParams, Filters, ModelParams, SegmentParams
from meterlens.plans.dashboard import explore
from meterlens.plans.detection import detect, place, train
from meterlens.plans.etl import QualityReports, clean_readings
from meterlens.plans.full_run import RunParams, run
from meterlens.plans.segmentation import segment_customers
from meterlens.session import checkpoint_root, settle
from meterlens.sources import fixtures as fx
from meterlens.sources.readings import (
    LOAD_ORDER, RAW_DATE, read_csv_sources, read_labels, read_parquet_sources, read_table, rejected_sources,
)
from meterlens.sources.sinks import write_by_cluster, write_csv, write_report
from tests.conftest import rows

START = datetime(2024, 1, 1)


# --- sources and sinks --------------------------------------------------------------------

@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "2023").mkdir()
    (tmp_path / "CLIENTE 1 .csv").write_text(
        "Fecha,Presion,Temperatura,Volumen,nota\n2024-01-01 00:00:00,1,2,3,x\n2024-01-01 01:00:00,,mal,4.5,y\n")
    (tmp_path / "2023" / "C+2.csv").write_text(
        "﻿Volumen,Fecha,Temperatura,Presion\r\n30,2023-01-01 00:00:00,20,10\r\n")
    (tmp_path / "sin_volumen.csv").write_text("Fecha,Presion,Temperatura\n2024-01-01,1,2\n")
    (tmp_path / "vacio.csv").write_text("")
    (tmp_path / "otro.txt").write_text("Fecha,Presion,Temperatura,Volumen\n2024-01-01,1,2,3\n")
    return tmp_path


def test_csv_sources(spark, folder):
    got = read_csv_sources(spark, str(folder))
    assert rows(got, "cliente_id", RAW_DATE, "Presion", "Temperatura", "Volumen") == [
        ("C+2", "2023-01-01 00:00:00", 10.0, 20.0, 30.0),
        ("CLIENTE 1", "2024-01-01 00:00:00", 1.0, 2.0, 3.0),
        ("CLIENTE 1", "2024-01-01 01:00:00", None, None, 4.5)]
    assert clean_readings(got, EtlParams(chunk="day"), LOAD_ORDER, RAW_DATE).count() == 3


def test_rejected_sources_have_a_reason(spark, folder):
    (folder / "latin.csv").write_bytes("Fecha,Presion,Temperatura,Volumen,a\xf1o\n2024-01-01,1,2,3,4\n".encode("latin-1"))
    (folder / "linea.csv").write_text("\n")
    got = rows(rejected_sources(spark, str(folder)), "cliente_id", "reason")
    # Scans pass over a file without a byte, so it is not listed.
    assert got == [("latin", "the header is not utf-8"), ("linea", "no header"), ("sin_volumen", "lacks Volumen")]
    read = read_csv_sources(spark, str(folder), encoding="iso-8859-1")
    assert ("latin", 3.0) in rows(read, "cliente_id", "Volumen")
    assert rejected_sources(spark, str(folder / "none")).isEmpty()


def test_quoted_header_keeps_columns_in_place(spark, tmp_path):
    (tmp_path / "A.csv").write_text('"nota, larga",Fecha,Presion,Temperatura,Volumen\n"x, y",2024-01-01 00:00:00,1,2,nan\n')
    got = read_csv_sources(spark, str(tmp_path))
    assert rows(got, RAW_DATE, "Presion", "Temperatura", "Volumen") == [("2024-01-01 00:00:00", 1.0, 2.0, None)]


def test_no_sources(spark, tmp_path):
    assert read_csv_sources(spark, str(tmp_path / "none")).isEmpty()
    assert read_parquet_sources(spark, str(tmp_path / "none")).isEmpty()


def test_load_order_keeps_the_first_line(spark, tmp_path):
    lines = "".join(f"2024-01-01 00:00:00,{i},1,1\n" for i in range(500))
    (tmp_path / "A.csv").write_text("Fecha,Presion,Temperatura,Volumen\n" + lines)
    got = keep_first(read_csv_sources(spark, str(tmp_path)).repartition(4), LOAD_ORDER, ("cliente_id", RAW_DATE))
    assert [r["Presion"] for r in got.collect()] == [0.0]


def test_parquet_sources(spark, tmp_path):
    import pandas as pd
    good = pd.DataFrame({"Fecha": [START], "Presion": [1.0], "Temperatura": [2.0], "Volumen": [3.0], "x": ["n"]})
    good.to_parquet(tmp_path / "A.parquet", coerce_timestamps="us")
    good.drop(columns="Volumen").to_parquet(tmp_path / "B.parquet", coerce_timestamps="us")
    got = read_parquet_sources(spark, str(tmp_path))
    assert rows(got, "cliente_id", RAW_DATE, "Volumen") == [("A", "2024-01-01 00:00:00", 3.0)]


def test_missing_table_is_empty(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert rows(read_table(spark, str(tmp_path / "no.csv"), schema)) == []
    assert read_labels(spark, str(tmp_path / "no.csv")).columns[-1] == "criticidad_real"
    (tmp_path / "l.csv").write_text("cliente_id,Fecha,anomalia_real,criticidad_real\nA,2024-01-01 00:00:00,True,Alta\n")
    assert rows(read_labels(spark, str(tmp_path / "l.csv"))) == [("A", START, True, "Alta")]


def test_report_is_written_even_without_anomalies(spark, tmp_path):
    empty = spark.createDataFrame([], "cliente_id string, Fecha timestamp, timestamp_deteccion timestamp, extra int")
    write_report(empty, str(tmp_path / "r"))
    texts = {p.read_text().strip() for p in Path(tmp_path / "r").glob("part-*")}
    assert texts == {"timestamp_deteccion,cliente_id,Fecha"}


def test_csv_and_partitioned_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", START, 1, 0.5)], "cliente_id string, Fecha timestamp, cluster_id int, x double")
    write_csv(df, str(tmp_path / "c"))
    assert "2024-01-01 00:00:00" in "".join(f.read_text() for f in Path(tmp_path / "c").glob("part-*"))
    write_by_cluster(df, str(tmp_path / "p"))
    plan = spark.read.parquet(str(tmp_path / "p")).where("cluster_id = 1")
    assert "PartitionFilters: [isnotnull(cluster_id" in plan._jdf.queryExecution().toString()


def test_settle_uses_the_named_folder_and_keeps_columns(spark):
    df = spark.range(3).selectExpr("id AS a", "id % 2 AS cluster_id", "id AS b")
    again = settle(df, ["cluster_id"])
    assert again.columns == df.columns and rows(again) == rows(df)
    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")


# --- exploration --------------------------------------------------------------------------

def test_last_fraction_of_a_second_is_outside(spark):
    times = [START, START + timedelta(hours=23, minutes=59, seconds=59),
             START + timedelta(hours=23, minutes=59, seconds=59, microseconds=1), START + timedelta(days=1)]
    df = spark.createDataFrame([(t,) for t in times], "datetime timestamp")
    assert x.by_dates(df, "2024-01-01 15:00:00", "2024-01-01 15:00:00").count() == 2


def test_frequent_severity_tie_takes_the_graver(spark):
    df = spark.createDataFrame([("a", "Baja"), ("a", "Alta"), ("b", "Baja"), ("b", "Baja"), ("b", "Alta")],
                               "cliente_id string, criticidad_predicha string")
    assert rows(x.frequent_severity(df)) == [("a", "Alta"), ("b", "Baja")]


def test_correlation_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, None), (4.0, 5.0, 2.0)],
                               "Presion double, Temperatura double, Volumen double")
    got = {(r[0], r[1]): r[2] for r in x.correlation(df).collect()}
    assert len(got) == 9 and got[("Presion", "Temperatura")] is None
    assert got[("Presion", "Volumen")] == pytest.approx(1.0)
    assert x.correlation(df.select("Presion")).isEmpty()


def test_pattern_with_one_value_and_band_without_spread(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 3.0), (2, None)], "mes int, Volumen double")
    assert [tuple(r)[:3] for r in x.temporal_pattern(df, "mes", "Volumen").orderBy("mes").collect()] == [
        (1, 5.0, 0.0), (2, 2.0, pytest.approx(2 ** 0.5))]
    assert x.normal_band(df.where("mes = 1"), "Volumen").isEmpty()
    assert not x.normal_band(df, "Volumen").isEmpty()


def test_statistics_of_nothing_are_null(spark):
    df = spark.createDataFrame([], "valor double")
    assert [v for v in x.named_statistics(df, "valor").first()] == [None] * 7


def test_row_ids_count_from_zero(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("o"))
    got = x.with_row_id(df, ["o"], "n")
    assert got.where("n <> o").isEmpty() and got.count() == 500


# --- compositions -------------------------------------------------------------------------

ETL = EtlParams(chunk="week")


@pytest.fixture(scope="module")
def result(spark, small):
    params = RunParams(etl=ETL, segment=SegmentParams(k_candidates=(2, 3)),
                       model=ModelParams(grid={"encoding_dim": (4, 16), "learning_rate": (0.001,),
                                               "epochs": (3,), "batch_size": (64,)}))
    return run(fx.readings_raw(spark, small), "seq", "fecha_txt", params, fx.ground_truth(spark, small),
               detected_at=datetime(2024, 2, 1))


def test_full_run(spark, result):
    assert result.readings.count() == result.scored.count() == 942
    assert len(result.readings.columns) == 21
    assert result.grid.where("elegido").count() == result.segments.k
    assert result.metrics.count() == 1 and result.compliance.count() == 5
    assert set(result.report.columns) <= set(REPORT_COLUMNS) and "timestamp_deteccion" in result.report.columns
    assert set(result.stage_seconds) >= {"etl_pipeline_seconds", "anomaly_detection_seconds"}
    assert result.times(spark).count() == 5
    assert result.segments.plane().count() == 15


def test_flags_follow_scores_and_low_grades_cannot_occur(result):
    flagged = result.scored.where("anomalia_predicha")
    assert flagged.where("score_anomalia_final IS NULL").isEmpty()
    # Threshold and grading share mean and std, so at two sigma nothing below 'Media' is left.
    assert {r[0] for r in flagged.select("criticidad_predicha").distinct().collect()} <= {"Media", "Alta"}
    assert result.scored.where("NOT anomalia_predicha AND criticidad_predicha <> 'Normal'").isEmpty()


def test_customers_without_cluster_are_not_scored(spark, small):
    readings = settle(clean_readings(q.fx.readings_raw(spark, small), ETL, "seq", "fecha_txt"))
    placed = settle(place(join_assignments(readings, fx.assignments(spark, small)), ModelParams(), "week"))
    assert placed.where("cluster_id = -1").isEmpty()
    for boundary in ("entity", "cluster"):
        for fit_on in ("all", "train"):
            params = ModelParams(boundary=boundary, fit_on=fit_on, grid={
                "encoding_dim": (8,), "learning_rate": (0.1,), "epochs": (1,), "batch_size": (1,)})
            fitted, _ = train(placed, ETL, params)
            assert detect(placed, fitted, ETL, params, RunParams().bands).count() == placed.count()


def test_quality_reports_see_every_stage(spark, small):
    reports = QualityReports()
    clean_readings(q.fx.readings_raw(spark, small), ETL, "seq", "fecha_txt", reports)
    assert list(reports.stages) == ["carga", "fechas", "cantidad_gas", "faltantes", "atipicos", "calendario"]
    assert reports.stages["fechas"]["completitud"].first()["filas"] == 942
    assert reports.stages["atipicos"]["faltantes"].isEmpty()


def test_inactive_segmentation(spark, small):
    found = segment_customers(q.keyed(spark, small), SegmentParams(active=False))
    assert rows(found.assignments.select("cluster_id").distinct()) == [(0,)] and found.plane() is None


def test_dashboard_without_selection(spark, small):
    panels = explore(q.readings_view(spark, small), q.anomalies_view(spark, small), Filters(variable="Presion"))
    assert panels["serie"].count() == 942 and panels["encabezado"].first()["titulo"] == "Presion"
    assert panels["kpis"].first()["total_clientes"] == 15


# --- plans --------------------------------------------------------------------------------

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def static(spark, build):
    """Plan without adaptive execution, so that shuffles and reuse are in the text."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return plan(build())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def shuffles(text, keys):
    """Shuffles by the keys that are run, not counting reuse of one."""
    return [line for line in text.splitlines()
            if re.search(rf"Exchange hashpartitioning\({keys}", line) and "ReusedExchange" not in line]


def test_filling_shuffles_rows_once_and_shares_them_with_the_index(spark, small):
    readings = settle(q.with_gas(spark, small))
    text = static(spark, lambda: fill_gaps(readings, q.ALL, unit="week"))
    assert len(shuffles(text, r"cliente_id#\d+, _chunk")) == 1
    # The other scan looks for undated rows only, which pass unfilled.
    assert text.count("ReusedExchange") == 1 and text.count("FileScan") == 2
    assert re.search(r"PushedFilters: \[Or\(IsNull\(cliente_id\),IsNull\(Fecha\)\)\]", text)


def test_no_window_spans_a_whole_customer_of_readings(spark, small):
    """Only the chunk index is windowed per customer; rows are windowed per chunk."""
    readings = settle(q.with_gas(spark, small))
    text = static(spark, lambda: fill_gaps(readings, q.ALL, unit="week"))
    for window in re.findall(r"Window \[([^\]]*)\], \[(cliente_id#\d+)\],", text):
        assert "row_number" not in window[0]
        assert "_rows" in window[0] or "_prev" in window[0] or "_next" in window[0]


def test_cleaning_caps_what_was_filled_once(spark, small):
    raw = fx.readings_raw(spark, small)
    text = static(spark, lambda: clean_readings(raw, ETL, "seq", "fecha_txt"))
    # What is left after filling: limits and result read the written rows, without a window.
    assert "Window" not in text and "FileScan parquet [event_id" not in text
    assert text.count("FileScan parquet") - text.count("_rows") <= 3
    # Values by customer for the limits, the limits spread over chunks, and the rows that meet them.
    assert len(re.findall(r"(?<!Reused)Exchange hashpartitioning", text)) <= 4
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_duplicates_are_reduced_before_the_shuffle_by_a_hash_aggregate(spark, small):
    text = static(spark, lambda: fx.readings_keyed(spark, small))
    assert "partial_min_by" in text and "SortAggregate" not in text


def test_dashboard_filters_reach_the_scan(spark, small):
    view = settle(q.readings_view(spark, small))
    alerts = settle(q.anomalies_view(spark, small))
    panels = explore(view, alerts, Filters("2024-01-03", "2024-01-25", 1, "CLIENTE0", "Volumen"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    text = plan(panels["serie"])
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(datetime", text)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(cliente_id", text)
    assert "Temperatura" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def test_chunks_of_a_given_unit_are_not_counted_in_the_raw_rows(spark, small, monkeypatch):
    """They are counted in the written rows, so dates are parsed once."""
    def refuse(*_, **__):
        raise AssertionError("raw rows counted")

    monkeypatch.setattr("meterlens.plans.etl.measured_spans", refuse)
    assert clean_readings(q.fx.readings_raw(spark, small), EtlParams(chunk="week"), "seq", "fecha_txt").count() > 0
