"""The moment cube, observed reports, rejected lines, staged overwrites and folded deviations."""

import threading
import uuid
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from checks.queries import ALL, ETL, anomalies_view, readings_view
from meterlens.operators import cube as cubes
from meterlens.operators.quality import completeness, missing_by_column
from meterlens.operators.quantiles import buffered_rows, median_deviations
from meterlens.operators.reports import ObservedReports
from meterlens.params import Filters
from meterlens.plans.dashboard import explore
from meterlens.plans.etl import QualityReports, clean_readings
from meterlens.plans.full_run import RunParams, run
from meterlens.session import scratch, settle
from meterlens.sources import fixtures as fx
from meterlens.sources.readings import BASE_COLUMNS, read_csv_sources, rejected_rows, rejected_sources
from meterlens.sources.sinks import overwrite, restored, write_by_cluster, write_csv
from tests.conftest import rows


# --- cube

@pytest.fixture(scope="module")
def dashboard_rows(spark, small):
    readings, found = settle(readings_view(spark, small)), settle(anomalies_view(spark, small))
    # Some readings in the last fraction of a second of a month, and a constant column.
    late = readings.limit(40).withColumn("datetime", F.date_trunc("month", "datetime") + F.expr("INTERVAL 1 MONTH") - F.expr("INTERVAL 0.5 SECOND"))
    readings = settle(readings.unionByName(late).withColumn("Presion", F.when(F.col("cluster_id") == 2, F.lit(0.1)).otherwise(F.col("Presion"))))
    made = cubes.moment_cube(readings)
    return readings, found, cubes.Cube(settle(made.rows), made.centres)


FILTERS = [
    Filters(variable="Volumen"), Filters(variable="Presion", pattern_by="mes"), Filters(cluster_id=1, variable="Temperatura"),
    Filters(start="2024-01-10", end="2024-01-12", variable="Volumen"), Filters(start="2023-12-01", end="2024-01-31", variable="Volumen", pattern_by="dia_semana"),
    Filters(start="2024-01-01", end="2024-02-01", cluster_id=2, variable="Presion", pattern_by="hora_dia"),
    Filters(start="2024-01-31", end="2024-01-31", variable="Volumen"), Filters(start="2023-11-15", end="2024-03-15", cluster_id=0, variable="Volumen"),
    Filters(start="2030-01-01", end="2030-02-01", variable="Volumen"), Filters(start="2024-01-01", end="2024-01-31", client="CLIENTE3", variable="cantidad_gas_calculada"),
]


@pytest.mark.parametrize("number", range(len(FILTERS)))
def test_panels_from_the_cube_equal_those_from_readings(dashboard_rows, number):
    readings, found, cube = dashboard_rows
    raw, quick = explore(readings, found, FILTERS[number]), explore(readings, found, FILTERS[number], cube=cube)
    for name in ("correlacion", "clientes", "banda", "patron"):
        want, got = (sorted((tuple(r) for r in p[name].collect()), key=repr) for p in (raw, quick))
        assert len(got) == len(want), name
        for x, y in ((a, b) for one, two in zip(got, want) for a, b in zip(one, two)):
            assert x == (pytest.approx(y, rel=1e-7, abs=1e-9) if isinstance(y, float) else y), name


def test_cube_is_smaller_and_edges_only_are_read(spark, dashboard_rows):
    readings, _, cube = dashboard_rows
    assert cube.rows.where("_parte = 'todo'").agg(F.sum("n_Volumen")).first()[0] == readings.where("Volumen IS NOT NULL AND datetime IS NOT NULL").count()
    statistics = cubes.cube_statistics(cube, "Volumen").first()
    want = readings.agg(F.avg("Volumen"), F.stddev_samp("Volumen"), F.min("Volumen"), F.max("Volumen")).first()
    assert tuple(statistics) == pytest.approx(tuple(want))


def test_large_offsets_lose_no_digits(spark):
    rng = np.random.default_rng(1)
    x = 1e9 + rng.normal(size=200)
    data = [("a", 0, datetime(2024, 1, 1) + timedelta(days=i), float(v), float(2 * v + rng.normal())) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "cliente_id string, cluster_id int, datetime timestamp, Presion double, Volumen double")
    cube = cubes.moment_cube(df)
    assert cubes.cube_statistics(cube, "Presion").first()["std"] == pytest.approx(x.std(ddof=1), rel=1e-6)
    got = {(r[0], r[1]): r[2] for r in cubes.cube_correlation(cube).collect()}
    assert got["Presion", "Volumen"] == pytest.approx(np.corrcoef(x, [d[4] for d in data])[0, 1], abs=1e-6)


# --- reports

def test_observed_reports_equal_reports_of_their_own(spark, small):
    raw = fx.readings_raw(spark, small)
    seen, own = ObservedReports(), QualityReports()
    settle(clean_readings(raw, ETL, "seq", "fecha_txt", seen))
    clean_readings(raw, ETL, "seq", "fecha_txt", own)
    table = {(r["etapa"], r["columna"]): r for r in seen.table(spark).collect()}
    assert list(dict.fromkeys(e for e, _ in table)) == ["carga", "fechas", "cantidad_gas", "faltantes", "atipicos", "calendario"]
    for stage in ("fechas", "cantidad_gas", "atipicos"):
        whole = own.stages[stage]["completitud"].first()
        missing = {r["columna"]: r["nulos"] for r in own.stages[stage]["faltantes"].collect()}
        described = {r["variable"]: r for r in own.stages[stage]["resumen"].collect()}
        for (e, c), r in table.items():
            if e == stage:
                assert r["filas"] == whole["filas"] and r["completitud"] == pytest.approx(whole["completitud"])
                assert r["nulos"] == missing.get(c, 0)
                if c in ALL:
                    assert (r["media"], r["minimo"], r["maximo"]) == pytest.approx(tuple(described[c][k] for k in ("mean", "min", "max")))


def count_jobs(spark, work):
    tracker, group = spark.sparkContext.statusTracker(), f"count-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, "count")
    work()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(tracker.getJobIdsForGroup(group))


def test_reports_cost_no_job(spark, small):
    raw = fx.readings_raw(spark, small)
    plain = count_jobs(spark, lambda: settle(clean_readings(raw, ETL, "seq", "fecha_txt")))
    watched = count_jobs(spark, lambda: settle(clean_readings(raw, ETL, "seq", "fecha_txt", ObservedReports())))
    assert 0 < watched <= plain


def test_full_run_returns_reports_of_every_stage(spark, small):
    out = run(fx.readings_raw(spark, small), "seq", "fecha_txt", RunParams(etl=ETL, rank_zero=True))
    stages = {r["etapa"]: r["filas"] for r in out.reports.select("etapa", "filas").distinct().collect()}
    assert set(stages) == {"carga", "fechas", "cantidad_gas", "faltantes", "atipicos", "calendario"}
    assert stages["calendario"] == out.readings.count()
    known = {r["id"]: r["cumple"] for r in out.compliance.collect()}
    assert known.pop("D3") == "Sí" and set(known.values()) == {"N/A"}
    folder = Path(out.folder.removeprefix("file:"))
    assert folder.exists()
    out.release()
    assert not folder.exists()


def test_runs_of_two_threads_keep_apart(spark):
    found = {}

    def work(name):
        with scratch(spark) as folder:
            found[name] = folder, settle(spark.range(5).withColumnRenamed("id", name)).inputFiles()[0]
            barrier.wait(60)
            found[name] += (settle(spark.range(3)).count(),)

    barrier = threading.Barrier(2)
    threads = [threading.Thread(target=work, args=(n,)) for n in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert all(folder in file and n == 3 for folder, file, n in found.values()) and found["a"][0] != found["b"][0]


# --- sources

def test_rejected_lines_and_headers(spark, tmp_path):
    (tmp_path / "A.csv").write_text('Fecha,Presion,Temperatura,Volumen\n2024-01-01,1,2,3\n2024-01-02,1,2\n2024-01-03,1,2,3,4\n\n"2024-01-04",1,"2",3\n')
    (tmp_path / "B.csv").write_text('Volumen,"a, b",Fecha,Presion,Temperatura\n1,x,2024-01-01,1,1\n1,2024-01-02,1,1\n')
    (tmp_path / "C.csv").write_text('"Fe\ncha",Presion,Temperatura,Volumen\n2024-01-01,1,2,3\n')
    kept = read_csv_sources(spark, str(tmp_path))
    assert rows(kept.select("cliente_id", "Fecha_original_etl")) == [("A", "2024-01-01"), ("A", "2024-01-04"), ("B", "2024-01-01")]
    assert rows(rejected_rows(spark, str(tmp_path)).select("cliente_id", "line", "reason")) == [
        ("A", "2024-01-02,1,2", "not 4 cells"), ("A", "2024-01-03,1,2,3,4", "not 4 cells"), ("B", "1,2024-01-02,1,1", "not 5 cells")]
    assert rows(kept.groupBy("cliente_id").count()) == [("A", 2), ("B", 1)]
    assert rows(rejected_rows(spark, str(tmp_path)).groupBy("cliente_id").count()) == [("A", 2), ("B", 1)]
    assert rows(rejected_sources(spark, str(tmp_path)), "cliente_id", "reason") == [("C", "the header has a line break within quotes")]
    assert rejected_rows(spark, str(tmp_path / "none")).isEmpty()


def test_customers_from_folders(spark, tmp_path):
    for name in ("cliente=C%201", "D2"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part-0.csv").write_text("Fecha,Presion,Temperatura,Volumen\n2024-01-01,1,2,3\n")
    got = read_csv_sources(spark, str(tmp_path), named_by="folder")
    assert len(BASE_COLUMNS) == 3 and len({r["cliente_id"] for r in got.collect()}) == 2 and "D2" in {r["cliente_id"] for r in got.collect()}


# --- staged overwrites

def test_a_write_that_dies_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([("a", 1)], "cliente_id string, cluster_id int")
    write_by_cluster(old, path)
    dies = spark.range(100).select(F.lit("b").alias("cliente_id"), F.when(
        F.col("id") == 77, F.raise_error(F.lit("killed"))).otherwise(F.lit(1)).cast("int").alias("cluster_id"))
    with pytest.raises(PySparkException):
        write_by_cluster(dies, path)
    assert rows(spark.read.parquet(path), "cliente_id") == [("a",)]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_table_can_be_overwritten_by_a_plan_that_reads_it(spark, tmp_path):
    path = str(tmp_path / "t")
    write_csv(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path)
    write_csv(spark.read.option("header", True).csv(path).where("v > 1"), path)
    assert rows(spark.read.option("header", True).csv(path)) == [("b", "2")]


def test_an_interrupted_switch_is_put_right(spark, tmp_path):
    path = tmp_path / "t"
    write_csv(spark.createDataFrame([("a",)], "k string"), str(path))
    path.rename(tmp_path / "t.before")
    assert restored(spark, str(path)) == str(path) and path.exists() and not (tmp_path / "t.before").exists()

    def dies(to):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        overwrite(spark, str(path), dies)
    assert rows(spark.read.option("header", True).csv(str(path))) == [("a",)]


# --- folded deviations

@pytest.mark.parametrize("limit", [200_000, 25])
def test_median_deviations_of_small_and_large_groups(spark, limit):
    rng = np.random.default_rng(2)
    data = []
    for g, n in enumerate((1, 2, 7, 40, 101)):
        data += [(g, float(round(v, 1)), None if i % 5 == 0 else float(v * 100)) for i, v in enumerate(rng.normal(size=n))]
    data += [(9, None, float("nan")), (9, 1.0, float("inf"))]
    df = spark.createDataFrame(data, "g int, x double, y double")
    got = {r["g"]: r for r in median_deviations(df, ["g"], ["x", "y"], limit, bins=8).collect()}
    for g in {d[0] for d in data}:
        for i, c in ((1, "x"), (2, "y")):
            values = np.array([d[i] for d in data if d[0] == g and d[i] is not None and np.isfinite(d[i])])
            med, mad = got[g][f"_med_{c}"], got[g][f"_mad_{c}"]
            if not len(values):
                assert med is None and mad is None
            else:
                assert med == pytest.approx(np.median(values)) and mad == pytest.approx(np.median(np.abs(values - np.median(values))))


def test_buffers_follow_the_sessions_groups(spark):
    assert buffered_rows(spark, 4) == 200_000
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "128")
    try:
        assert buffered_rows(spark, 4) == 25_000
    finally:
        spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "16")


def test_completeness_counts_cells(spark):
    df = spark.createDataFrame([(1, None), (None, 2.0)], "a int, b double")
    assert completeness(df).first()["completitud"] == 50.0 and missing_by_column(df).count() == 2
