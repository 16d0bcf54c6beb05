"""All panels of the dashboard for one selection, as lazy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions.columns import title
from meterlens.operators import explore as x
from meterlens.operators.cube import PARTS, Cube, cube_band, cube_correlation, cube_customers, cube_pattern, picked_cube
from meterlens.params import CLUSTER, KEY, Filters


def explore(readings: DataFrame, anomalies: DataFrame, filters: Filters,
            band_factor: float = 1.5, cube: Cube | None = None) -> dict[str, DataFrame]:
    """Series, overlay, band, statistics, correlation, pattern, KPIs, detail, customers, heading.

    ``readings`` and ``anomalies`` have ``datetime`` and ``cluster_id``. Dates, cluster and
    client are resolved to literals first (one row each), so every panel filters at the scan. With a
    ``cube`` of the readings, band, correlation, pattern and customers come from its sums and the readings of
    the days at both ends.
    """
    # As text of the session's time zone, in which the filters read it again.
    bounds = x.time_bounds(readings).select(F.col("minimo").cast("string"), F.col("maximo").cast("string")).first()
    start, end = filters.start or bounds["minimo"], filters.end or bounds["maximo"]
    in_time = x.by_dates(readings, start, end)
    client = x.pick_client(in_time, filters.cluster_id, filters.client).first()[0]

    in_cluster = x.by_value(in_time, CLUSTER, filters.cluster_id)
    selected = x.by_value(in_cluster, KEY, client)
    found = x.by_dates(anomalies, start, end)
    found = x.by_value(x.by_value(found, CLUSTER, filters.cluster_id), KEY, client)
    found = x.by_value(found, "criticidad_predicha", filters.severity, "Todas")

    heading = readings.sparkSession.createDataFrame(
        [(filters.variable, client, filters.cluster_id, filters.severity)],
        f"variable string, {KEY} string, {CLUSTER} int, severidad string")
    panels = {
        "encabezado": heading.withColumn("titulo", title(F.col("variable"))),
        "clientes": x.distinct_sorted(in_cluster, KEY),
        "kpis": x.kpis(readings, found),
        "clientes_con_anomalias": x.frequent_severity(found),
        "detalle": x.detail_table(found),
        "correlacion": x.correlation(selected),
    }
    if filters.variable:
        # Only the chosen variable is unpivoted, so the scan reads no other one.
        series = x.to_long(selected, [filters.variable])
        panels["serie"] = series.orderBy(x.WHEN)
        panels["banda"] = x.normal_band(series, "valor", band_factor)
        panels["estadisticas"] = x.named_statistics(series, "valor")
        if filters.variable in found.columns:
            panels["sobrepuestas"] = x.overlay(found, filters.variable)
        if filters.pattern_by in selected.columns:
            panels["patron"] = x.temporal_pattern(selected, filters.pattern_by, filters.variable)
    if cube is not None:
        picked = picked_cube(cube, readings, start, end, filters.cluster_id, client)
        panels["correlacion"] = cube_correlation(picked)
        panels["clientes"] = cube_customers(picked_cube(cube, readings, start, end, filters.cluster_id))
        if filters.variable in cube.centres:
            panels["banda"] = cube_band(picked, filters.variable, band_factor)
            if filters.pattern_by in (*PARTS, "mes"):
                panels["patron"] = cube_pattern(picked, filters.pattern_by, filters.variable)
    return panels
