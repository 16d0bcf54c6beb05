"""One query per operator, each over whole tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.functions.columns import calendar_parts, cyclic_pairs, stamp, title
from meterlens.operators import clean, evaluate, explore, outliers, quality, scale, segment
from meterlens.operators.calendar import with_calendar
from meterlens.operators.cube import Cube, moment_cube
from meterlens.operators.impute import fill_gaps, fill_profile
from meterlens.operators.quantiles import exact_quantiles
from meterlens.operators.profile import build_profile, standardise_profile, weekend_share
from meterlens.operators.blocks import score_blocks, training_blocks, unpacked, unpacked_training
from meterlens.operators.grams import fit_components, gram_of_blocks
from meterlens.operators.reconstruct import (
    ERROR, block_errors, external_block_errors, fit_thresholds, grid_of_grams,
)
from meterlens.operators.reports import ObservedReports
from meterlens.operators.severity import row_label, score_statistics, severity
from meterlens.operators.split import split_chronologically
from meterlens.operators.windows import score_windows, training_windows
from meterlens.params import (
    BASE_COLUMNS, CLUSTER, GAS, KEY, TIME, WINDOW_FEATURES, Acceptance, Bands, EtlParams, Filters,
    GasLaw, ModelParams, SegmentParams,
)
from meterlens.plans.dashboard import explore as dashboard
from meterlens.plans.detection import detect, place, train
from meterlens.plans.etl import clean_readings
from meterlens.plans.full_run import RunParams, run
from meterlens.plans.segmentation import segment_customers
from meterlens.session import checkpoint_root, settle
from meterlens.sources import fixtures as fx
from meterlens.sources.readings import (
    RAW_DATE, read_csv_sources, read_labels, read_parquet_sources, read_table, rejected_sources,
)
from meterlens.sources.readings import rejected_rows as source_rows_left_out
from meterlens.sources.sinks import load_model, save_model, write_by_cluster, write_csv, write_report

ALL = (*BASE_COLUMNS, GAS)
ETL = EtlParams(chunk="week")
NUDGE = 3.3e-8
MOMENT = datetime(2024, 2, 1)
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def shown(df: DataFrame) -> DataFrame:
    """Numbers to 6 places and times as text, so that two engines can be compared.

    The nudge moves exact halves (a mean of 64 values has them) off the rounding edge, where
    the last bit would decide; adding 0.0 turns a rounded negative zero into zero.
    """
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            out[f.name] = F.round(F.col(f.name) + F.lit(NUDGE), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            out[f.name] = stamp(F.col(f.name))
    return df.withColumns(out) if out else df


# --- inputs -------------------------------------------------------------------------------

def keyed(spark, sf) -> DataFrame:
    return fx.readings_keyed(spark, sf).drop("seq")


def with_gas(spark, sf) -> DataFrame:
    return clean.with_gas_quantity(keyed(spark, sf), GasLaw())


def cleaned(spark, sf) -> DataFrame:
    return clean_readings(fx.readings_raw(spark, sf), ETL, "seq", "fecha_txt")


def placed(spark, sf) -> DataFrame:
    """Clean readings with cluster, position and split label, written like the full run does."""
    rows = evaluate.join_assignments(settle(cleaned(spark, sf)), fx.assignments(spark, sf))
    return settle(place(rows, ModelParams(), ETL.chunk))


def placed_raw(spark, sf) -> DataFrame:
    """The same without scaling in mind: customers that have a cluster, split by time."""
    rows = settle(cleaned(spark, sf)).join(fx.assignments(spark, sf), KEY)
    return split_chronologically(rows, unit=ETL.chunk)


def placed_all(spark, sf) -> DataFrame:
    """The same for all customers, with or without a cluster."""
    rows = evaluate.join_assignments(settle(cleaned(spark, sf)), fx.assignments(spark, sf))
    return split_chronologically(rows, unit=ETL.chunk)


def scored(spark, sf, boundary="entity", rank_zero=True) -> DataFrame:
    """Scored readings; without ``rank_zero`` by the components of the default grid, not by the mean window alone."""
    params = ModelParams(boundary=boundary)
    rows = placed(spark, sf)
    fitted, _ = train(rows, ETL, params, rank_zero)
    return detect(rows, fitted, ETL, params, Bands())


def readings_view(spark, sf) -> DataFrame:
    """Readings as the dashboard loads them, with calendar parts and cluster."""
    rows = with_calendar(with_gas(spark, sf), ETL)
    rows = evaluate.join_assignments(rows, fx.assignments(spark, sf))
    return clean.rename_aliases(rows, clean.READING_ALIASES)


def anomalies_view(spark, sf) -> DataFrame:
    """Anomalies as the dashboard loads them: renamed, numbered, with cluster."""
    rows = fx.anomalies(spark, sf)
    rows = explore.with_row_id(rows, [F.desc("timestamp_deteccion"), F.asc(KEY), F.asc(TIME)])
    rows = clean.rename_aliases(rows, clean.ANOMALY_ALIASES)
    return explore.with_cluster(rows, fx.assignments(spark, sf))


def lineitem(spark, sf) -> DataFrame:
    """Order lines in the role of readings: many rows per supplier."""
    return fx.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias(KEY), F.col("l_shipdate").cast("timestamp").alias(TIME),
        F.col("l_extendedprice").alias("Volumen"), F.col("l_quantity").alias("Presion"),
        F.col("l_discount").alias("Temperatura"))


# --- projections, filters, cleaning -------------------------------------------------------

@query
def rename_aliases(spark, sf):
    rows = keyed(spark, sf).withColumnRenamed(KEY, "ID_cliente")
    return shown(clean.rename_aliases(rows, clean.READING_ALIASES))


@query
def rename_anomaly_aliases(spark, sf):
    rows = fx.anomalies(spark, sf).withColumnsRenamed(
        {KEY: "cliente", "criticidad_predicha": "severidad"})
    out = clean.rename_aliases(rows, clean.ANOMALY_ALIASES)
    return shown(out.select(KEY, "datetime", "criticidad_predicha", "score_anomalia_final"))


@query
def keep_columns(spark, sf):
    return shown(clean.keep_columns(fx.readings_raw(spark, sf), [KEY, "fecha_txt", "ausente", *BASE_COLUMNS]))


@query
def parse_dates(spark, sf):
    return shown(clean.parse_dates(fx.readings_raw(spark, sf), "fecha_txt", TIME))


@query
def keep_first(spark, sf):
    return shown(fx.readings_keyed(spark, sf))


@query
def infinities_to_null(spark, sf):
    event = F.col("event_id")
    odd = fx.table(spark, sf, "events").select(
        "event_id", F.when(event % 5 == 0, F.lit(math.inf)).when(event % 5 == 1, F.lit(-math.inf))
        .when(event % 5 == 2, F.lit(math.nan)).otherwise(F.col("value")).alias("value"))
    return shown(clean.infinities_to_null(odd, ["value"]))


@query
def gas_quantity(spark, sf):
    return shown(with_gas(spark, sf))


@query
def gas_summary(spark, sf):
    return shown(clean.gas_summary(with_gas(spark, sf), GasLaw()))


@query
def filter_selection(spark, sf):
    rows = explore.by_dates(anomalies_view(spark, sf), "2024-01-05", "2024-01-20")
    rows = explore.by_value(rows, CLUSTER, 1)
    rows = explore.by_value(rows, "criticidad_predicha", "Alta", "Todas")
    return shown(rows.select("datetime", KEY, CLUSTER, "criticidad_predicha", "score_anomalia_final"))


@query
def filter_everything(spark, sf):
    rows = explore.by_value(anomalies_view(spark, sf), "criticidad_predicha", "Todas", "Todas")
    return shown(explore.by_value(rows, CLUSTER, None).select("datetime", KEY, "criticidad_predicha"))


@query
def default_dates(spark, sf):
    return shown(explore.default_dates(readings_view(spark, sf)))


@query
def pick_client(spark, sf):
    return explore.pick_client(readings_view(spark, sf), 2, "CLIENTE3")


@query
def fill_constants(spark, sf):
    joined = keyed(spark, sf).join(fx.ground_truth(spark, sf), [KEY, TIME], "left")
    return shown(clean.fill_constants(
        joined, {"anomalia_real": False, "criticidad_real": "Normal", "Volumen": 0.0, "Presion": -1.0}))


@query
def drop_missing(spark, sf):
    return shown(clean.drop_missing(keyed(spark, sf), ["Presion", "Volumen"]))


@query
def cast_columns(spark, sf):
    rows = fx.readings_raw(spark, sf).select(
        "seq", "fecha_txt", F.col("Volumen").cast("string").alias("Volumen"),
        (F.col("seq") % 2).alias("bandera"), F.col("seq").alias("entero"))
    typed = {"fecha_txt": "timestamp", "Volumen": "double", "bandera": "boolean", "entero": "string"}
    return shown(clean.cast_columns(rows, typed))


@query
def presentation(spark, sf):
    rows = explore.to_long(readings_view(spark, sf))
    return rows.select(stamp(F.col("datetime")).alias("datetime"), KEY, title(F.col("variable")).alias("titulo"),
                       F.bround("valor", 3).alias("valor"))


@query
def anomaly_row_ids(spark, sf):
    return shown(anomalies_view(spark, sf).select("anomalia_id", KEY, "datetime"))


@query
def detail_table(spark, sf):
    return explore.detail_table(anomalies_view(spark, sf))


@query
def anomaly_overlay(spark, sf):
    return shown(explore.overlay(anomalies_view(spark, sf), "Presion"))


@query
def anomaly_report(spark, sf):
    rows = evaluate.join_assignments(fx.anomalies(spark, sf), fx.assignments(spark, sf))
    return shown(explore.anomaly_report(rows))


# --- gaps, outliers, calendar, scaling, split ---------------------------------------------

def filled(spark, sf, method):
    return shown(fill_gaps(with_gas(spark, sf), ALL, method, ETL.chunk))


@query
def fill_linear(spark, sf):
    return filled(spark, sf, "interpolacion_temporal")


@query
def fill_forward(spark, sf):
    return filled(spark, sf, "ffill")


@query
def fill_backward(spark, sf):
    return filled(spark, sf, "bfill")


@query
def fill_customer_mean(spark, sf):
    return filled(spark, sf, "media_cliente")


@query
def fill_zero(spark, sf):
    return filled(spark, sf, "otro")


PROFILE = ("Volumen_mean", "Volumen_std", "Presion_median", "cantidad_gas_calculada_mean",
           "Temperatura_mean", "Temperatura_cv", "Presion_range", "Volumen_sum", "Volumen_min",
           "Volumen_max", "Temperatura_median", "consumo_finde_ratio", "Volumen_moda")


@query
def customer_profile(spark, sf):
    return shown(build_profile(with_gas(spark, sf), PROFILE))


@query
def supplier_profile(spark, sf):
    specs = ["Volumen_mean", "Volumen_std", "Volumen_median", "Presion_range", "Temperatura_cv", "Volumen_sum"]
    return shown(build_profile(lineitem(spark, sf), specs))


@query
def profile_filled(spark, sf):
    profile = settle(build_profile(with_gas(spark, sf), PROFILE))
    return shown(fill_profile(profile, PROFILE))


@query
def profile_standardised(spark, sf):
    specs = SegmentParams().specs
    profile = settle(fill_profile(settle(build_profile(with_gas(spark, sf), specs)), specs))
    return shown(standardise_profile(profile, specs))


@query
def weekend_volume_share(spark, sf):
    return shown(weekend_share(with_calendar(keyed(spark, sf), ETL)))


def capped(spark, sf, method):
    rows = fill_gaps(with_gas(spark, sf), ALL, "interpolacion_temporal", ETL.chunk)
    return shown(outliers.cap_outliers(rows, ALL, EtlParams(outlier_method=method, chunk=ETL.chunk)))


@query
def cap_iqr(spark, sf):
    return capped(spark, sf, "iqr")


@query
def cap_robust(spark, sf):
    return capped(spark, sf, "robust_zscore")


@query
def cap_unknown_method(spark, sf):
    return capped(spark, sf, "otro")


@query
def outlier_counts(spark, sf):
    return outliers.count_outliers(with_gas(spark, sf), ALL, ETL)


@query
def supplier_price_caps(spark, sf):
    rows = outliers.cap_outliers(lineitem(spark, sf), ["Volumen"], EtlParams(iqr_factor=0.5, chunk="year"))
    return shown(rows.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("filas"), F.min("Volumen").alias("minimo"), F.max("Volumen").alias("maximo"),
        F.avg("Volumen").alias("media")))


@query
def order_calendar(spark, sf):
    orders = fx.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias(TIME))
    return orders.select("o_orderkey", *[c.alias(n) for n, c in calendar_parts().items()])


@query
def cyclic_encoding(spark, sf):
    rows = keyed(spark, sf).select(KEY, TIME).withColumns(calendar_parts())
    return shown(rows.select(KEY, TIME, *[c.alias(n) for n, c in cyclic_pairs(ETL).items()]))


def scaled_columns(df, *ids):
    return shown(df.select(*ids, *[f"{c}_scaled" for c in BASE_COLUMNS]))


@query
def scale_standard_by_cluster(spark, sf):
    rows = evaluate.join_assignments(keyed(spark, sf), fx.assignments(spark, sf))
    return scaled_columns(scale.scale_by_group(rows, BASE_COLUMNS), KEY, TIME, CLUSTER)


@query
def scale_minmax_by_customer(spark, sf):
    return scaled_columns(scale.scale_by_group(keyed(spark, sf), BASE_COLUMNS, "min_max_scaler"), KEY, TIME)


@query
def scale_whole_table(spark, sf):
    rows = lineitem(spark, sf).drop(KEY)
    out = scale.scale_by_group(rows, BASE_COLUMNS)
    return shown(out.groupBy("Presion_scaled", "Temperatura_scaled").agg(
        F.count(F.lit(1)).alias("filas"), F.avg("Volumen_scaled").alias("media_volumen")))


@query
def scaler_parameters(spark, sf):
    rows = evaluate.join_assignments(keyed(spark, sf), fx.assignments(spark, sf))
    return shown(scale.fit_scaler(rows, BASE_COLUMNS))


@query
def apply_stored_scaler(spark, sf):
    rows = evaluate.join_assignments(keyed(spark, sf), fx.assignments(spark, sf))
    stored = settle(scale.fit_scaler(rows.where(F.col(CLUSTER) >= 0), BASE_COLUMNS))
    return scaled_columns(scale.apply_scaler(rows, BASE_COLUMNS, stored), KEY, TIME, CLUSTER)


@query
def chronological_split(spark, sf):
    out = split_chronologically(keyed(spark, sf), unit="week")
    return shown(out.select(KEY, TIME, F.col("_pos").alias("posicion"), F.col("_total").alias("filas"), "particion"))


# --- joins --------------------------------------------------------------------------------

@query
def join_assignments(spark, sf):
    rows = evaluate.join_assignments(keyed(spark, sf), fx.assignments(spark, sf))
    return shown(rows.select(KEY, TIME, CLUSTER, "Volumen"))


@query
def join_labels(spark, sf):
    rows = keyed(spark, sf).select(KEY, TIME, "Volumen").withColumn("origen", F.lit("p"))
    labels = fx.ground_truth(spark, sf).withColumn("origen", F.lit("r"))
    return shown(evaluate.join_labels(rows, labels))


@query
def join_labels_deduplicated(spark, sf):
    rows = keyed(spark, sf).select(KEY, TIME, "Volumen")
    return shown(evaluate.join_labels(rows, fx.ground_truth(spark, sf), dedupe=True))


@query
def unmatched_labels(spark, sf):
    return evaluate.unmatched_labels(keyed(spark, sf), fx.ground_truth(spark, sf))


@query
def anomaly_clusters(spark, sf):
    rows = explore.with_cluster(fx.anomalies(spark, sf), readings_view(spark, sf).where(F.col(CLUSTER) >= 0))
    return shown(rows.select(KEY, TIME, CLUSTER))


@query
def anomaly_clusters_without_map(spark, sf):
    return shown(explore.with_cluster(fx.anomalies(spark, sf), None).select(KEY, TIME, CLUSTER))


# --- aggregates ---------------------------------------------------------------------------

@query
def table_completeness(spark, sf):
    return shown(quality.completeness(with_gas(spark, sf)))


@query
def missing_by_column(spark, sf):
    return shown(quality.missing_by_column(with_gas(spark, sf), only_missing=False))


@query
def describe_order_lines(spark, sf):
    rows = fx.table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return shown(quality.describe(rows))


@query
def describe_readings(spark, sf):
    return shown(quality.describe(with_gas(spark, sf), ALL))


@query
def order_priority_counts(spark, sf):
    return explore.value_counts(fx.table(spark, sf, "orders"), "o_orderpriority")


@query
def cluster_sizes(spark, sf):
    return explore.value_counts(fx.assignments(spark, sf), CLUSTER)


@query
def distinct_counts(spark, sf):
    return explore.distinct_counts(readings_view(spark, sf), [KEY, CLUSTER])


@query
def named_statistics(spark, sf):
    names = ["mean", "std", "min", "max", "median", "quantile_25", "quantile_75", "desconocida",
             ("amplitud", lambda x: F.max(x) - F.min(x))]
    rows = explore.to_long(readings_view(spark, sf), ["Volumen"])
    return shown(explore.named_statistics(rows, "valor", names))


@query
def correlation_matrix(spark, sf):
    return shown(explore.correlation(with_gas(spark, sf)))


@query
def correlation_order_lines(spark, sf):
    return shown(explore.correlation(lineitem(spark, sf)))


@query
def hourly_pattern(spark, sf):
    return shown(explore.temporal_pattern(cleaned(spark, sf), "hora_dia", "Volumen"))


@query
def weekday_pattern(spark, sf):
    return shown(explore.temporal_pattern(readings_view(spark, sf), "dia_semana", "Presion"))


@query
def monthly_price_pattern(spark, sf):
    orders = fx.table(spark, sf, "orders").select(
        F.month("o_orderdate").alias("mes"), F.col("o_totalprice").alias("Volumen"))
    return shown(explore.temporal_pattern(orders, "mes", "Volumen"))


@query
def normal_band(spark, sf):
    return shown(explore.normal_band(explore.to_long(readings_view(spark, sf), ["Volumen"])))


@query
def frequent_severity(spark, sf):
    return explore.frequent_severity(fx.anomalies(spark, sf))


@query
def dashboard_totals(spark, sf):
    found = explore.by_value(anomalies_view(spark, sf), CLUSTER, 1)
    return explore.kpis(readings_view(spark, sf), found)


@query
def severity_options(spark, sf):
    return explore.distinct_sorted(fx.anomalies(spark, sf), "criticidad_predicha", "Todas")


@query
def client_options(spark, sf):
    return explore.distinct_sorted(readings_view(spark, sf), KEY)


@query
def time_bounds(spark, sf):
    return shown(explore.time_bounds(readings_view(spark, sf)))


# --- sorts, unions, shapes ----------------------------------------------------------------

@query
def sorted_readings(spark, sf):
    return shown(keyed(spark, sf).orderBy(KEY, TIME))


@query
def union_of_sources(spark, sf):
    rows = keyed(spark, sf)
    return shown(rows.where("Presion IS NULL").select(KEY, TIME, "Volumen")
                 .unionByName(rows.where("Presion IS NOT NULL").select("Volumen", TIME, KEY)))


@query
def readings_long(spark, sf):
    return shown(explore.to_long(readings_view(spark, sf)))


@query
def busiest_hour_per_customer(spark, sf):
    best = keyed(spark, sf).groupBy(KEY).agg(
        F.max_by(TIME, F.struct("Volumen", TIME)).alias(TIME), F.max("Volumen").alias("Volumen"))
    return shown(best.where("Volumen IS NOT NULL"))


# --- windows, reconstruction, severity ----------------------------------------------------

@query
def sliding_windows(spark, sf):
    rows = placed_all(spark, sf)
    made = score_windows(rows, ["Presion", "Volumen", "hora_sin"], 24)
    total = F.aggregate("ventana", F.lit(0.0), lambda t, v: t + v)
    return shown(made.select(
        KEY, TIME, "particion", "particion_ventana", F.coalesce(F.size("ventana"), F.lit(0)).alias("largo"), total.alias("suma"),
        F.get("ventana", F.lit(0)).alias("primero"), F.get("ventana", F.lit(70)).alias("ultimo_volumen")))


@query
def windows_across_customers(spark, sf):
    rows = placed_raw(spark, sf)
    made = score_windows(rows, ["Presion", "Volumen"], 24, "cluster")
    total = F.aggregate("ventana", F.lit(0.0), lambda t, v: t + v)
    return shown(made.select(KEY, TIME, CLUSTER, total.alias("suma"), F.get("ventana", F.lit(0)).alias("primero")))


@query
def training_windows_across_customers(spark, sf):
    rows = placed_raw(spark, sf)
    made = training_windows(rows, ["Presion", "Volumen"], 24, "cluster")
    total = F.aggregate("ventana", F.lit(0.0), lambda t, v: t + v)
    return shown(made.groupBy(CLUSTER, "particion_ventana").agg(
        F.count(F.lit(1)).alias("ventanas"), F.avg(total).alias("suma_media"), F.max(total).alias("suma_maxima")))


def scaled_blocks(spark, sf):
    """Scaled rows, their training blocks and the Gram table of those."""
    scaled = scale.scale_by_group(placed(spark, sf), ALL)
    blocks = training_blocks(scaled, WINDOW_FEATURES, 24)
    return scaled, blocks, settle(gram_of_blocks(blocks, 24, len(WINDOW_FEATURES)))


def errors_at_rank(spark, sf, rank) -> DataFrame:
    scaled, _, grams = scaled_blocks(spark, sf)
    model = settle(fit_components(grams, rank))
    blocks = score_blocks(scaled, WINDOW_FEATURES, 24)
    return unpacked(block_errors(blocks, model, 24, len(WINDOW_FEATURES)), ERROR, ERROR)


@query
def reconstruction_errors(spark, sf):
    return shown(errors_at_rank(spark, sf, 0).select(KEY, TIME, CLUSTER, "error"))


@query
def cluster_thresholds(spark, sf):
    _, blocks, grams = scaled_blocks(spark, sf)
    errors = block_errors(blocks, settle(fit_components(grams, 0)), 24, len(WINDOW_FEATURES))
    return shown(fit_thresholds(unpacked_training(errors, ERROR, ERROR), 2.0))


@query
def scored_readings(spark, sf):
    return shown(scored(spark, sf).select(
        KEY, TIME, CLUSTER, "anomalia_predicha", "score_anomalia_final", "modelo_deteccion",
        "criticidad_predicha"))


@query
def scored_readings_across_customers(spark, sf):
    return shown(scored(spark, sf, "cluster", rank_zero=False).select(
        KEY, TIME, CLUSTER, "anomalia_predicha", "score_anomalia_final", "criticidad_predicha"))


@query
def external_reconstructor(spark, sf):
    """A caller's model that rebuilds every window as its own mean per feature."""
    rows = placed_all(spark, sf)
    blocks = score_blocks(rows, ["hora_sin", "hora_cos"], 24)

    def make_predict_fn():
        def predict(batch):
            return batch.mean(axis=1, keepdims=True).repeat(24, axis=1).reshape(len(batch), -1)
        return predict

    out = unpacked(external_block_errors(blocks, make_predict_fn, 24, 2), ERROR, ERROR)
    return out.select(KEY, stamp(F.col(TIME)).alias(TIME), F.round("error", 4).alias("error"))


@query
def score_statistics_by_severity(spark, sf):
    return shown(score_statistics(fx.anomalies(spark, sf), "score_anomalia_final", ["criticidad_predicha"]))


@query
def score_statistics_overall(spark, sf):
    return shown(score_statistics(fx.table(spark, sf, "events"), "value"))


@query
def severity_levels(spark, sf):
    value = F.when(F.col("event_id") % 97 != 0, F.col("value"))
    return fx.table(spark, sf, "events").select(
        "event_id", severity(value, F.lit(20.0), F.lit(10.0), Bands()).alias("nivel"),
        severity(value, F.lit(20.0), F.lit(0.0), Bands()).alias("nivel_sin_desviacion"),
        severity(value, F.lit(20.0), F.lit(10.0), Bands(alta_min=2.75, media_min=1.75, media_max=None,
                                                        baja_min=1.0, baja_max=None)).alias("nivel_otras_bandas"))


@query
def row_labels(spark, sf):
    flagged = F.col("value") > 40
    mean = F.when(F.col("event_type") != "error", F.lit(20.0))
    return fx.table(spark, sf, "events").select(
        "event_id", flagged.alias("marcado"),
        row_label(flagged, F.col("value"), mean, F.lit(10.0), Bands()).alias("criticidad"))


# --- sources and sinks ------------------------------------------------------------------

def own_folder(spark) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/meterlens-sources-{uuid.uuid4().hex}"


def raw_by_source(spark, sf) -> DataFrame:
    """Raw readings of six sources, each of which becomes a folder of files."""
    return fx.readings_raw(spark, sf).withColumn("fuente", F.concat(F.lit("F"), (F.col("seq") % 6).cast("string")))


def loaded(rows: DataFrame) -> DataFrame:
    return shown(rows.select(KEY, RAW_DATE, *BASE_COLUMNS))


@query
def csv_sources(spark, sf):
    """Sources whose columns come in two orders, written as CSV and read again."""
    rows, folder = raw_by_source(spark, sf).withColumnRenamed("fecha_txt", TIME), own_folder(spark)
    layouts = {"a": [TIME, *BASE_COLUMNS], "b": ["Volumen", "seq", TIME, "Temperatura", "Presion"]}
    for name, columns in layouts.items():
        part = rows.where((F.col("seq") % 2 == 0) == (name == "a"))
        part.select("fuente", *columns).write.option("header", True).partitionBy("fuente").csv(f"{folder}/{name}")
    return loaded(read_csv_sources(spark, folder, named_by="folder"))


@query
def parquet_sources(spark, sf):
    rows, folder = raw_by_source(spark, sf).withColumnRenamed("fecha_txt", TIME), own_folder(spark)
    rows.select("fuente", "seq", TIME, *BASE_COLUMNS).write.partitionBy("fuente").parquet(folder)
    return loaded(read_parquet_sources(spark, folder, named_by="folder"))


@query
def rejected_rows(spark, sf):
    """Lines of six sources: how many are read, and how many are left out and why. Two sources have a header that is none."""
    folder = own_folder(spark)
    rows = raw_by_source(spark, sf)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("fecha_txt", *BASE_COLUMNS)]
    more = F.when(F.col("seq") % 10 == 3, F.lit(",0,0")).when(F.col("seq") % 10 == 4, F.lit("")).otherwise(F.lit(",x"))
    lines = rows.select("fuente", F.lit(1).alias("o"), F.concat(F.concat_ws(",", *cells), more).alias("value"))
    head = F.when(F.col("fuente") == "F4", '"Fecha\nde",Presion,Temperatura,Volumen,nota').when(
        F.col("fuente") == "F5", "Fecha,Presion,Temperatura,nota").otherwise("Fecha,Presion,Temperatura,Volumen,nota")
    heads = rows.select("fuente").distinct().select("fuente", F.lit(0).alias("o"), head.alias("value"))
    lines.unionByName(heads).repartition("fuente").sortWithinPartitions("fuente", "o").select("fuente", "value").write.partitionBy(
        "fuente").text(folder)
    for name in sorted(p.getPath().getName() for p in files_below(spark, folder)):
        rename_parts(spark, f"{folder}/{name}", ".txt", ".csv")
    kept = read_csv_sources(spark, folder, named_by="folder").groupBy(KEY).agg(F.count(F.lit(1)).alias("lineas"))
    out = source_rows_left_out(spark, folder, named_by="folder").groupBy(KEY, F.col("reason").alias("motivo")).agg(F.count(F.lit(1)).alias("lineas"))
    whole = rejected_sources(spark, folder, named_by="folder").select(KEY, F.col("reason").alias("motivo"), F.lit(0).cast("bigint").alias("lineas"))
    return kept.select(KEY, F.lit("leida").alias("motivo"), "lineas").unionByName(out).unionByName(whole)


def files_below(spark, folder: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return [f for f in found if f.isDirectory()]


def rename_parts(spark, folder: str, old: str, new: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in files.listStatus(path(folder)):
        name = f.getPath().getName()
        if name.endswith(old):
            files.rename(f.getPath(), path(f"{folder}/{name.removesuffix(old)}{new}"))


@query
def labels_round_trip(spark, sf):
    """Labels written as CSV, over an older table, and read with their schema."""
    truth, folder = fx.ground_truth(spark, sf), own_folder(spark)
    write_csv(truth.limit(0), folder)
    write_csv(truth, folder)
    return shown(read_labels(spark, folder))


@query
def cluster_round_trip(spark, sf):
    """Readings written by cluster; the second write reads the table that it replaces."""
    rows, folder = evaluate.join_assignments(keyed(spark, sf), fx.assignments(spark, sf)), own_folder(spark)
    write_by_cluster(rows, folder)
    write_by_cluster(spark.read.schema(rows.schema).parquet(folder).where(F.col("Volumen").isNotNull()), folder)
    return shown(spark.read.schema(rows.schema).parquet(folder).where(F.col(CLUSTER) >= 0).select(KEY, TIME, CLUSTER, "Volumen"))


@query
def report_round_trip(spark, sf):
    found = explore.with_cluster(fx.anomalies(spark, sf), fx.assignments(spark, sf))
    folder = own_folder(spark)
    write_report(found, folder)
    schema = explore.anomaly_report(found).schema
    return shown(read_table(spark, folder, schema))


@query
def model_round_trip(spark, sf):
    """Readings scored with a model that was saved, replaced by itself and loaded."""
    params, rows, folder = ModelParams(), placed(spark, sf), own_folder(spark)
    fitted, _ = train(rows, ETL, params, rank_zero=True)
    save_model(fitted, folder)
    save_model(load_model(spark, folder), folder)
    return shown(detect(rows, load_model(spark, folder), ETL, params, Bands()).select(
        KEY, TIME, CLUSTER, "anomalia_predicha", "score_anomalia_final", "modelo_deteccion", "criticidad_predicha"))


@query
def stage_reports(spark, sf):
    """Quality of the readings after every stage of the cleaning, counted in the jobs that write them."""
    reports = ObservedReports()
    settle(clean_readings(fx.readings_raw(spark, sf), ETL, "seq", "fecha_txt", reports))
    return shown(reports.table(spark).where(F.col("columna").isin(KEY, *ALL)))


# --- segmentation -------------------------------------------------------------------------

def embeddings(spark, sf):
    return fx.table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


@query
def label_silhouette(spark, sf):
    return shown(segment.silhouette(embeddings(spark, sf), "embedding", "label"))


@query
def label_davies_bouldin(spark, sf):
    return shown(segment.davies_bouldin(embeddings(spark, sf), "embedding", "label"))


@query
def label_within_squares(spark, sf):
    return shown(segment.within_squares(embeddings(spark, sf), "embedding", "label"))


@query
def elbow_of_curve(spark, sf):
    """Elbow of a decreasing curve: rows left out by the first x labels."""
    counts = embeddings(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    after = Window.partitionBy(F.lit(0)).orderBy("label")
    curve = counts.select((F.col("label") + 1).alias("k"),
                          F.sum("n").over(after.rowsBetween(1, Window.unboundedFollowing)).alias("rest"))
    return shown(segment.curve_drop(
        curve.select("k", F.coalesce("rest", F.lit(0)).cast("double").alias("rest")), "k", "rest"))


@query
def knees_of_curves(spark, sf):
    """Knees of many decreasing curves at once: per order priority, how much is left after each of 12 price steps."""
    orders = fx.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("curva"), F.floor(F.sqrt(F.col("o_totalprice") / 1000)).cast("int").alias("k"))
    steps = orders.groupBy("curva", "k").agg(F.count(F.lit(1)).alias("n"))
    after = Window.partitionBy("curva").orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    curves = steps.select("curva", "k", F.coalesce(F.sum("n").over(after), F.lit(0)).cast("double").alias("resto"))
    return segment.knees(curves, "k", "resto", keys=["curva"])


@query
def one_cluster_fallback(spark, sf):
    return segment.one_cluster(keyed(spark, sf))


@query
def customer_segments(spark, sf):
    return segment_customers(settle(cleaned(spark, sf)), SegmentParams()).assignments


@query
def segments_by_elbow(spark, sf):
    params = SegmentParams(method="elbow", k_candidates=(2, 3, 4, 6), knee="difference")
    return segment_customers(settle(cleaned(spark, sf)), params).assignments


@query
def candidate_scores(spark, sf):
    found = segment_customers(settle(cleaned(spark, sf)), SegmentParams(fixed_k=2))
    columns = list(SegmentParams().specs)
    scores = segment.score_candidates(found.scaled, columns, [2, 3, 4, 6], "elbow")
    return spark.createDataFrame([(k, float(s)) for k, s in scores], "k int, wcss double")


@query
def segment_quality(spark, sf):
    return segment_customers(settle(cleaned(spark, sf)), SegmentParams()).quality()


@query
def segment_plane(spark, sf):
    return segment_customers(settle(cleaned(spark, sf)), SegmentParams()).plane()


@query
def component_errors(spark, sf):
    return errors_at_rank(spark, sf, 16).select(KEY, TIME, CLUSTER, "error")


@query
def component_variance(spark, sf):
    """Variance of the windows about the training mean: in all, and as what 16 components explain and leave.

    The total and the explained part come from the Gram table, the rest from the windows' own errors.
    """
    _, blocks, grams = scaled_blocks(spark, sf)
    model = settle(fit_components(grams, 16, [0, 16]))
    part = {r: F.max(F.when(F.col("rango") == r, F.col("perdida"))) for r in (0, 16)}
    known = model.select(CLUSTER, F.inline("perdidas")).groupBy(CLUSTER, "particion_ventana").agg(
        part[0].alias("total"), (part[0] - part[16]).alias("explicada"))
    rest = unpacked_training(block_errors(blocks, model, 24, len(WINDOW_FEATURES), squared=True), ERROR, ERROR).groupBy(
        CLUSTER, "particion_ventana").agg(F.count(F.lit(1)).alias("ventanas"), F.avg(ERROR).alias("resto"))
    both = known.join(rest, [CLUSTER, "particion_ventana"])
    return shown(both.select(CLUSTER, "particion_ventana", "ventanas", "total", (F.col("explicada") + F.col("resto")).alias("suma")))


@query
def grid_of_ranks(spark, sf):
    _, _, grams = scaled_blocks(spark, sf)
    _, grid = grid_of_grams(grams, {"encoding_dim": [4, 16], "learning_rate": [0.001], "epochs": [3], "batch_size": [64]})
    return grid.select(CLUSTER, "orden", "rango", "perdida", "elegido")


@query
def grid_ends(spark, sf):
    """As many components as a window has values leave nothing; more change nothing; none are no model."""
    _, _, grams = scaled_blocks(spark, sf)
    whole = 24 * len(WINDOW_FEATURES)
    _, grid = grid_of_grams(grams, {"encoding_dim": [whole, whole + 5, 0]})
    return shown(grid.select(CLUSTER, "orden", "igual_a", "rango", "perdida", "elegido"))


# --- evaluation ---------------------------------------------------------------------------

def judged(spark, sf):
    flagged = F.coalesce(F.col("Volumen") >= 70, F.lit(False))
    return keyed(spark, sf).select(
        KEY, TIME, flagged.alias("anomalia_predicha"),
        F.when(~flagged, "Normal").when(F.col("Volumen") >= 110, "Alta").otherwise("Media")
        .alias("criticidad_predicha"))


@query
def confusion_counts(spark, sf):
    return shown(evaluate.confusion(evaluate.join_labels(judged(spark, sf), fx.ground_truth(spark, sf))))


@query
def system_metrics(spark, sf):
    return shown(evaluate.evaluate(judged(spark, sf), fx.ground_truth(spark, sf)))


@query
def system_metrics_without_matches(spark, sf):
    """Labels of other times: every reading and label is read, none matches."""
    later = fx.ground_truth(spark, sf).withColumn(TIME, F.col(TIME) + F.expr("INTERVAL '10' YEAR"))
    return shown(evaluate.evaluate(judged(spark, sf), later))


def partly_undated(spark, sf) -> DataFrame:
    """Readings as they arrive, with dates where the text is one; some rows have no customer."""
    rows = fx.readings_raw(spark, sf).withColumn(KEY, F.when(F.col("seq") % 23 != 0, F.col(KEY)))
    return rows.withColumn(TIME, F.col("fecha_txt").try_cast("timestamp"))


@query
def cap_keeps_undated_rows(spark, sf):
    made = outliers.cap_outliers(partly_undated(spark, sf), ["Presion", "Volumen"], EtlParams(chunk="auto"))
    return shown(made.select(F.coalesce(KEY, F.lit("nadie")).alias("cliente"), "fecha_txt", "Presion", "Volumen"))


@query
def mean_keeps_undated_rows(spark, sf):
    made = fill_gaps(partly_undated(spark, sf), ["Presion", "Volumen"], "media_cliente")
    return shown(made.select(F.coalesce(KEY, F.lit("nadie")).alias("cliente"), "fecha_txt", "Presion", "Volumen"))


def with_holes(spark, sf) -> DataFrame:
    """Events with NULL, NaN and infinite values worked in."""
    event = F.col("event_id")
    return fx.table(spark, sf, "events").select(
        event, F.when(event % 7 == 0, float("nan")).when(event % 11 == 0, float("-inf")).otherwise(F.col("value")).alias("value"),
        F.when(event % 13 != 0, F.col("user_id").cast("double")).alias("usuario"))


@query
def describe_with_nan(spark, sf):
    return shown(quality.describe(with_holes(spark, sf), ["value", "usuario"]))


@query
def missing_with_nan(spark, sf):
    return shown(quality.missing_by_column(with_holes(spark, sf), only_missing=False))


def narrowed_line_quantiles(spark, sf, keys: list[str]) -> DataFrame:
    """Quantiles of order lines by way of the histogram rounds, whatever the number of rows."""
    columns, points = ("l_discount", "l_quantity", "l_extendedprice"), {"p25": 0.25, "p50": 0.5, "p99": 0.99}
    wanted = {f"{n}_{c}": (c, p) for c in columns for n, p in points.items()}
    lines = fx.table(spark, sf, "lineitem").select(*keys, *columns)
    return shown(exact_quantiles(lines, keys, wanted, direct_rows=20 if keys else 2))


@query
def quantiles_narrowed_whole(spark, sf):
    return narrowed_line_quantiles(spark, sf, [])


@query
def quantiles_narrowed_by_supplier(spark, sf):
    return narrowed_line_quantiles(spark, sf, ["l_suppkey"])


@query
def acceptance_checks(spark, sf):
    metrics = evaluate.evaluate(judged(spark, sf), fx.ground_truth(spark, sf))
    return shown(evaluate.acceptance(metrics, Acceptance()))


@query
def compliance_report(spark, sf):
    metrics = evaluate.evaluate(judged(spark, sf), fx.ground_truth(spark, sf))
    return shown(evaluate.compliance(metrics, Acceptance(), 573.3))


# --- compositions -------------------------------------------------------------------------

@query
def clean_hourly_readings(spark, sf):
    return shown(cleaned(spark, sf))


@query
def scored_metrics(spark, sf):
    return shown(evaluate.evaluate(settle(scored(spark, sf)), fx.ground_truth(spark, sf)))


@query
def full_run_scored(spark, sf):
    out = run(fx.readings_raw(spark, sf), "seq", "fecha_txt", RunParams(etl=ETL),
              fx.ground_truth(spark, sf), detected_at=MOMENT)
    return out.scored.select(KEY, TIME, CLUSTER, "anomalia_predicha", "score_anomalia_final", "criticidad_predicha")


SELECTION = Filters(start="2024-01-03", end="2024-01-25", cluster_id=1, client="CLIENTE0", variable="Volumen")


def panel(spark, sf, name):
    return shown(dashboard(readings_view(spark, sf), anomalies_view(spark, sf), SELECTION)[name])


@query
def dashboard_series(spark, sf):
    return panel(spark, sf, "serie")


@query
def dashboard_band(spark, sf):
    return panel(spark, sf, "banda")


@query
def dashboard_statistics(spark, sf):
    return panel(spark, sf, "estadisticas")


@query
def dashboard_correlation(spark, sf):
    return panel(spark, sf, "correlacion")


@query
def dashboard_pattern(spark, sf):
    return panel(spark, sf, "patron")


def panel_from_cube(spark, sf, name):
    readings = readings_view(spark, sf)
    cube = moment_cube(readings)
    cube = Cube(settle(cube.rows), cube.centres)
    wide = Filters(start="2023-12-10", end="2024-02-20", cluster_id=1, variable="Volumen", pattern_by="dia_semana")
    return shown(dashboard(readings, anomalies_view(spark, sf), wide, cube=cube)[name])


@query
def cube_pattern(spark, sf):
    return panel_from_cube(spark, sf, "patron")


@query
def cube_correlation(spark, sf):
    return panel_from_cube(spark, sf, "correlacion")


@query
def dashboard_overlay(spark, sf):
    return panel(spark, sf, "sobrepuestas")


@query
def dashboard_kpis(spark, sf):
    return panel(spark, sf, "kpis")


@query
def dashboard_detail(spark, sf):
    return panel(spark, sf, "detalle")


@query
def dashboard_clients(spark, sf):
    return panel(spark, sf, "clientes")


@query
def dashboard_frequent_severity(spark, sf):
    return panel(spark, sf, "clientes_con_anomalias")
