"""Meter readings, assignments and labels derived from the ``events`` table.

The test tables hold no meter data, so readings are derived row by row from events, with
missing values, unparseable dates, repeated hours and outliers worked in. Every view reads
the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlens.operators.clean import keep_first, parse_dates, with_gas_quantity
from meterlens.operators.severity import severity
from meterlens.params import CLUSTER, KEY, MODEL_LABEL, TIME, Bands, GasLaw


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def readings_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Readings as they arrive: text dates, a load sequence and gaps."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "value")
    event, user = F.col("event_id"), F.col("user_id")
    return events.select(
        F.concat(F.lit("CLIENTE"), user.cast("string")).alias(KEY),
        event.alias("seq"),
        F.when(event % 101 == 0, "bad-date")
        .otherwise(F.date_trunc("hour", F.col("ts")).cast("string")).alias("fecha_txt"),
        F.when(event % 13 != 0, F.lit(15) + (event % 50).cast("double") / F.lit(10.0)).alias("Presion"),
        F.when(user % 50 == 7, None).when(event % 997 == 0, F.lit(-273.15))
        .otherwise(F.lit(10) + ((event * 7) % 250).cast("double") / F.lit(10.0)).alias("Temperatura"),
        F.when(event % 17 == 0, None).when(event % 211 == 0, F.col("value") * 20)
        .otherwise(F.col("value")).alias("Volumen"),
    )


def readings_keyed(spark: SparkSession, folder: str) -> DataFrame:
    """One reading per customer and hour, ``seq`` kept."""
    parsed = parse_dates(readings_raw(spark, folder), "fecha_txt", TIME)
    return keep_first(parsed.withColumn("_order", F.col("seq")), "_order").drop("_order")


def assignments(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed cluster ids; the customers with an id that ends in 9 have none."""
    users = table(spark, folder, "events").select("user_id").distinct()
    return users.where("user_id % 10 != 9").select(
        F.concat(F.lit("CLIENTE"), F.col("user_id").cast("string")).alias(KEY),
        (F.col("user_id") % 3).cast("int").alias(CLUSTER))


def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the readings with a temperature.

    Readings without pressure are labelled twice, and the anomalous ones once more a year
    later, where no reading is.
    """
    keyed = readings_keyed(spark, folder).select(KEY, TIME, "seq", "Presion", "Temperatura", "Volumen")
    labelled = keyed.where("Temperatura IS NOT NULL").withColumns({
        "anomalia_real": F.coalesce(F.col("Volumen") >= 80, F.lit(False)),
        "criticidad_real": F.when(F.col("Volumen") >= 120, "Alta").otherwise("Media")})
    columns = [KEY, TIME, "anomalia_real", "criticidad_real"]
    later = (F.col(TIME) + F.expr("INTERVAL '1' YEAR")).alias(TIME)
    return (
        labelled.select(*columns)
        .unionByName(labelled.where("Presion IS NULL").select(*columns))
        .unionByName(labelled.where("anomalia_real").select(KEY, later, "anomalia_real", "criticidad_real")))


def anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of 60 and more as anomalies, graded by volume, in the layout of the report."""
    keyed = with_gas_quantity(readings_keyed(spark, folder).drop("seq"), GasLaw())
    score = F.col("Volumen") / F.lit(10.0)
    rows = keyed.where("Volumen >= 60").select(
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("timestamp_deteccion"),
        *keyed.columns, F.lit(MODEL_LABEL).alias("modelo_deteccion"), score.alias("score_anomalia_final"),
        severity(score, F.lit(5.0), F.lit(1.5), Bands()).alias("criticidad_predicha"))
    return rows
