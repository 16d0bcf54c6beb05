"""Exploration queries over readings and anomalies: filters, statistics, patterns, tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.functions.columns import stamp
from meterlens.functions.statistics import QUANTILES, SAMPLE_STATISTICS
from meterlens.operators.chunks import running_total
from meterlens.operators.clean import drop_missing, keep_columns
from meterlens.operators.quantiles import DIRECT_ROWS, exact_quantiles
from meterlens.operators.severity import severity_rank
from meterlens.params import (
    BASE_COLUMNS, CLUSTER, DETAIL_COLUMNS, GAS, KEY, KEY_STATISTICS, REPORT_COLUMNS,
)

WHEN = "datetime"
DISPLAY = (*BASE_COLUMNS, GAS)


# --- filters ------------------------------------------------------------------------------

def by_dates(df: DataFrame, start: str | None, end: str | None, time: str = WHEN) -> DataFrame:
    """Rows from the start of the first day to the last whole second of the last day."""
    if start is not None:
        df = df.where(F.col(time) >= F.date_trunc("day", F.lit(start).cast("timestamp")))
    if end is not None:
        day = F.date_trunc("day", F.lit(end).cast("timestamp"))
        df = df.where(F.col(time) <= day + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 SECOND"))
    return df


def by_value(df: DataFrame, column: str, value, everything=None) -> DataFrame:
    """Equality filter, skipped for None, for the value that means all, or without the column."""
    if value is None or value == everything or column not in df.columns:
        return df
    return df.where(F.col(column) == F.lit(value))


def time_bounds(df: DataFrame, time: str = WHEN) -> DataFrame:
    return df.agg(F.min(time).alias("minimo"), F.max(time).alias("maximo"))


def default_dates(df: DataFrame, months: int = 6, time: str = WHEN) -> DataFrame:
    """The default selection: ``months`` of 30 days up to the last day, and its closing second."""
    last = F.date_trunc("day", F.max(time))
    return df.agg(
        F.date_trunc("day", F.max(time) - F.make_dt_interval(F.lit(30 * months))).alias("inicio"),
        (last + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 SECOND")).alias("fin"))


def pick_client(df: DataFrame, cluster_id: int | None, client: str | None) -> DataFrame:
    """The client to show: the current one if it is in the cluster, else the cluster's first."""
    inside = by_value(df, CLUSTER, cluster_id)
    if cluster_id is None:
        return inside.agg(F.lit(client).cast("string").alias(KEY))
    current = F.max(F.when(F.col(KEY) == F.lit(client), F.col(KEY)))
    return inside.agg(F.coalesce(current, F.min(KEY)).alias(KEY))


def distinct_sorted(df: DataFrame, column: str, first: str | None = None) -> DataFrame:
    """Distinct values in order, an extra entry such as 'Todas' ahead of them."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("valor")).distinct()
    if first is None:
        return values.orderBy("valor")
    extra = df.sparkSession.createDataFrame([(first, 0)], "valor string, _rank int")
    listed = extra.unionByName(values.withColumn("_rank", F.lit(1)))
    return listed.orderBy("_rank", "valor").drop("_rank")


# --- shapes -------------------------------------------------------------------------------

def to_long(df: DataFrame, variables: Sequence[str] = DISPLAY, time: str = WHEN) -> DataFrame:
    """One row per reading and variable."""
    ids = [c for c in (time, KEY, CLUSTER) if c in df.columns]
    present = [v for v in variables if v in df.columns]
    typed = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in present])
    return typed.unpivot(ids, present, "variable", "valor")


def with_cluster(anomalies: DataFrame, readings: DataFrame | None) -> DataFrame:
    """Add the cluster of each customer: -1 if it has none, 0 without any map."""
    if CLUSTER in anomalies.columns:
        return anomalies
    usable = readings is not None and {KEY, CLUSTER} <= set(readings.columns)
    if not usable or KEY not in anomalies.columns:
        return anomalies.withColumn(CLUSTER, F.lit(0))
    known = readings.select(KEY, CLUSTER).distinct()
    joined = anomalies.join(known, KEY, "left")
    return joined.withColumn(CLUSTER, F.coalesce(F.col(CLUSTER).cast("int"), F.lit(-1)))


def with_row_id(df: DataFrame, order: Sequence[Column], name: str = "anomalia_id") -> DataFrame:
    """Number rows 0, 1, 2, … in a unique order, by range partitions and not in one task."""
    return running_total(df, [], order, F.lit(1).cast("bigint"), name)


def anomaly_report(flagged: DataFrame) -> DataFrame:
    """The report columns that are present, times as text, newest detection first."""
    out = keep_columns(flagged, REPORT_COLUMNS)
    times = [f.name for f in out.schema.fields
             if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    out = out.withColumns({c: stamp(F.col(c)) for c in times})
    order = [F.desc("timestamp_deteccion"), F.asc(KEY), F.asc("Fecha")]
    return out.orderBy(*[o for o, c in zip(order, ("timestamp_deteccion", KEY, "Fecha"))
                         if c in out.columns])


def detail_table(anomalies: DataFrame) -> DataFrame:
    """Display columns: times as text, numbers rounded half-even to 3 places."""
    out = keep_columns(anomalies, DETAIL_COLUMNS)
    rounded = {f.name: F.bround(F.col(f.name), 3) for f in out.schema.fields
               if isinstance(f.dataType, T.DoubleType)}
    shown = {WHEN: stamp(F.col(WHEN))} if WHEN in out.columns else {}
    return out.withColumns({**rounded, **shown})


def overlay(anomalies: DataFrame, variable: str) -> DataFrame:
    """Anomalies that can be drawn over the series of one variable."""
    usable = drop_missing(anomalies, [WHEN, variable, "criticidad_predicha"])
    return usable.select(WHEN, F.col(variable).cast("double").alias("valor"), "criticidad_predicha",
                         "score_anomalia_final", "modelo_deteccion")


# --- aggregates ---------------------------------------------------------------------------

def named_statistics(df: DataFrame, column: str,
                     names: Sequence[str | tuple[str, Callable[[Column], Column]]] = KEY_STATISTICS,
                     direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """One column per statistic, named or given as (name, function of a column); unknown is NULL."""
    x = F.col(column).cast("double")
    facts, quantiles, order = [], {}, []
    for entry in names:
        name, function = entry if isinstance(entry, tuple) else (entry, SAMPLE_STATISTICS.get(entry))
        order.append(name)
        if function is None and name in QUANTILES:
            quantiles[name] = (column, QUANTILES[name])
        else:
            facts.append((function(x) if function else F.max(F.lit(None).cast("double"))).alias(name))
    row = df.agg(F.lit(1).alias("_one"), *facts)
    if quantiles:
        # NULL for an empty series, so the join must not lose the row of plain statistics.
        exact = exact_quantiles(df, [], quantiles, direct_rows).withColumn("_one", F.lit(1))
        row = row.join(exact, "_one", "left")
    return row.select(*order)


def correlation(df: DataFrame, variables: Sequence[str] = DISPLAY) -> DataFrame:
    """Pearson correlation of every pair over the rows where both are present, in one aggregate.

    A constant column gives NULL; fewer than two variables give no rows.
    """
    present = [v for v in variables if v in df.columns]
    if len(present) < 2:
        return df.sparkSession.createDataFrame([], "variable_1 string, variable_2 string, correlacion double")
    pairs = [(a, b) for i, a in enumerate(present) for b in present[i:]]
    facts = {}
    for a, b in pairs:
        x = F.when(F.col(b).isNotNull(), F.col(a).cast("double"))
        y = F.when(F.col(a).isNotNull(), F.col(b).cast("double"))
        facts[(a, b)] = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    both = [(a, b, facts[(a, b)]) for a, b in pairs] + [(b, a, facts[(a, b)]) for a, b in pairs if a != b]
    cells = F.array(*[F.struct(F.lit(a).alias("variable_1"), F.lit(b).alias("variable_2"),
                               value.alias("correlacion")) for a, b, value in both])
    return df.agg(cells.alias("_all")).select(F.inline("_all"))


def temporal_pattern(df: DataFrame, part: str, variable: str) -> DataFrame:
    """Mean, sample std (0 for a single value) and mean +- std per hour, weekday or month."""
    used = drop_missing(df, [part, variable])
    x = F.col(variable).cast("double")
    out = used.groupBy(part).agg(
        F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"))
    return out.withColumns({"upper_bound": F.col("mean") + F.col("std"),
                            "lower_bound": F.col("mean") - F.col("std")})


def normal_band(df: DataFrame, value: str = "valor", factor: float = 1.5) -> DataFrame:
    """Mean +- factor standard deviations of a series; no row unless the std is positive."""
    x = F.col(value)
    facts = df.agg(F.avg(x).alias("media"), F.stddev_samp(x).alias("desviacion"))
    reach = F.lit(float(factor)) * F.col("desviacion")
    return facts.where(F.col("desviacion") > 0).select(
        "media", "desviacion", (F.col("media") - reach).alias("inferior"),
        (F.col("media") + reach).alias("superior"))


def frequent_severity(anomalies: DataFrame) -> DataFrame:
    """Most frequent severity per customer; the graver one wins a tie."""
    counts = anomalies.groupBy(KEY, "criticidad_predicha").agg(F.count(F.lit(1)).alias("_n"))
    order = F.struct(F.col("_n"), -severity_rank(F.col("criticidad_predicha")))
    return counts.groupBy(KEY).agg(F.max_by("criticidad_predicha", order).alias("criticidad_frecuente"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("cantidad")).orderBy(column)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_distinct(F.col(c)).alias(f"n_{c}") for c in columns])


def kpis(readings: DataFrame, filtered_anomalies: DataFrame) -> DataFrame:
    """Customers in all readings; customers, 'Alta' rows and rows among the filtered anomalies."""
    total = readings.agg(F.count_distinct(KEY)).scalar()
    return filtered_anomalies.agg(
        F.count_distinct(KEY).alias("clientes_con_anomalias"),
        F.count_if(F.col("criticidad_predicha") == "Alta").alias("alta_severidad"),
        F.count(F.lit(1)).alias("alertas_activas"),
    ).withColumn("total_clientes", total)
