"""Comparison of flags with labels, acceptance criteria and the compliance report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.functions.columns import ratio
from meterlens.operators.severity import severity_rank
from meterlens.params import KEY, METRIC_COLUMNS, NORMAL, TIME, Acceptance


def join_assignments(df: DataFrame, assigned: DataFrame) -> DataFrame:
    """Left join of the cluster id; customers without one get -1.

    No broadcast hint: Catalyst broadcasts the assignments while they are small and otherwise
    merges, splitting the partition of a hot customer.
    """
    joined = df.join(assigned.select(KEY, "cluster_id"), KEY, "left")
    return joined.withColumn("cluster_id", F.coalesce(F.col("cluster_id").cast("int"), F.lit(-1)))


def join_labels(scored: DataFrame, labels: DataFrame, dedupe: bool = False) -> DataFrame:
    """Left join of the labels on customer and time; a reading without a label is normal.

    Other shared columns get ``_pred`` and ``_real``. Repeated label keys repeat the reading,
    unless ``dedupe`` merges them first (anomalous if any copy is, then the highest severity).
    """
    keys = [KEY, TIME]
    labels = labels.withColumn(TIME, F.col(TIME).cast("timestamp"))
    if dedupe:
        merged = [F.max("anomalia_real").alias("anomalia_real")]
        if "criticidad_real" in labels.columns:
            order = F.struct(F.col("anomalia_real"), -severity_rank(F.col("criticidad_real")))
            merged.append(F.max_by("criticidad_real", order).alias("criticidad_real"))
        labels = labels.groupBy(*keys).agg(*merged)
    shared = (set(scored.columns) & set(labels.columns)) - set(keys)
    left = scored.withColumnsRenamed({c: f"{c}_pred" for c in shared})
    right = labels.withColumnsRenamed({c: f"{c}_real" for c in shared})
    joined = left.join(right, keys, "left").withColumn(
        "anomalia_real", F.coalesce(F.col("anomalia_real").cast("boolean"), F.lit(False)))
    if "criticidad_real" in joined.columns:
        joined = joined.withColumn("criticidad_real", F.coalesce("criticidad_real", F.lit(NORMAL)))
    return joined


def unmatched_labels(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Number of label rows that match no reading; the left join does not show them."""
    lost = labels.join(scored.select(KEY, TIME), [KEY, TIME], "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("etiquetas_sin_lectura"))


def confusion(joined: DataFrame) -> DataFrame:
    """Totals and confusion counts in one aggregate; an empty input gives zeros.

    A column ``_copies`` says how many equal rows a row stands for.
    """
    copies = F.coalesce(F.col("_copies"), F.lit(1)) if "_copies" in joined.columns else F.lit(1)
    real, predicted = F.col("anomalia_real"), F.col("anomalia_predicha").cast("boolean")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, copies)), F.lit(0)).cast("bigint")

    return joined.agg(
        total(F.lit(True)).alias("total_muestras"),
        total(real).alias("positivos_reales"),
        total(~real).alias("negativos_reales"),
        total(predicted).alias("positivos_predichos"),
        total(real & predicted).alias("verdaderos_positivos_tp"),
        total(~real & predicted).alias("falsos_positivos_fp"),
        total(~real & ~predicted).alias("verdaderos_negativos_tn"),
        total(real & ~predicted).alias("falsos_negativos_fn"),
        severity_agreement(joined, copies).alias("precision_clasificacion_criticidad"))


def severity_agreement(joined: DataFrame, copies: Column) -> Column:
    """Share of true positives graded as labelled; NULL without true positives or columns."""
    if not {"criticidad_predicha", "criticidad_real"} <= set(joined.columns):
        return F.max(F.lit(None).cast("double"))
    hit = F.col("anomalia_real") & F.col("anomalia_predicha").cast("boolean")
    same = F.coalesce(F.col("criticidad_predicha") == F.col("criticidad_real"), F.lit(False))
    agreed = F.coalesce(F.sum(F.when(hit & same, copies)), F.lit(0))
    return F.try_divide(agreed.cast("double"), F.sum(F.when(hit, copies)).cast("double"))


def derived_metrics(counts: DataFrame) -> DataFrame:
    """Add the rates; a zero denominator gives 0, an empty input NULL."""
    def n(name: str) -> Column:
        return F.col(name).cast("double")

    tp, fp = n("verdaderos_positivos_tp"), n("falsos_positivos_fp")
    tn, fn = n("verdaderos_negativos_tn"), n("falsos_negativos_fn")
    some = F.col("total_muestras") > 0
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    rates = {
        "precision_anomalia": precision,
        "recall_anomalia_sensibilidad": recall,
        "f1_score_anomalia": ratio(F.lit(2.0) * precision * recall, precision + recall),
        "tasa_falsos_positivos": ratio(fp, fp + tn),
        "especificidad": ratio(tn, tn + fp),
        "accuracy_general": ratio(tp + tn, n("total_muestras")),
    }
    return counts.withColumns({k: F.when(some, v) for k, v in rates.items()}).select(*METRIC_COLUMNS)


def evaluate(scored: DataFrame, labels: DataFrame, dedupe: bool = False) -> DataFrame:
    """One row with all metrics.

    Equal labels are counted before the join and weigh in afterwards, which gives the totals
    of the plain join: a key that is labelled very often never meets its reading copy by copy.
    """
    names = [c for c in (KEY, TIME, "anomalia_real", "criticidad_real") if c in labels.columns]
    labels = labels.select(*names)
    if not dedupe:
        labels = labels.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    needed = [c for c in (KEY, TIME, "anomalia_predicha", "criticidad_predicha") if c in scored.columns]
    return derived_metrics(confusion(join_labels(scored.select(*needed), labels, dedupe)))


def _met(actual: Column, limit: Column, upper: bool) -> Column:
    return actual <= limit if upper else actual >= limit


def acceptance(metrics: DataFrame, criteria: Acceptance) -> DataFrame:
    """One row per criterion: value, limit and whether it is met (NULL without a value)."""
    rows = [
        ("tasa_falsos_positivos", criteria.max_false_positive_rate, True),
        ("recall_anomalia_sensibilidad", criteria.min_recall, False),
        ("precision_clasificacion_criticidad", criteria.min_severity_precision, False),
    ]
    checks = F.array(*[
        F.struct(F.lit(name).alias("metrica"), F.col(name).cast("double").alias("actual"),
                 F.lit(float(limit)).alias("requerido"),
                 _met(F.col(name), F.lit(float(limit)), upper).alias("cumple"))
        for name, limit, upper in rows])
    return metrics.select(F.inline(checks)).where(F.col("actual").isNotNull())


def compliance(metrics: DataFrame, criteria: Acceptance, detection_seconds: float | None) -> DataFrame:
    """The five measurable requirements with value, criterion and Sí / No / N/A."""
    minutes = F.lit(detection_seconds).cast("double") / F.lit(60.0)
    recall = F.col("recall_anomalia_sensibilidad")
    # Requirement ids, their texts and where the variable limit comes from.
    rows = [
        ("N2", "Minimizar pérdidas no técnicas (detección)", recall, criteria.min_recall, False),
        ("N3", "Precisión en clasificación de criticidad",
         F.col("precision_clasificacion_criticidad"), criteria.min_severity_precision, False),
        ("D1", "Baja tasa de falsos positivos",
         F.col("tasa_falsos_positivos"), criteria.max_false_positive_rate, True),
        ("D2", "Detectar anomalías en variables (General)", recall,
         criteria.min_variable_recall.get("Volumen", 0.80), False),
        ("D3", "Latencia de procesamiento de alertas", minutes, criteria.max_latency_minutes, True),
    ]
    lines = []
    for code, text, actual, limit, upper in rows:
        met = _met(actual, F.lit(float(limit)), upper)
        lines.append(F.struct(
            F.lit(code).alias("id"), F.lit(text).alias("requerimiento"),
            actual.cast("double").alias("actual"), F.lit(float(limit)).alias("criterio"),
            F.when(met, "Sí").when(~met, "No").otherwise("N/A").alias("cumple")))
    return metrics.select(F.inline(F.array(*lines)))
