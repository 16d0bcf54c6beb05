"""The same results in plain SQL, on the same tables."""

from __future__ import annotations

from collections.abc import Sequence

BASE = ["Presion", "Temperatura", "Volumen"]
GAS = "cantidad_gas_calculada"
ALL = [*BASE, GAS]
CYCLES = ["hora_sin", "hora_cos", "dia_semana_sin", "dia_semana_cos", "mes_sin", "mes_cos"]
PARTS = ["hora_dia", "dia_semana", "dia_mes", "dia_anio", "semana_anio", "mes", "trimestre", "anio", "es_findesemana"]
FEATURES = [f"{c}_scaled" for c in ALL] + CYCLES


def r(expression: str, name: str | None = None) -> str:
    """Rounded to 6 places after the nudge the queries use; adding 0 turns a negative zero into zero."""
    return f"round(({expression}) + 3.3e-8::DOUBLE, 6) + 0.0::DOUBLE AS {name or expression}"


def rs(columns: Sequence[str], prefix: str = "") -> str:
    return ", ".join(r(prefix + c, c) for c in columns)


def ts(expression: str = "Fecha", name: str | None = None) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S') AS {name or expression}"


def calendar_sql(t: str = "Fecha") -> str:
    return f"""CAST(extract(hour FROM {t}) AS INTEGER) AS hora_dia,
      CAST(extract(isodow FROM {t}) - 1 AS INTEGER) AS dia_semana,
      CAST(extract(day FROM {t}) AS INTEGER) AS dia_mes, CAST(extract(doy FROM {t}) AS INTEGER) AS dia_anio,
      CAST(extract(week FROM {t}) AS INTEGER) AS semana_anio, CAST(extract(month FROM {t}) AS INTEGER) AS mes,
      CAST(extract(quarter FROM {t}) AS INTEGER) AS trimestre, CAST(extract(year FROM {t}) AS INTEGER) AS anio,
      CASE WHEN extract(isodow FROM {t}) IN (6, 7) THEN 1 ELSE 0 END AS es_findesemana"""


CYCLE_SQL = """sin(2 * pi() * hora_dia / 24) AS hora_sin, cos(2 * pi() * hora_dia / 24) AS hora_cos,
      sin(2 * pi() * dia_semana / 7) AS dia_semana_sin, cos(2 * pi() * dia_semana / 7) AS dia_semana_cos,
      sin(2 * pi() * mes / 12) AS mes_sin, cos(2 * pi() * mes / 12) AS mes_cos"""

SERIES = "PARTITION BY cliente_id ORDER BY Fecha"
BEFORE = f"OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
AFTER = f"OVER ({SERIES} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def linear(c: str) -> str:
    return f"""coalesce({c}, b_{c} + (a_{c} - b_{c}) / nullif(ap_{c} - bp_{c}, 0) * (pos - bp_{c}),
      b_{c}, a_{c}, 0) AS {c}"""


def neighbours(c: str) -> str:
    return f"""last_value({c} IGNORE NULLS) {BEFORE} AS b_{c},
      last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {BEFORE} AS bp_{c},
      first_value({c} IGNORE NULLS) {AFTER} AS a_{c},
      first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {AFTER} AS ap_{c}"""


def severity_sql(score: str, mean: str, std: str, high=3.0, mid=2.0, mid_top=3.0, low=1.5, low_top=2.0) -> str:
    z = f"(({score}) - ({mean})) / nullif({std}, 0)"
    return f"""CASE WHEN ({score}) IS NULL OR ({mean}) IS NULL OR ({std}) IS NULL THEN 'Indeterminada'
      WHEN ({std}) < 1e-6 AND ({score}) > ({mean}) + 1e-6 THEN 'Alta' WHEN ({std}) < 1e-6 THEN 'Muy Baja'
      WHEN {z} >= {high} THEN 'Alta' WHEN {z} >= {mid} AND {z} < {mid_top} THEN 'Media'
      WHEN {z} >= {low} AND {z} < {low_top} THEN 'Baja' ELSE 'Muy Baja' END"""


RANK_SQL = """CASE criticidad_predicha WHEN 'Alta' THEN 0 WHEN 'Media' THEN 1 WHEN 'Baja' THEN 2
      WHEN 'Muy Baja' THEN 3 WHEN 'Indeterminada' THEN 4 WHEN 'Normal' THEN 5 ELSE 6 END"""


def clip(c: str, table: str = "l") -> str:
    return (f"CASE WHEN {c} < {table}.lo_{c} THEN {table}.lo_{c} WHEN {c} > {table}.hi_{c} "
            f"THEN {table}.hi_{c} ELSE {c} END AS {c}")


def iqr_limits(columns: Sequence[str], factor: float = 1.5) -> str:
    out = []
    for c in columns:
        q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
        out.append(f"CASE WHEN {q3} - {q1} <> 0 THEN {q1} - {factor}::DOUBLE * ({q3} - {q1}) END AS lo_{c}")
        out.append(f"CASE WHEN {q3} - {q1} <> 0 THEN {q3} + {factor}::DOUBLE * ({q3} - {q1}) END AS hi_{c}")
    return ", ".join(out)


SPLIT_SQL = """CASE WHEN n < 3 THEN 'train' WHEN n_rest <= 0 THEN 'test'
      WHEN n_rest - n_val <= 0 AND pos <= n_val THEN 'val' WHEN n_rest - n_val <= 0 THEN 'test'
      WHEN pos <= n_rest - n_val THEN 'train' WHEN pos <= n_rest THEN 'val' ELSE 'test' END"""


def split_of(source: str) -> str:
    return f"""SELECT *, {SPLIT_SQL} AS particion FROM (
      SELECT *, CAST(floor((n - floor(n * 0.2::DOUBLE)) * 0.15::DOUBLE) AS BIGINT) AS n_val FROM (
        SELECT *, n - CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS n_rest FROM (
          SELECT *, row_number() OVER ({SERIES}) AS pos, count(*) OVER (PARTITION BY cliente_id) AS n
          FROM {source}) a) b) c"""


# Named steps; each may use the ones before it.
STEPS: dict[str, str] = {
    "raw": """SELECT 'CLIENTE' || CAST(user_id AS VARCHAR) AS cliente_id, event_id AS seq,
      CASE WHEN event_id % 101 = 0 THEN 'bad-date' ELSE CAST(date_trunc('hour', ts) AS VARCHAR) END AS fecha_txt,
      CASE WHEN event_id % 13 = 0 THEN NULL
        ELSE 15 + CAST(event_id % 50 AS DOUBLE) / CAST(10 AS DOUBLE) END AS Presion,
      CASE WHEN user_id % 50 = 7 THEN NULL WHEN event_id % 997 = 0 THEN CAST(-273.15 AS DOUBLE)
        ELSE 10 + CAST((event_id * 7) % 250 AS DOUBLE) / CAST(10 AS DOUBLE) END AS Temperatura,
      CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 211 = 0 THEN value * 20 ELSE value END AS Volumen
      FROM events""",
    "keyed": """SELECT cliente_id, Fecha, seq, Presion, Temperatura, Volumen FROM (
      SELECT *, TRY_CAST(fecha_txt AS TIMESTAMP) AS Fecha, row_number() OVER (
        PARTITION BY cliente_id, TRY_CAST(fecha_txt AS TIMESTAMP) ORDER BY seq) AS rn FROM raw) z
      WHERE Fecha IS NOT NULL AND rn = 1""",
    "gas": """SELECT cliente_id, Fecha, Presion, Temperatura, Volumen,
      CASE WHEN 8.314::DOUBLE * (Temperatura + 273.15::DOUBLE) <> 0
        THEN (Presion * 1000 * Volumen) / (8.314::DOUBLE * (Temperatura + 273.15::DOUBLE)) END
        AS cantidad_gas_calculada FROM keyed""",
    "assigned": """SELECT 'CLIENTE' || CAST(user_id AS VARCHAR) AS cliente_id,
      CAST(user_id % 3 AS INTEGER) AS cluster_id FROM events WHERE user_id % 10 <> 9 GROUP BY user_id""",
    "labelled": """SELECT cliente_id, Fecha, Presion, coalesce(Volumen >= 80, false) AS anomalia_real,
      CASE WHEN Volumen >= 120 THEN 'Alta' ELSE 'Media' END AS criticidad_real
      FROM keyed WHERE Temperatura IS NOT NULL""",
    "truth": """SELECT cliente_id, Fecha, anomalia_real, criticidad_real FROM labelled
      UNION ALL SELECT cliente_id, Fecha, anomalia_real, criticidad_real FROM labelled WHERE Presion IS NULL
      UNION ALL SELECT cliente_id, Fecha + INTERVAL '1' YEAR, anomalia_real, criticidad_real
        FROM labelled WHERE anomalia_real""",
    "found": f"""SELECT TIMESTAMP '2024-02-01 00:00:00' AS timestamp_deteccion, g.*,
      'LSTM_AE_Cluster' AS modelo_deteccion, Volumen / 10 AS score_anomalia_final,
      {severity_sql('Volumen / 10', '5.0::DOUBLE', '1.5::DOUBLE')} AS criticidad_predicha
      FROM gas g WHERE Volumen >= 60""",
    "view": f"""SELECT v.*, {CYCLE_SQL} FROM (SELECT g.cliente_id, Fecha AS datetime, Presion, Temperatura, Volumen,
      cantidad_gas_calculada, {calendar_sql()}, coalesce(a.cluster_id, -1) AS cluster_id
      FROM gas g LEFT JOIN assigned a USING (cliente_id)) v""",
    "found_view": """SELECT row_number() OVER (ORDER BY f.cliente_id, f.Fecha) - 1 AS anomalia_id,
      f.Fecha AS datetime, f.* EXCLUDE (Fecha), coalesce(a.cluster_id, -1) AS cluster_id
      FROM found f LEFT JOIN assigned a USING (cliente_id)""",
    "filled": f"""SELECT cliente_id, Fecha, {', '.join(linear(c) for c in ALL)} FROM (
      SELECT *, {', '.join(neighbours(c) for c in ALL)} FROM (
        SELECT *, row_number() OVER ({SERIES}) AS pos FROM gas) p) q""",
    "limits": f"SELECT cliente_id, {iqr_limits(ALL)} FROM filled GROUP BY cliente_id",
    "capped": f"SELECT f.cliente_id, Fecha, {', '.join(clip(c) for c in ALL)} FROM filled f JOIN limits l USING (cliente_id)",
    "clean": f"SELECT c.*, {CYCLE_SQL} FROM (SELECT *, {calendar_sql()} FROM capped) c",
    "work": "SELECT c.*, a.cluster_id FROM clean c JOIN assigned a USING (cliente_id)",
    "placed": split_of("work"),
    "placed_all": split_of("clean"),
    "scaler": "SELECT cluster_id, " + ", ".join(
        f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in ALL)
    + " FROM placed GROUP BY cluster_id",
    "scaled": "SELECT p.*, " + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}_scaled" for c in ALL)
    + " FROM placed p JOIN scaler USING (cluster_id)",
    "judged": """SELECT cliente_id, Fecha, coalesce(Volumen >= 70, false) AS anomalia_predicha,
      CASE WHEN NOT coalesce(Volumen >= 70, false) THEN 'Normal' WHEN Volumen >= 110 THEN 'Alta' ELSE 'Media' END
      AS criticidad_predicha FROM keyed""",
    "lines": """SELECT CAST(l_suppkey AS VARCHAR) AS cliente_id, l_shipdate AS Fecha, l_extendedprice AS Volumen,
      l_quantity AS Presion, l_discount AS Temperatura FROM lineitem""",
}

NEEDS: dict[str, list[str]] = {
    "raw": [], "lines": [], "assigned": [], "keyed": ["raw"], "gas": ["keyed"], "labelled": ["keyed"],
    "truth": ["labelled"], "found": ["gas"], "view": ["gas", "assigned"], "found_view": ["found", "assigned"],
    "filled": ["gas"], "limits": ["filled"], "capped": ["filled", "limits"], "clean": ["capped"],
    "work": ["clean", "assigned"], "placed": ["work"], "placed_all": ["clean"], "scaler": ["placed"], "scaled": ["placed", "scaler"],
    "judged": ["keyed"],
}


def sql(body: str, *steps: str, extra: dict[str, str] | None = None) -> str:
    """``body`` after the named steps and all they need, then the extra ones in order."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS[name]:
            add(other)
        if name not in wanted:
            wanted.append(name)

    for step in steps:
        add(step)
    parts = [f"{name} AS MATERIALIZED ({STEPS[name]})" for name in wanted]
    parts += [f"{name} AS MATERIALIZED ({text})" for name, text in (extra or {}).items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


# --- windows ------------------------------------------------------------------------------

def frame_sql(source: str, features: Sequence[str], keys: str, position: str, extra: str = "") -> dict[str, str]:
    """Steps ``cells`` (row, feature, value) and ``frames`` (window, step, feature, value)."""
    cells = " UNION ALL ".join(
        f"SELECT {keys}, {position} AS p, {i} AS f, {c} AS v FROM {source}" for i, c in enumerate(features))
    on = " AND ".join(f"e.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    return {
        "cells": cells,
        "frames": f"""SELECT {', '.join('e.' + k.strip() for k in keys.split(','))}, e.{position} AS fin,
          c.p - e.{position} + 23 AS paso, c.f, c.v {extra}
          FROM {source} e JOIN cells c ON {on} AND c.p BETWEEN e.{position} - 23 AND e.{position}
          WHERE e.{position} >= 24"""}


SPLIT_FRAME = ", first_value(particion) OVER (PARTITION BY cliente_id ORDER BY pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"

WHOLE = {
    "marked": f"""SELECT *, CASE WHEN pos >= 24 AND particion = {SPLIT_FRAME[2:]}
      THEN particion END AS particion_ventana FROM scaled""",
    **frame_sql("marked", FEATURES, "cliente_id", "pos", ", e.cluster_id, e.particion_ventana"),
    "means": """SELECT cluster_id, paso, f, avg(v) AS m FROM frames WHERE particion_ventana = 'train'
      GROUP BY cluster_id, paso, f""",
    "errors": """SELECT cliente_id, fin, any_value(cluster_id) AS cluster_id,
      any_value(particion_ventana) AS particion_ventana, avg(abs(v - m)) AS error
      FROM frames JOIN means USING (cluster_id, paso, f) GROUP BY cliente_id, fin""",
    "thresholds": """SELECT cluster_id, coalesce(mv + 2.0::DOUBLE * sv, mt + 2.0::DOUBLE *
        CASE WHEN st < 1e-6 THEN 1 ELSE st END) AS umbral, coalesce(mv, mt) AS media,
        coalesce(CASE WHEN sv < 1e-6 THEN 1 ELSE sv END, CASE WHEN st < 1e-6 THEN 1 ELSE st END) AS desviacion
      FROM (SELECT cluster_id, avg(error) FILTER (WHERE particion_ventana = 'val') AS mv,
        stddev_pop(error) FILTER (WHERE particion_ventana = 'val') AS sv,
        avg(error) FILTER (WHERE particion_ventana = 'train') AS mt,
        stddev_pop(error) FILTER (WHERE particion_ventana = 'train') AS st
        FROM errors GROUP BY cluster_id) t""",
    "scored": f"""SELECT s.cliente_id, s.Fecha, s.cluster_id, coalesce(e.error > t.umbral, false) AS anomalia_predicha,
      CASE WHEN t.umbral IS NOT NULL THEN e.error END AS score_anomalia_final,
      'LSTM_AE_Cluster' AS modelo_deteccion,
      CASE WHEN NOT coalesce(e.error > t.umbral, false) THEN 'Normal'
        ELSE {severity_sql('e.error', 't.media', 't.desviacion')} END AS criticidad_predicha
      FROM marked s LEFT JOIN errors e ON e.cliente_id = s.cliente_id AND e.fin = s.pos
      LEFT JOIN thresholds t ON t.cluster_id = s.cluster_id""",
}

# Windows that run on from one customer of a cluster to the next.
ACROSS_TRAIN = {
    "parts": """SELECT *, row_number() OVER (PARTITION BY cluster_id, particion ORDER BY cliente_id, Fecha) AS tpos
      FROM scaled WHERE particion IN ('train', 'val')""",
}


def across(features: Sequence[str]) -> dict[str, str]:
    scored = frame_sql("ordered", features, "cluster_id", "cpos")
    trained = frame_sql("parts", features, "cluster_id, particion", "tpos")
    return {
        "ordered": "SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY cliente_id, Fecha) AS cpos FROM scaled",
        **ACROSS_TRAIN,
        "cells": scored["cells"], "frames": scored["frames"],
        "tcells": trained["cells"], "tframes": trained["frames"].replace("JOIN cells", "JOIN tcells"),
    }


RANK = 16

# The projection on the leading RANK components of each cluster's training windows. The covariance, scaled so that
# no eigenvalue is over 1, goes to X*X while its trace is over RANK and to 2*X - X*X while it is under, which drives the
# leading eigenvalues to 1 and the others to 0. Near the end both take turns, so that both kinds settle.
PROJECTION = {
    "columns": f"""SELECT cluster_id, fin // 1024 AS tramo, paso * {len(FEATURES)} + f + 1 AS i, list(v - m ORDER BY fin) AS x
      FROM tframes JOIN means USING (cluster_id, paso, f) WHERE particion = 'train' GROUP BY cluster_id, tramo, i""",
    "covariance": """SELECT a.cluster_id, a.i, b.i AS j, sum(list_dot_product(a.x, b.x)) AS c
      FROM columns a JOIN columns b USING (cluster_id, tramo) GROUP BY a.cluster_id, a.i, b.i""",
    "projection": f"""WITH RECURSIVE turns AS (
      SELECT cluster_id, 0 AS turn, i, list(CASE WHEN size > 0 THEN c / size ELSE 0.0::DOUBLE END ORDER BY j) AS x
        FROM covariance JOIN (SELECT cluster_id, sqrt(sum(c * c)) AS size FROM covariance GROUP BY cluster_id) z
        USING (cluster_id) GROUP BY cluster_id, i
      UNION ALL
      SELECT cluster_id, turn + 1, i, list(CASE WHEN CASE WHEN abs(trace - {RANK}) + trace - trace2 < 0.01
          THEN turn % 2 = 0 ELSE trace > {RANK} END THEN x2 ELSE 2 * x - x2 END ORDER BY j)
        FROM (SELECT a.cluster_id, a.turn, a.i, b.i AS j, a.x[b.i] AS x, list_dot_product(a.x, b.x) AS x2, trace, trace2
          FROM turns a JOIN turns b USING (cluster_id) JOIN (
            SELECT cluster_id, sum(x[i]) AS trace, sum(list_dot_product(x, x)) AS trace2 FROM turns GROUP BY cluster_id) t
          USING (cluster_id) WHERE trace - trace2 > 1e-13 AND a.turn < 200) s
        GROUP BY cluster_id, turn, i)
      SELECT cluster_id, i, x FROM turns QUALIFY turn = max(turn) OVER (PARTITION BY cluster_id)""",
}


def left_over(source: str, keys: str) -> str:
    """Mean absolute error of each window of ``source``: what the mean window and the components leave of it."""
    return f"""SELECT {keys}, fin, avg(abs(w[i] - list_dot_product(x, w))) AS error FROM (
      SELECT {keys}, fin, list(v - m ORDER BY paso, f) AS w FROM {source} JOIN means USING (cluster_id, paso, f)
      GROUP BY {keys}, fin) y JOIN projection USING (cluster_id) GROUP BY {keys}, fin"""


ACROSS = {
    **across(FEATURES),
    "means": "SELECT cluster_id, paso, f, avg(v) AS m FROM tframes WHERE particion = 'train' GROUP BY cluster_id, paso, f",
    **PROJECTION,
    "terrors": f"SELECT * RENAME (particion AS particion_ventana) FROM ({left_over('tframes', 'cluster_id, particion')}) z",
    "errors": left_over("frames", "cluster_id"),
    "thresholds": WHOLE["thresholds"].replace("FROM errors", "FROM terrors"),
    "scored": WHOLE["scored"].replace(
        "FROM marked s LEFT JOIN errors e ON e.cliente_id = s.cliente_id AND e.fin = s.pos",
        "FROM ordered s LEFT JOIN errors e ON e.cluster_id = s.cluster_id AND e.fin = s.cpos"),
}


# --- evaluation ---------------------------------------------------------------------------

JOINED = {"joined": """SELECT j.*, coalesce(t.anomalia_real, false) AS anomalia_real,
  coalesce(t.criticidad_real, 'Normal') AS criticidad_real FROM {source} j LEFT JOIN truth t USING (cliente_id, Fecha)"""}

COUNTS = """SELECT count(*) AS total_muestras, count(*) FILTER (WHERE anomalia_real) AS positivos_reales,
  count(*) FILTER (WHERE NOT anomalia_real) AS negativos_reales,
  count(*) FILTER (WHERE anomalia_predicha) AS positivos_predichos,
  count(*) FILTER (WHERE anomalia_real AND anomalia_predicha) AS verdaderos_positivos_tp,
  count(*) FILTER (WHERE NOT anomalia_real AND anomalia_predicha) AS falsos_positivos_fp,
  count(*) FILTER (WHERE NOT anomalia_real AND NOT anomalia_predicha) AS verdaderos_negativos_tn,
  count(*) FILTER (WHERE anomalia_real AND NOT anomalia_predicha) AS falsos_negativos_fn,
  avg(CASE WHEN anomalia_real AND anomalia_predicha THEN CASE WHEN criticidad_predicha = criticidad_real
    THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) AS precision_clasificacion_criticidad FROM joined"""

METRICS = """SELECT *, CASE WHEN total_muestras > 0 THEN CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END END
    AS f1_score_anomalia, CASE WHEN total_muestras > 0 THEN p END AS precision_anomalia,
    CASE WHEN total_muestras > 0 THEN c END AS recall_anomalia_sensibilidad FROM (SELECT *,
  coalesce(verdaderos_positivos_tp / nullif(verdaderos_positivos_tp + falsos_positivos_fp, 0), 0) AS p,
  coalesce(verdaderos_positivos_tp / nullif(verdaderos_positivos_tp + falsos_negativos_fn, 0), 0) AS c,
  CASE WHEN total_muestras > 0 THEN coalesce(falsos_positivos_fp
    / nullif(falsos_positivos_fp + verdaderos_negativos_tn, 0), 0) END AS tasa_falsos_positivos,
  CASE WHEN total_muestras > 0 THEN coalesce(verdaderos_negativos_tn
    / nullif(falsos_positivos_fp + verdaderos_negativos_tn, 0), 0) END AS especificidad,
  (verdaderos_positivos_tp + verdaderos_negativos_tn) / nullif(total_muestras, 0) AS accuracy_general
  FROM counts) m"""

COUNT_COLUMNS = ["total_muestras", "positivos_reales", "negativos_reales", "positivos_predichos",
                 "verdaderos_positivos_tp", "falsos_positivos_fp", "verdaderos_negativos_tn", "falsos_negativos_fn"]
RATE_COLUMNS = ["precision_anomalia", "recall_anomalia_sensibilidad", "f1_score_anomalia", "tasa_falsos_positivos",
                "especificidad", "accuracy_general", "precision_clasificacion_criticidad"]
METRIC_SELECT = f"SELECT {', '.join(COUNT_COLUMNS)}, {rs(RATE_COLUMNS)} FROM metrics"


def evaluated(source: str) -> dict[str, str]:
    return {"joined": JOINED["joined"].format(source=source), "counts": COUNTS, "metrics": METRICS}


# --- small builders -----------------------------------------------------------------------

def moments(columns: Sequence[str], source: str) -> str:
    rows = [f"""SELECT '{c}' AS variable, count({c}) AS count, {r(f'avg({c})', 'mean')},
      {r(f'stddev_samp({c})', 'std')}, {r(f'min({c})', 'min')}, {r(f'max({c})', 'max')},
      {r(f'quantile_cont({c}, 0.25)', 'p25')}, {r(f'quantile_cont({c}, 0.5)', 'p50')},
      {r(f'quantile_cont({c}, 0.75)', 'p75')} FROM {source}""" for c in columns]
    return " UNION ALL ".join(rows)


def correlations(columns: Sequence[str], source: str) -> str:
    rows = [f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, {r(f'corr({a}, {b})', 'correlacion')} FROM {source}"
            for a in columns for b in columns]
    return " UNION ALL ".join(rows)


def long_rows(source: str, columns: Sequence[str], value: str = "round(x + 3.3e-8::DOUBLE, 6) + 0.0::DOUBLE") -> str:
    rows = [f"SELECT datetime, cliente_id, cluster_id, '{c}' AS variable, CAST({c} AS DOUBLE) AS x FROM {source}"
            for c in columns]
    return (f"SELECT {ts('datetime')}, cliente_id, cluster_id, variable, {value} AS valor "
            f"FROM ({' UNION ALL '.join(rows)}) u")


def pattern(source: str, part: str, value: str) -> str:
    return f"""SELECT {part}, {r('m', 'mean')}, {r('s', 'std')}, {r('m + s', 'upper_bound')},
      {r('m - s', 'lower_bound')} FROM (SELECT {part}, avg({value}) AS m, coalesce(stddev_samp({value}), 0) AS s
      FROM {source} WHERE {value} IS NOT NULL AND {part} IS NOT NULL GROUP BY {part}) p"""


def profile_columns() -> list[str]:
    def cv(c: str) -> str:
        return f"CASE WHEN avg({c}) = 0 THEN 0 ELSE stddev_pop({c}) / avg({c}) END"
    return ["avg(Volumen) AS Volumen_mean", "stddev_pop(Volumen) AS Volumen_std",
            "quantile_cont(Presion, 0.5) AS Presion_median", f"avg({GAS}) AS {GAS}_mean",
            "avg(Temperatura) AS Temperatura_mean", f"{cv('Temperatura')} AS Temperatura_cv",
            "max(Presion) - min(Presion) AS Presion_range", "sum(Volumen) AS Volumen_sum",
            "min(Volumen) AS Volumen_min", "max(Volumen) AS Volumen_max",
            "quantile_cont(Temperatura, 0.5) AS Temperatura_median",
            "CAST(NULL AS DOUBLE) AS consumo_finde_ratio", "CAST(NULL AS DOUBLE) AS Volumen_moda"]


PROFILE_NAMES = [c.rsplit(" AS ", 1)[1] for c in profile_columns()]
PROFILE = {"profile": f"SELECT cliente_id, {', '.join(profile_columns())} FROM gas GROUP BY cliente_id"}
SPECS = ["Volumen_mean", "Volumen_std", "Presion_median", f"{GAS}_mean"]
PROFILE_FILLED = {**PROFILE, "filled_profile": "SELECT cliente_id, " + ", ".join(
    f"coalesce({c}, avg({c}) OVER (), 0) AS {c}" for c in PROFILE_NAMES) + " FROM profile"}

PICKED = {
    "inside": """SELECT * FROM view WHERE datetime >= TIMESTAMP '2024-01-03' AND datetime <= TIMESTAMP '2024-01-25 23:59:59'
      AND cluster_id = 1""",
    "picked": "SELECT coalesce(max(cliente_id) FILTER (WHERE cliente_id = 'CLIENTE0'), min(cliente_id)) AS c FROM inside",
    "selected": "SELECT * FROM inside WHERE cliente_id = (SELECT c FROM picked)",
    "alerts": """SELECT * FROM found_view WHERE datetime >= TIMESTAMP '2024-01-03'
      AND datetime <= TIMESTAMP '2024-01-25 23:59:59' AND cluster_id = 1 AND cliente_id = (SELECT c FROM picked)""",
}


def on_selection(body: str) -> str:
    return sql(body, "view", "found_view", extra=PICKED)


def statistics(value: str, source: str) -> str:
    return f"""SELECT {r(f'avg({value})', 'mean')}, {r(f'stddev_samp({value})', 'std')}, {r(f'min({value})', 'min')},
      {r(f'max({value})', 'max')}, {r(f'quantile_cont({value}, 0.5)', 'median')},
      {r(f'quantile_cont({value}, 0.25)', 'quantile_25')}, {r(f'quantile_cont({value}, 0.75)', 'quantile_75')}
      FROM {source}"""


def detail(source: str) -> str:
    numbers = ["score_anomalia_final", *ALL]
    half_even = ", ".join(f"round_even({c}, 3) AS {c}" for c in numbers)
    return (f"SELECT anomalia_id, {ts('datetime')}, cliente_id, criticidad_predicha, modelo_deteccion, "
            f"{half_even} FROM {source}")


BAND = """SELECT {media}, {desviacion}, {inferior}, {superior} FROM (SELECT avg(Volumen) AS m, stddev_samp(Volumen) AS s
  FROM {source}) b WHERE s > 0"""


def band(source: str) -> str:
    return BAND.format(source=source, media=r("m", "media"), desviacion=r("s", "desviacion"),
                       inferior=r("m - 1.5::DOUBLE * s", "inferior"), superior=r("m + 1.5::DOUBLE * s", "superior"))


def frequent(source: str) -> str:
    return f"""SELECT cliente_id, criticidad_predicha AS criticidad_frecuente FROM (SELECT cliente_id,
      criticidad_predicha, row_number() OVER (PARTITION BY cliente_id ORDER BY count(*) DESC, {RANK_SQL}) AS rn
      FROM {source} GROUP BY cliente_id, criticidad_predicha) z WHERE rn = 1"""


def totals(source: str) -> str:
    return f"""SELECT count(DISTINCT cliente_id) AS clientes_con_anomalias,
      count(*) FILTER (WHERE criticidad_predicha = 'Alta') AS alta_severidad, count(*) AS alertas_activas,
      (SELECT count(DISTINCT cliente_id) FROM view) AS total_clientes FROM {source}"""


def filled(method: str) -> str:
    parts = {
        "ffill": lambda c: f"coalesce(last_value({c} IGNORE NULLS) {BEFORE}, 0)",
        "bfill": lambda c: f"coalesce(first_value({c} IGNORE NULLS) {AFTER}, 0)",
        "mean": lambda c: f"coalesce({c}, avg({c}) OVER (PARTITION BY cliente_id), 0)",
        "zero": lambda c: f"coalesce({c}, 0)",
    }[method]
    return sql(f"SELECT cliente_id, {ts()}, {', '.join(r(parts(c), c) for c in ALL)} FROM gas", "gas")


VECTORS = {
    "points": "SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings",
    "cells": "SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM points",
    "centres": "SELECT label, d, avg(x) AS c FROM cells GROUP BY label, d",
}

SILHOUETTE = sql(f"""SELECT {r('avg(s)', 'silueta')} FROM (SELECT CASE WHEN n <= 1 THEN 0
    ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS s FROM own JOIN others USING (vec_id)) z""", extra={
    "points": VECTORS["points"],
    "sums": """SELECT p.vec_id, p.label, q.label AS other, sum(list_distance(p.v, q.v)) AS total, count(*) AS n
      FROM points p, points q GROUP BY p.vec_id, p.label, q.label""",
    "own": "SELECT vec_id, n, total / nullif(n - 1, 0) AS a FROM sums WHERE label = other",
    "others": "SELECT vec_id, min(total / n) AS b FROM sums WHERE label <> other GROUP BY vec_id"})

DAVIES_BOULDIN = sql(f"""SELECT {r('avg(worst)', 'davies_bouldin')} FROM (SELECT s.label,
    max((s.s + o.s) / dist.d) AS worst FROM spread s JOIN dist ON dist.a = s.label
    JOIN spread o ON o.label = dist.b GROUP BY s.label) z""", extra={
    **VECTORS,
    "apart": "SELECT vec_id, label, sqrt(sum((x - c) * (x - c))) AS e FROM cells JOIN centres USING (label, d) GROUP BY vec_id, label",
    "spread": "SELECT label, avg(e) AS s FROM apart GROUP BY label",
    "dist": """SELECT a.label AS a, b.label AS b, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d FROM centres a
      JOIN centres b ON a.d = b.d AND a.label <> b.label GROUP BY a.label, b.label"""})


KNEES = """WITH steps AS (SELECT o_orderpriority AS curva, CAST(floor(sqrt(o_totalprice / 1000)) AS INTEGER) AS k, count(*) AS n
    FROM orders GROUP BY ALL),
  curves AS (SELECT curva, k, coalesce(sum(n) OVER (PARTITION BY curva ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS y
    FROM steps),
  ends AS (SELECT curva, min(k) AS k0, max(k) AS k1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM curves GROUP BY curva),
  apart AS (SELECT curva, k, n, row_number() OVER (PARTITION BY curva ORDER BY k) AS i,
    1.0::DOUBLE - (y - y0) / nullif(y1 - y0, 0) - (k - k0) / nullif(k1 - k0, 0)::DOUBLE AS d FROM curves JOIN ends USING (curva)),
  turns AS (SELECT a.*, coalesce(b.d, a.d) <= a.d AND coalesce(c.d, a.d) <= a.d AS top, coalesce(b.d, a.d) >= a.d AND coalesce(c.d, a.d) >= a.d AS low,
    c.d AS after FROM apart a LEFT JOIN apart b ON b.curva = a.curva AND b.i = a.i - 1 LEFT JOIN apart c ON c.curva = a.curva AND c.i = a.i + 1),
  falls AS (SELECT t.curva, t.i, (SELECT arg_max(CASE WHEN e.low THEN 0 ELSE e.d - 1.0::DOUBLE / (e.n - 1) END, e.i) FROM turns e
      WHERE e.curva = t.curva AND e.i <= t.i AND (e.top OR e.low)) AS line,
    (SELECT max(e.k) FROM turns e WHERE e.curva = t.curva AND e.i <= t.i AND e.top) AS codo, t.after FROM turns t)
  SELECT curva, arg_min(codo, i) FILTER (WHERE codo IS NOT NULL AND after < line) AS codo FROM falls GROUP BY curva"""


def oracles() -> dict[str, str]:
    o: dict[str, str] = {}

    # projections, filters, cleaning
    o["rename_aliases"] = sql(f"SELECT cliente_id, {ts('Fecha', 'datetime')}, {rs(BASE)} FROM keyed", "keyed")
    o["rename_anomaly_aliases"] = sql(
        f"SELECT cliente_id, {ts('Fecha', 'datetime')}, criticidad_predicha, {r('score_anomalia_final')} FROM found", "found")
    o["keep_columns"] = sql(f"SELECT cliente_id, fecha_txt, {rs(BASE)} FROM raw", "raw")
    o["parse_dates"] = sql(f"""SELECT cliente_id, seq, {rs(BASE)}, {ts('TRY_CAST(fecha_txt AS TIMESTAMP)', 'Fecha')}
      FROM raw WHERE TRY_CAST(fecha_txt AS TIMESTAMP) IS NOT NULL""", "raw")
    o["keep_first"] = sql(f"SELECT cliente_id, {ts()}, seq, {rs(BASE)} FROM keyed", "keyed")
    o["infinities_to_null"] = f"""SELECT event_id, {r('CASE WHEN event_id % 5 >= 3 THEN value END', 'value')} FROM events"""
    o["gas_quantity"] = sql(f"SELECT cliente_id, {ts()}, {rs(ALL)} FROM gas", "gas")
    o["gas_summary"] = sql(f"""SELECT {r(f'min({GAS})', 'minimo')}, {r(f'max({GAS})', 'maximo')}, {r(f'avg({GAS})', 'media')},
      count(*) FILTER (WHERE {GAS} IS NULL) AS nulos, count(*) FILTER (WHERE Temperatura IS NULL
      OR 8.314::DOUBLE * (Temperatura + 273.15::DOUBLE) = 0) AS denominadores_invalidos FROM gas""", "gas")
    o["filter_selection"] = sql(f"""SELECT {ts('datetime')}, cliente_id, cluster_id, criticidad_predicha,
      {r('score_anomalia_final')} FROM found_view WHERE datetime >= TIMESTAMP '2024-01-05'
      AND datetime <= TIMESTAMP '2024-01-20 23:59:59' AND cluster_id = 1 AND criticidad_predicha = 'Alta'""", "found_view")
    o["filter_everything"] = sql(f"SELECT {ts('datetime')}, cliente_id, criticidad_predicha FROM found_view", "found_view")
    o["default_dates"] = sql(f"""SELECT {ts("date_trunc('day', max(datetime) - INTERVAL 180 DAY)", 'inicio')},
      {ts("date_trunc('day', max(datetime)) + INTERVAL 1 DAY - INTERVAL 1 SECOND", 'fin')} FROM view""", "view")
    o["pick_client"] = sql("""SELECT coalesce(max(cliente_id) FILTER (WHERE cliente_id = 'CLIENTE3'), min(cliente_id))
      AS cliente_id FROM view WHERE cluster_id = 2""", "view")
    o["fill_constants"] = sql(f"""SELECT k.cliente_id, {ts('k.Fecha', 'Fecha')}, {r('coalesce(k.Presion, -1)', 'Presion')},
      {r('k.Temperatura', 'Temperatura')}, {r('coalesce(k.Volumen, 0)', 'Volumen')},
      coalesce(anomalia_real, false) AS anomalia_real, coalesce(criticidad_real, 'Normal') AS criticidad_real
      FROM keyed k LEFT JOIN truth t USING (cliente_id, Fecha)""", "keyed", "truth")
    o["drop_missing"] = sql(f"""SELECT cliente_id, {ts()}, {rs(BASE)} FROM keyed
      WHERE Presion IS NOT NULL AND Volumen IS NOT NULL""", "keyed")
    o["cast_columns"] = sql(f"""SELECT seq, {ts('TRY_CAST(fecha_txt AS TIMESTAMP)', 'fecha_txt')}, {rs(['Volumen'])},
      seq % 2 = 1 AS bandera, CAST(seq AS VARCHAR) AS entero FROM raw""", "raw")
    titles = "CASE variable WHEN 'cantidad_gas_calculada' THEN 'Cantidad Gas Calculada' ELSE variable END"
    o["presentation"] = sql(f"""SELECT datetime, cliente_id, {titles} AS titulo, valor
      FROM ({long_rows('view', ALL, 'round_even(x, 3)')}) z""", "view")
    o["anomaly_row_ids"] = sql(f"SELECT anomalia_id, cliente_id, {ts('datetime')} FROM found_view", "found_view")
    o["detail_table"] = sql(detail("found_view"), "found_view")
    o["anomaly_overlay"] = sql(f"""SELECT {ts('datetime')}, {r('Presion', 'valor')}, criticidad_predicha,
      {r('score_anomalia_final')}, modelo_deteccion FROM found_view WHERE Presion IS NOT NULL""", "found_view")
    o["anomaly_report"] = sql(f"""SELECT {ts('timestamp_deteccion')}, f.cliente_id, coalesce(a.cluster_id, -1) AS cluster_id,
      {ts()}, {rs(ALL)}, modelo_deteccion, {r('score_anomalia_final')}, criticidad_predicha
      FROM found f LEFT JOIN assigned a USING (cliente_id)""", "found", "assigned")

    # gaps, outliers, calendar, scaling, split
    o["fill_linear"] = sql(f"SELECT cliente_id, {ts()}, {rs(ALL)} FROM filled", "filled")
    o["fill_forward"] = filled("ffill")
    o["fill_backward"] = filled("bfill")
    o["fill_customer_mean"] = filled("mean")
    o["fill_zero"] = filled("zero")
    o["customer_profile"] = sql(f"SELECT cliente_id, {rs(PROFILE_NAMES)} FROM profile", "gas", extra=PROFILE)
    o["supplier_profile"] = sql(f"""SELECT cliente_id, {r('avg(Volumen)', 'Volumen_mean')},
      {r('stddev_pop(Volumen)', 'Volumen_std')}, {r('quantile_cont(Volumen, 0.5)', 'Volumen_median')},
      {r('max(Presion) - min(Presion)', 'Presion_range')},
      {r('CASE WHEN avg(Temperatura) = 0 THEN 0 ELSE stddev_pop(Temperatura) / avg(Temperatura) END', 'Temperatura_cv')},
      {r('sum(Volumen)', 'Volumen_sum')} FROM lines GROUP BY cliente_id""", "lines")
    o["profile_filled"] = sql(f"SELECT cliente_id, {rs(PROFILE_NAMES)} FROM filled_profile", "gas", extra=PROFILE_FILLED)
    standard = ", ".join(r(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", c) for c in SPECS)
    o["profile_standardised"] = sql(f"SELECT cliente_id, {standard} FROM filled_profile", "gas", extra=PROFILE_FILLED)
    o["weekend_volume_share"] = sql(f"""SELECT cliente_id, {r('''CASE WHEN sum(Volumen) > 0 THEN
      coalesce(sum(Volumen) FILTER (WHERE extract(isodow FROM Fecha) IN (6, 7)), 0) / sum(Volumen) ELSE 0 END''',
      'consumo_finde_ratio')} FROM keyed GROUP BY cliente_id""", "keyed")
    o["cap_iqr"] = sql(f"SELECT cliente_id, {ts()}, {rs(ALL)} FROM capped", "capped")
    robust = ", ".join(
        f"CASE WHEN mad_{c} <> 0 THEN med_{c} - 3.5::DOUBLE * mad_{c} / 0.6745::DOUBLE END AS lo_{c}, "
        f"CASE WHEN mad_{c} <> 0 THEN med_{c} + 3.5::DOUBLE * mad_{c} / 0.6745::DOUBLE END AS hi_{c}" for c in ALL)
    o["cap_robust"] = sql(f"""SELECT cliente_id, {ts()}, {rs(ALL)} FROM (SELECT f.cliente_id, Fecha,
      {', '.join(clip(c) for c in ALL)} FROM filled f JOIN rlimits l USING (cliente_id)) z""", "filled", extra={
        "med": "SELECT cliente_id, " + ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c in ALL)
        + " FROM filled GROUP BY cliente_id",
        "mad": "SELECT cliente_id, " + ", ".join(
            f"quantile_cont(abs({c} - med_{c}), 0.5) AS mad_{c}" for c in ALL)
        + " FROM filled JOIN med USING (cliente_id) GROUP BY cliente_id",
        "rlimits": f"SELECT cliente_id, {robust} FROM med JOIN mad USING (cliente_id)"})
    o["cap_unknown_method"] = o["fill_linear"]
    o["outlier_counts"] = sql(" UNION ALL ".join(
        f"""SELECT cliente_id, '{c}' AS variable, count(*) FILTER (WHERE {c} < lo_{c} OR {c} > hi_{c}) AS atipicos
        FROM gas JOIN glimits USING (cliente_id) GROUP BY cliente_id""" for c in ALL), "gas", extra={
        "glimits": f"SELECT cliente_id, {iqr_limits(ALL)} FROM gas GROUP BY cliente_id"})
    o["supplier_price_caps"] = sql(f"""SELECT cliente_id, count(*) AS filas, {r('min(Volumen)', 'minimo')},
      {r('max(Volumen)', 'maximo')}, {r('avg(Volumen)', 'media')} FROM (SELECT x.cliente_id, {clip('Volumen')}
      FROM lines x JOIN plimits l USING (cliente_id)) z GROUP BY cliente_id""", "lines", extra={
        "plimits": f"SELECT cliente_id, {iqr_limits(['Volumen'], 0.5)} FROM lines GROUP BY cliente_id"})
    o["order_calendar"] = f"SELECT o_orderkey, {calendar_sql('o_orderdate')} FROM orders"
    o["cyclic_encoding"] = sql(f"SELECT cliente_id, {ts()}, {rs(CYCLES)} FROM (SELECT cliente_id, Fecha, {CYCLE_SQL} "
                               f"FROM (SELECT *, {calendar_sql()} FROM keyed) a) b", "keyed")
    zs = {c: f"(coalesce({c}, 0) - m_{c}) / s_{c}" for c in BASE}
    clustered = {"rows": """SELECT k.cliente_id, Fecha, Presion, Temperatura, Volumen, coalesce(cluster_id, -1)
      AS cluster_id FROM keyed k LEFT JOIN assigned USING (cliente_id)"""}
    fitted = "SELECT cluster_id, " + ", ".join(
        f"avg(coalesce({c}, 0)) AS m_{c}, stddev_pop(coalesce({c}, 0)) AS s_{c}" for c in BASE) + " FROM rows"
    o["scale_standard_by_cluster"] = sql(
        f"SELECT cliente_id, {ts()}, cluster_id, {', '.join(r(zs[c], c + '_scaled') for c in BASE)} "
        "FROM rows JOIN fitted USING (cluster_id)", "keyed", "assigned",
        extra={**clustered, "fitted": fitted + " GROUP BY cluster_id"})
    o["apply_stored_scaler"] = sql(
        f"SELECT cliente_id, {ts()}, cluster_id, "
        + ", ".join(r(f"CASE WHEN m_{c} IS NULL THEN {c} ELSE {zs[c]} END", c + "_scaled") for c in BASE)
        + " FROM rows LEFT JOIN fitted USING (cluster_id)", "keyed", "assigned",
        extra={**clustered, "fitted": fitted + " WHERE cluster_id >= 0 GROUP BY cluster_id"})
    o["scaler_parameters"] = sql(" UNION ALL ".join(
        f"SELECT cluster_id, '{c}' AS variable, {r(f'm_{c}', 'centro')}, {r(f's_{c}', 'escala')} FROM fitted" for c in BASE),
        "keyed", "assigned", extra={**clustered, "fitted": fitted + " GROUP BY cluster_id"})
    minmax = ", ".join(r(
        f"""(coalesce({c}, 0) - min(coalesce({c}, 0)) OVER p) / CASE WHEN max(coalesce({c}, 0)) OVER p
        = min(coalesce({c}, 0)) OVER p THEN 1 ELSE max(coalesce({c}, 0)) OVER p - min(coalesce({c}, 0)) OVER p END""",
        c + "_scaled") for c in BASE)
    o["scale_minmax_by_customer"] = sql(
        f"SELECT cliente_id, {ts()}, {minmax} FROM keyed WINDOW p AS (PARTITION BY cliente_id)", "keyed")
    o["scale_whole_table"] = sql(f"""SELECT {r('p', 'Presion_scaled')}, {r('t', 'Temperatura_scaled')}, count(*) AS filas,
      {r('avg(v)', 'media_volumen')} FROM (SELECT (Presion - mp) / sp AS p, (Temperatura - mt) / st AS t,
      (Volumen - mv) / sv AS v FROM lines, (SELECT avg(Presion) AS mp, stddev_pop(Presion) AS sp, avg(Temperatura) AS mt,
      stddev_pop(Temperatura) AS st, avg(Volumen) AS mv, stddev_pop(Volumen) AS sv FROM lines) f) z GROUP BY p, t""", "lines")
    o["chronological_split"] = sql(
        f"SELECT cliente_id, {ts()}, pos AS posicion, n AS filas, particion FROM cut", "keyed",
        extra={"cut": split_of("keyed")})

    # joins
    o["join_assignments"] = sql(f"""SELECT cliente_id, {ts()}, coalesce(cluster_id, -1) AS cluster_id, {rs(['Volumen'])}
      FROM keyed LEFT JOIN assigned USING (cliente_id)""", "keyed", "assigned")
    labels = """coalesce(anomalia_real, false) AS anomalia_real, coalesce(criticidad_real, 'Normal') AS criticidad_real"""
    o["join_labels"] = sql(f"""SELECT k.cliente_id, {ts('k.Fecha', 'Fecha')}, {rs(['Volumen'], 'k.')}, 'p' AS origen_pred,
      CASE WHEN t.cliente_id IS NOT NULL THEN 'r' END AS origen_real, {labels}
      FROM keyed k LEFT JOIN truth t ON t.cliente_id = k.cliente_id AND t.Fecha = k.Fecha""", "keyed", "truth")
    o["join_labels_deduplicated"] = sql(f"""SELECT k.cliente_id, {ts('k.Fecha', 'Fecha')}, {rs(['Volumen'], 'k.')}, {labels}
      FROM keyed k LEFT JOIN (SELECT cliente_id, Fecha, bool_or(anomalia_real) AS anomalia_real,
        min(criticidad_real) AS criticidad_real FROM truth GROUP BY cliente_id, Fecha) t USING (cliente_id, Fecha)""",
      "keyed", "truth")
    o["unmatched_labels"] = sql("""SELECT count(*) AS etiquetas_sin_lectura FROM truth t WHERE NOT EXISTS (
      SELECT 1 FROM keyed k WHERE k.cliente_id = t.cliente_id AND k.Fecha = t.Fecha)""", "keyed", "truth")
    o["anomaly_clusters"] = sql(f"""SELECT cliente_id, {ts()}, coalesce(cluster_id, -1) AS cluster_id
      FROM found LEFT JOIN assigned USING (cliente_id)""", "found", "assigned")
    o["anomaly_clusters_without_map"] = sql(f"SELECT cliente_id, {ts()}, 0 AS cluster_id FROM found", "found")

    # aggregates
    six = ["cliente_id", "Fecha", *ALL]
    o["table_completeness"] = sql(f"""SELECT count(*) AS filas, CAST(6 AS BIGINT) AS columnas,
      {r('100.0::DOUBLE * (' + ' + '.join(f'count({c})' for c in six) + ') / (count(*) * 6)', 'completitud')} FROM gas""", "gas")
    o["missing_by_column"] = sql(" UNION ALL ".join(
        f"""SELECT '{c}' AS columna, count(*) - count({c}) AS nulos,
        {r(f'100.0::DOUBLE * (count(*) - count({c})) / count(*)', 'porcentaje')} FROM gas""" for c in six), "gas")
    o["describe_order_lines"] = moments(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "lineitem")
    o["describe_readings"] = sql(moments(ALL, "gas"), "gas")
    o["order_priority_counts"] = "SELECT o_orderpriority, count(*) AS cantidad FROM orders GROUP BY o_orderpriority"
    o["cluster_sizes"] = sql("SELECT cluster_id, count(*) AS cantidad FROM assigned GROUP BY cluster_id", "assigned")
    o["distinct_counts"] = sql("""SELECT count(DISTINCT cliente_id) AS n_cliente_id,
      count(DISTINCT cluster_id) AS n_cluster_id FROM view""", "view")
    o["named_statistics"] = sql(statistics("Volumen", "view").replace(
        "FROM view", f", CAST(NULL AS DOUBLE) AS desconocida, {r('max(Volumen) - min(Volumen)', 'amplitud')} FROM view"), "view")
    o["correlation_matrix"] = sql(correlations(ALL, "gas"), "gas")
    o["correlation_order_lines"] = sql(correlations(BASE, "lines"), "lines")
    o["hourly_pattern"] = sql(pattern("clean", "hora_dia", "Volumen"), "clean")
    o["weekday_pattern"] = sql(pattern("view", "dia_semana", "Presion"), "view")
    o["monthly_price_pattern"] = pattern(
        "(SELECT CAST(extract(month FROM o_orderdate) AS INTEGER) AS mes, o_totalprice AS Volumen FROM orders)",
        "mes", "Volumen")
    o["normal_band"] = sql(band("view"), "view")
    o["frequent_severity"] = sql(frequent("found"), "found")
    o["dashboard_totals"] = sql(totals("found_view WHERE cluster_id = 1"), "view", "found_view")
    o["severity_options"] = sql("SELECT 'Todas' AS valor UNION ALL SELECT DISTINCT criticidad_predicha FROM found", "found")
    o["client_options"] = sql("SELECT DISTINCT cliente_id AS valor FROM view", "view")
    o["time_bounds"] = sql(f"SELECT {ts('min(datetime)', 'minimo')}, {ts('max(datetime)', 'maximo')} FROM view", "view")

    o["knees_of_curves"] = KNEES

    # sorts, unions, shapes
    o["sorted_readings"] = sql(f"SELECT cliente_id, {ts()}, {rs(BASE)} FROM keyed ORDER BY cliente_id, Fecha", "keyed")
    o["union_of_sources"] = sql(f"SELECT cliente_id, {ts()}, {rs(['Volumen'])} FROM keyed", "keyed")
    o["readings_long"] = sql(long_rows("view", ALL), "view")
    o["busiest_hour_per_customer"] = sql(f"""SELECT cliente_id, {ts()}, {rs(['Volumen'])} FROM (SELECT *, row_number() OVER (
      PARTITION BY cliente_id ORDER BY Volumen DESC NULLS LAST, Fecha DESC) AS rn FROM keyed) z
      WHERE rn = 1 AND Volumen IS NOT NULL""", "keyed")

    # sources and sinks
    by_source = "SELECT *, 'F' || CAST(seq % 6 AS VARCHAR) AS fuente FROM raw"
    o["csv_sources"] = o["parquet_sources"] = sql(
        f"SELECT fuente AS cliente_id, fecha_txt AS Fecha_original_etl, {rs(BASE)} FROM sources", "raw", extra={"sources": by_source})
    o["rejected_rows"] = sql("""SELECT fuente AS cliente_id, CASE WHEN seq % 10 IN (3, 4) THEN 'not 5 cells' ELSE 'leida' END AS motivo,
        count(*) AS lineas FROM sources WHERE fuente NOT IN ('F4', 'F5') GROUP BY ALL
      UNION ALL SELECT DISTINCT fuente, CASE fuente WHEN 'F4' THEN 'the header has a line break within quotes' ELSE 'lacks Volumen' END,
        CAST(0 AS BIGINT) FROM sources WHERE fuente IN ('F4', 'F5')""", "raw", extra={"sources": by_source})
    o["labels_round_trip"] = sql(f"SELECT cliente_id, {ts()}, anomalia_real, criticidad_real FROM truth", "truth")
    o["cluster_round_trip"] = sql(f"""SELECT cliente_id, {ts()}, cluster_id, {rs(['Volumen'])} FROM keyed JOIN assigned USING (cliente_id)
      WHERE Volumen IS NOT NULL""", "keyed", "assigned")
    o["report_round_trip"] = o["anomaly_report"]
    reported = {"carga": ("raw", BASE), "fechas": ("keyed", BASE), "cantidad_gas": ("gas", ALL), "faltantes": ("filled", ALL),
                "atipicos": ("capped", ALL), "calendario": ("clean", ALL)}
    widths = {"carga": ["cliente_id", "seq", "fecha_txt", *BASE], "fechas": ["cliente_id", "Fecha", *BASE],
              "calendario": ["cliente_id", "Fecha", *ALL, *PARTS, *CYCLES]}
    parts = []
    for stage, (source, columns) in reported.items():
        cells = widths.get(stage, ["cliente_id", "Fecha", *ALL])
        whole = f"100.0::DOUBLE * ({' + '.join(f'count({c})' for c in cells)}) / (count(*) * {len(cells)})"
        for c in ["cliente_id", *columns]:
            number = c != "cliente_id"
            facts = [f"{f}({c})" if number else "CAST(NULL AS DOUBLE)" for f in ("avg", "stddev_samp", "min", "max")]
            parts.append(f"""SELECT '{stage}' AS etapa, '{c}' AS columna, count(*) AS filas, count(*) - count({c}) AS nulos,
              {r(f'100.0::DOUBLE * (count(*) - count({c})) / count(*)', 'porcentaje')}, {r(whole, 'completitud')},
              {', '.join(r(f, n) for f, n in zip(facts, ('media', 'desviacion', 'minimo', 'maximo')))} FROM {source}""")
    o["stage_reports"] = sql(" UNION ALL ".join(parts), "raw", "keyed", "gas", "filled", "capped", "clean")

    # windows, reconstruction, severity
    three = frame_sql("placed_all", ["Presion", "Volumen", "hora_sin"], "cliente_id", "pos")
    o["sliding_windows"] = sql(f"""SELECT cliente_id, {ts()}, particion,
      CASE WHEN pos >= 24 AND particion = first_part THEN particion END AS particion_ventana,
      CAST(coalesce(n, 0) AS INTEGER) AS largo, {r('suma')}, {r('primero')}, {r('ultimo_volumen')} FROM (
        SELECT p.cliente_id, p.Fecha, p.particion, p.pos, first_value(p.particion) OVER (PARTITION BY p.cliente_id
          ORDER BY p.pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS first_part, w.* EXCLUDE (cliente_id, fin)
        FROM placed_all p LEFT JOIN (SELECT cliente_id, fin, count(*) AS n, sum(v) AS suma,
          max(v) FILTER (WHERE paso = 0 AND f = 0) AS primero, max(v) FILTER (WHERE paso = 23 AND f = 1) AS ultimo_volumen
          FROM frames GROUP BY cliente_id, fin) w ON w.cliente_id = p.cliente_id AND w.fin = p.pos) z""", "placed_all", extra=three)
    pair = across(["Presion", "Volumen"])
    o["windows_across_customers"] = sql(f"""SELECT cliente_id, {ts()}, cluster_id, {r('suma')}, {r('primero')} FROM (
        SELECT o.cliente_id, o.Fecha, o.cluster_id, w.suma, w.primero FROM ordered o LEFT JOIN (
          SELECT cluster_id, fin, sum(v) AS suma, max(v) FILTER (WHERE paso = 0 AND f = 0) AS primero
          FROM frames GROUP BY cluster_id, fin) w ON w.cluster_id = o.cluster_id AND w.fin = o.cpos) z""",
        "scaled", extra={k: pair[k] for k in ("ordered", "cells", "frames")})
    o["training_windows_across_customers"] = sql(f"""SELECT cluster_id, particion AS particion_ventana, count(*) AS ventanas,
      {r('avg(suma)', 'suma_media')}, {r('max(suma)', 'suma_maxima')} FROM (SELECT cluster_id, particion, fin,
      sum(v) AS suma FROM tframes GROUP BY cluster_id, particion, fin) z GROUP BY cluster_id, particion""",
      "scaled", extra={k: pair[k] for k in ("parts", "tcells", "tframes")})
    upto_errors = {k: WHOLE[k] for k in ("marked", "cells", "frames", "means", "errors")}
    o["reconstruction_errors"] = sql(f"""SELECT s.cliente_id, {ts('s.Fecha', 'Fecha')}, s.cluster_id, {r('e.error', 'error')}
      FROM marked s LEFT JOIN errors e ON e.cliente_id = s.cliente_id AND e.fin = s.pos""", "scaled", extra=upto_errors)
    upto_means = {k: WHOLE[k] for k in ("marked", "cells", "frames", "means")}
    o["component_variance"] = sql(f"""SELECT cluster_id, particion_ventana, ventanas, {r('v', 'total')}, {r('v', 'suma')} FROM (
      SELECT cluster_id, particion_ventana, CAST(count(*) / 240 AS BIGINT) AS ventanas, avg((v - m) * (v - m)) AS v
      FROM frames JOIN means USING (cluster_id, paso, f) WHERE particion_ventana IN ('train', 'val')
      GROUP BY cluster_id, particion_ventana) z""", "scaled", extra=upto_means)
    o["grid_ends"] = sql("""SELECT CAST(cluster_id AS INTEGER) AS cluster_id, CAST(orden AS INTEGER) AS orden,
      CAST(orden AS INTEGER) AS igual_a, CAST(240 + 5 * orden AS INTEGER) AS rango, CAST(0.0 AS DOUBLE) AS perdida, orden = 0 AS elegido
      FROM (SELECT DISTINCT cluster_id FROM means) c, range(0, 2) t(orden)""", "scaled", extra=upto_means)
    o["cluster_thresholds"] = sql(f"SELECT cluster_id, {rs(['umbral', 'media', 'desviacion'])} FROM thresholds",
                                  "scaled", extra={k: v for k, v in WHOLE.items() if k != "scored"})
    o["scored_readings"] = sql(f"""SELECT cliente_id, {ts()}, cluster_id, anomalia_predicha, {r('score_anomalia_final')},
      modelo_deteccion, criticidad_predicha FROM scored""", "scaled", extra=WHOLE)
    o["model_round_trip"] = o["scored_readings"]
    o["scored_readings_across_customers"] = sql(f"""SELECT cliente_id, {ts()}, cluster_id, anomalia_predicha,
      {r('score_anomalia_final')}, criticidad_predicha FROM scored""", "scaled", extra=ACROSS)
    two = frame_sql("placed_all", ["hora_sin", "hora_cos"], "cliente_id", "pos")
    o["external_reconstructor"] = sql(f"""SELECT p.cliente_id, {ts('p.Fecha', 'Fecha')}, round(e.error, 4) AS error
      FROM placed_all p LEFT JOIN (SELECT cliente_id, fin, avg(abs(v - m)) AS error FROM frames
        JOIN (SELECT cliente_id, fin, f, avg(v) AS m FROM frames GROUP BY cliente_id, fin, f) g USING (cliente_id, fin, f)
        GROUP BY cliente_id, fin) e ON e.cliente_id = p.cliente_id AND e.fin = p.pos""", "placed_all", extra=two)
    stats = """coalesce(avg({x}), 0) AS m, coalesce(CASE WHEN stddev_pop({x}) < 1e-6 THEN 1 ELSE stddev_pop({x}) END, 1) AS s"""
    o["score_statistics_by_severity"] = sql(f"""SELECT criticidad_predicha, {r('m', 'media')}, {r('s', 'desviacion')} FROM (
      SELECT criticidad_predicha, {stats.format(x='score_anomalia_final')} FROM found GROUP BY criticidad_predicha) z""", "found")
    o["score_statistics_overall"] = f"""SELECT {r('m', 'media')}, {r('s', 'desviacion')} FROM (
      SELECT {stats.format(x='value')} FROM events) z"""
    value = "CASE WHEN event_id % 97 <> 0 THEN value END"
    o["severity_levels"] = f"""SELECT event_id, {severity_sql(value, '20.0::DOUBLE', '10.0::DOUBLE')} AS nivel,
      {severity_sql(value, '20.0::DOUBLE', '0.0::DOUBLE')} AS nivel_sin_desviacion,
      {severity_sql(value, '20.0::DOUBLE', '10.0::DOUBLE', 2.75, 1.75, 2.75, 1.0, 1.75)} AS nivel_otras_bandas FROM events"""
    mean = "CASE WHEN event_type <> 'error' THEN 20.0::DOUBLE END"
    o["row_labels"] = f"""SELECT event_id, value > 40 AS marcado, CASE WHEN NOT value > 40 THEN 'Normal'
      ELSE {severity_sql('value', mean, '10.0::DOUBLE')} END AS criticidad FROM events"""

    # segmentation
    o["label_silhouette"] = SILHOUETTE
    o["label_davies_bouldin"] = DAVIES_BOULDIN
    o["label_within_squares"] = sql(
        f"SELECT {r('sum((x - c) * (x - c))', 'wcss')} FROM cells JOIN centres USING (label, d)", extra=VECTORS)
    o["elbow_of_curve"] = f"""SELECT k, rest, {r('depth', 'profundidad')},
      depth > 0 AND row_number() OVER (ORDER BY depth DESC, k) = 1 AS es_codo FROM (
        SELECT k, rest, 1 - (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ())::DOUBLE
          - (rest - min(rest) OVER ()) / (max(rest) OVER () - min(rest) OVER ()) AS depth FROM (
          SELECT label + 1 AS k, CAST(coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN 1 FOLLOWING
            AND UNBOUNDED FOLLOWING), 0) AS DOUBLE) AS rest
          FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) a) b) c"""
    o["one_cluster_fallback"] = sql("SELECT DISTINCT cliente_id, 0 AS cluster_id FROM keyed", "keyed")

    # evaluation
    o["confusion_counts"] = sql(f"""SELECT {', '.join(COUNT_COLUMNS)}, {r('precision_clasificacion_criticidad')}
      FROM counts""", "judged", "truth", extra=evaluated("judged"))
    o["system_metrics"] = sql(METRIC_SELECT, "judged", "truth", extra=evaluated("judged"))
    # No reading has a label of ten years later.
    later = {"later": "SELECT cliente_id, Fecha + INTERVAL 10 YEAR AS Fecha, anomalia_real, criticidad_real FROM truth"}
    o["system_metrics_without_matches"] = sql(METRIC_SELECT, "judged", "truth", extra={
        **later, **{k: v.replace("truth", "later") for k, v in evaluated("judged").items()}})
    undated = f"""SELECT coalesce(cliente_id, 'nadie') AS cliente, fecha_txt, {{columns}}
      FROM (SELECT CASE WHEN seq % 23 = 0 THEN NULL ELSE cliente_id END AS cliente_id, seq, fecha_txt, Presion, Volumen FROM raw) u
      LEFT JOIN (SELECT cliente_id, {{values}} FROM raw WHERE seq % 23 <> 0 GROUP BY cliente_id) s USING (cliente_id)"""
    caps = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in ("Presion", "Volumen"))
    capped = ", ".join(r(f"""CASE WHEN q3_{c} - q1_{c} <> 0 AND {c} IS NOT NULL THEN least(greatest({c}, q1_{c} - 1.5 * (q3_{c} - q1_{c})),
      q3_{c} + 1.5 * (q3_{c} - q1_{c})) ELSE {c} END""", c) for c in ("Presion", "Volumen"))
    o["cap_keeps_undated_rows"] = sql(undated.format(columns=capped, values=caps), "raw")
    o["mean_keeps_undated_rows"] = sql(undated.format(
        columns=", ".join(r(f"CASE WHEN cliente_id IS NULL THEN {c} ELSE coalesce({c}, m_{c}, 0) END", c) for c in ("Presion", "Volumen")),
        values=", ".join(f"avg({c}) AS m_{c}" for c in ("Presion", "Volumen"))), "raw")
    holes = """(SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value,
      CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS usuario FROM events) e"""
    o["describe_with_nan"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count({c}) AS count, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'std')}, {r(f'min({c})', 'min')},
        {r(f'max({c})', 'max')}, {r(f'quantile_cont({c}, 0.25)', 'p25')}, {r(f'quantile_cont({c}, 0.5)', 'p50')},
        {r(f'quantile_cont({c}, 0.75)', 'p75')} FROM {holes}""" for c in ("value", "usuario"))
    o["missing_with_nan"] = " UNION ALL ".join(
        f"""SELECT '{c}' AS columna, count(*) - count({c}) AS nulos, {r(f'100.0 * (count(*) - count({c})) / count(*)', 'porcentaje')}
        FROM {holes}""" for c in ("event_id", "value", "usuario"))
    narrowed = ", ".join(r(f"quantile_cont({c}::DOUBLE, {p})", f"{n}_{c}") for c in ("l_discount", "l_quantity", "l_extendedprice")
                         for n, p in (("p25", 0.25), ("p50", 0.5), ("p99", 0.99)))
    o["quantiles_narrowed_whole"] = f"SELECT {narrowed} FROM lineitem"
    o["quantiles_narrowed_by_supplier"] = f"SELECT l_suppkey, {narrowed} FROM lineitem GROUP BY l_suppkey"
    checks = [("tasa_falsos_positivos", "0.15", "<="), ("recall_anomalia_sensibilidad", "0.8", ">="),
              ("precision_clasificacion_criticidad", "0.9", ">=")]
    o["acceptance_checks"] = sql(" UNION ALL ".join(
        f"""SELECT '{m}' AS metrica, {r(m, 'actual')}, {limit}::DOUBLE AS requerido, {m} {op} {limit}::DOUBLE AS cumple
        FROM metrics WHERE {m} IS NOT NULL""" for m, limit, op in checks), "judged", "truth", extra=evaluated("judged"))
    requirements = [
        ("N2", "Minimizar pérdidas no técnicas (detección)", "recall_anomalia_sensibilidad", "0.8", ">="),
        ("N3", "Precisión en clasificación de criticidad", "precision_clasificacion_criticidad", "0.9", ">="),
        ("D1", "Baja tasa de falsos positivos", "tasa_falsos_positivos", "0.15", "<="),
        ("D2", "Detectar anomalías en variables (General)", "recall_anomalia_sensibilidad", "0.8", ">="),
        ("D3", "Latencia de procesamiento de alertas", "573.3::DOUBLE / 60", "10", "<=")]
    o["compliance_report"] = sql(" UNION ALL ".join(
        f"""SELECT '{code}' AS id, '{text}' AS requerimiento, {r(value, 'actual')}, {limit}::DOUBLE AS criterio,
        CASE WHEN {value} {op} {limit}::DOUBLE THEN 'Sí' WHEN {value} IS NULL THEN 'N/A' ELSE 'No' END AS cumple
        FROM metrics""" for code, text, value, limit, op in requirements), "judged", "truth", extra=evaluated("judged"))

    # compositions
    o["clean_hourly_readings"] = sql(
        f"SELECT cliente_id, {ts()}, {rs(ALL)}, {', '.join(PARTS)}, {rs(CYCLES)} FROM clean", "clean")
    o["scored_metrics"] = sql(METRIC_SELECT, "scaled", "truth", extra={**WHOLE, **evaluated("scored")})
    o["dashboard_series"] = on_selection(long_rows("selected", ["Volumen"]))
    o["dashboard_band"] = on_selection(band("selected"))
    o["dashboard_statistics"] = on_selection(statistics("Volumen", "selected"))
    o["dashboard_correlation"] = on_selection(correlations(ALL, "selected"))
    o["dashboard_pattern"] = on_selection(pattern("selected", "hora_dia", "Volumen"))
    wide = {"inside": """SELECT * FROM view WHERE datetime >= TIMESTAMP '2023-12-10' AND datetime <= TIMESTAMP '2024-02-20 23:59:59'
      AND cluster_id = 1""", "selected": "SELECT * FROM inside WHERE cliente_id = (SELECT min(cliente_id) FROM inside)"}
    o["cube_pattern"] = sql(pattern("selected", "dia_semana", "Volumen"), "view", extra=wide)
    o["cube_correlation"] = sql(correlations(ALL, "selected"), "view", extra=wide)
    o["dashboard_overlay"] = on_selection(f"""SELECT {ts('datetime')}, {r('Volumen', 'valor')}, criticidad_predicha,
      {r('score_anomalia_final')}, modelo_deteccion FROM alerts WHERE Volumen IS NOT NULL""")
    o["dashboard_kpis"] = on_selection(totals("alerts"))
    o["dashboard_detail"] = on_selection(detail("alerts"))
    o["dashboard_clients"] = on_selection("SELECT DISTINCT cliente_id AS valor FROM inside")
    o["dashboard_frequent_severity"] = on_selection(frequent("alerts"))
    return o
