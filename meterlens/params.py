"""Parameters of every stage, with the defaults of the batch job."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Column names, severity domain and defaults that results depend on.
KEY = "cliente_id"
TIME = "Fecha"
CLUSTER = "cluster_id"
BASE_COLUMNS = ("Presion", "Temperatura", "Volumen")
GAS = "cantidad_gas_calculada"
NORMAL = "Normal"
UNDETERMINED = "Indeterminada"
SEVERITY_ORDER = ("Alta", "Media", "Baja", "Muy Baja", "Indeterminada", "Normal")
MODEL_LABEL = "LSTM_AE_Cluster"
WINDOW_FEATURES = (
    "Presion_scaled", "Temperatura_scaled", "Volumen_scaled", "cantidad_gas_calculada_scaled",
    "hora_sin", "hora_cos", "dia_semana_sin", "dia_semana_cos", "mes_sin", "mes_cos",
)
PROFILE_SPECS = ("Volumen_mean", "Volumen_std", "Presion_median", "cantidad_gas_calculada_mean")
KEY_STATISTICS = ("mean", "std", "min", "max", "median", "quantile_25", "quantile_75")
REPORT_COLUMNS = (
    "timestamp_deteccion", "cliente_id", "cluster_id", "Fecha",
    "Presion", "Temperatura", "Volumen", "cantidad_gas_calculada",
    "modelo_deteccion", "score_anomalia_final", "criticidad_predicha",
)
DETAIL_COLUMNS = (
    "anomalia_id", "datetime", "cliente_id", "criticidad_predicha", "modelo_deteccion",
    "score_anomalia_final", "Presion", "Temperatura", "Volumen", "cantidad_gas_calculada",
)
METRIC_COLUMNS = (
    "total_muestras", "positivos_reales", "negativos_reales", "positivos_predichos",
    "verdaderos_positivos_tp", "falsos_positivos_fp", "verdaderos_negativos_tn",
    "falsos_negativos_fn", "precision_anomalia", "recall_anomalia_sensibilidad",
    "f1_score_anomalia", "tasa_falsos_positivos", "especificidad", "accuracy_general",
    "precision_clasificacion_criticidad",
)
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class GasLaw:
    """PV = ZnRT with pressure in kPa, volume in m3 and temperature in Celsius."""

    active: bool = True
    r_constant: float = 8.314
    z_factor: float = 1.0
    output: str = GAS


@dataclass(frozen=True)
class EtlParams:
    date_column: str = TIME
    base_columns: tuple[str, ...] = BASE_COLUMNS
    gas: GasLaw = field(default_factory=GasLaw)
    fill_method: str = "interpolacion_temporal"
    outlier_method: str = "iqr"
    iqr_factor: float = 1.5
    zscore_factor: float = 3.5
    daily_cycle: bool = True
    weekly_cycle: bool = True
    monthly_cycle: bool = True
    # Unit of date_trunc that splits one customer's series into the pieces a task sorts;
    # auto picks the longest one that keeps every piece small.
    chunk: str = "auto"

    def numeric_columns(self, present: list[str]) -> list[str]:
        """C0: base columns plus the gas quantity when it is active, those present only."""
        wanted = list(self.base_columns)
        if self.gas.active and self.gas.output not in wanted:
            wanted.append(self.gas.output)
        return [c for c in wanted if c in present]


@dataclass(frozen=True)
class SegmentParams:
    active: bool = True
    specs: tuple[str, ...] = PROFILE_SPECS
    method: str = "silhouette"
    # A list of candidates to try, not the ends of a range.
    k_candidates: tuple[int, ...] = (2, 6)
    fixed_k: int | None = None
    seed: int = 42
    knee: str = "middle"
    # "squared" trades the exact Euclidean silhouette, quadratic in customers, for the
    # squared-distance one, which is linear.
    silhouette: str = "euclidean"


@dataclass(frozen=True)
class ModelParams:
    features: tuple[str, ...] = WINDOW_FEATURES
    scaling: str = "standard_scaler"
    fit_on: str = "all"
    test_size: float = 0.2
    validation_size: float = 0.15
    seq_len: int = 24
    boundary: str = "entity"
    grid: dict[str, tuple] = field(default_factory=lambda: {
        "encoding_dim": (16,), "learning_rate": (0.001,), "epochs": (3,), "batch_size": (64,)})
    detection_sigma: float = 2.0
    label: str = MODEL_LABEL


@dataclass(frozen=True)
class Bands:
    """Severity bands in standard deviations; an upper end of None is the next band's lower end."""

    alta_min: float = 3.0
    media_min: float = 2.0
    media_max: float | None = 3.0
    baja_min: float = 1.5
    baja_max: float | None = 2.0


@dataclass(frozen=True)
class Acceptance:
    max_false_positive_rate: float = 0.15
    min_recall: float = 0.80
    min_severity_precision: float = 0.90
    min_variable_recall: dict[str, float] = field(default_factory=lambda: {
        "Presion": 0.80, "Temperatura": 0.80, "Volumen": 0.80, GAS: 0.80})
    max_latency_minutes: float = 10.0


@dataclass(frozen=True)
class Filters:
    """One dashboard selection. None means no restriction; severity 'Todas' means all."""

    start: str | None = None
    end: str | None = None
    cluster_id: int | None = None
    client: str | None = None
    variable: str | None = None
    severity: str = "Todas"
    pattern_by: str = "hora_dia"
