"""Scalar expressions: all are built-in column functions, so they stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlens.params import TIME, EtlParams, GasLaw


def finite(value: Column) -> Column:
    """NaN and both infinities become NULL (Spark orders NaN as a value, the data model does not)."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(math.inf)), value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0.0 when the denominator is zero or missing."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def capped(value: Column, low: Column, high: Column) -> Column:
    """Clip to [low, high]; NULL values stay NULL and NULL bounds do not clip."""
    return F.when(value < low, low).when(value > high, high).otherwise(value)


def gas_denominator(law: GasLaw) -> Column:
    kelvin = F.col("Temperatura").cast("double") + F.lit(273.15)
    return F.lit(float(law.z_factor)) * F.lit(float(law.r_constant)) * kelvin


def valid_denominator(law: GasLaw) -> Column:
    """True where Z*R*T can divide: not NULL, NaN, infinite or zero."""
    usable = finite(gas_denominator(law))
    return F.coalesce(usable != 0, F.lit(False))


def gas_quantity(law: GasLaw) -> Column:
    """Moles of gas, NULL when an input is missing or the denominator is unusable."""
    work = F.col("Presion").cast("double") * F.lit(1000.0) * F.col("Volumen").cast("double")
    return finite(F.when(valid_denominator(law), F.try_divide(work, gas_denominator(law))))


def calendar_parts(time: str = TIME) -> dict[str, Column]:
    """Nine integer calendar parts; weekday counts from Monday = 0 and the week is the ISO week."""
    t = F.col(time)
    return {
        "hora_dia": F.hour(t),
        "dia_semana": F.weekday(t),
        "dia_mes": F.dayofmonth(t),
        "dia_anio": F.dayofyear(t),
        "semana_anio": F.weekofyear(t),
        "mes": F.month(t),
        "trimestre": F.quarter(t),
        "anio": F.year(t),
        "es_findesemana": F.weekday(t).isin(5, 6).cast("int"),
    }


def cyclic_pairs(params: EtlParams) -> dict[str, Column]:
    """Sine and cosine of each enabled cycle."""
    cycles = [
        ("hora", "hora_dia", 24.0, params.daily_cycle),
        ("dia_semana", "dia_semana", 7.0, params.weekly_cycle),
        ("mes", "mes", 12.0, params.monthly_cycle),
    ]
    pairs: dict[str, Column] = {}
    for prefix, part, period, enabled in cycles:
        if enabled:
            angle = F.lit(2 * math.pi) * F.col(part) / F.lit(period)
            pairs[f"{prefix}_sin"] = F.sin(angle)
            pairs[f"{prefix}_cos"] = F.cos(angle)
    return pairs


def title(text: Column) -> Column:
    """Display name: underscores to blanks, each word capitalised."""
    return F.initcap(F.translate(text, "_", " "))


def stamp(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")
