"""Raw readings to clean hourly readings with calendar features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame

from meterlens.operators.calendar import with_calendar
from meterlens.operators.chunks import CHUNK, count_rows, measured_spans, split_into_chunks
from meterlens.operators.clean import infinities_to_null, keep_first, parse_dates, with_gas_quantity
from meterlens.operators.impute import fill_gaps
from meterlens.operators.outliers import cap_outliers
from meterlens.operators.quality import completeness, describe, missing_by_column
from meterlens.operators.quantiles import DIRECT_ROWS
from meterlens.operators.reports import observed
from meterlens.params import KEY, TIME, EtlParams
from meterlens.session import settle

#: Sees a stage's rows; what it returns, if anything, is what goes on.
Observer = Callable[[str, DataFrame], "DataFrame | None"]


def clean_readings(raw: DataFrame, params: EtlParams, order: str | Sequence[str], date: str,
                   observe: Observer | None = None, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Dates, duplicates, gas quantity, gaps, outliers, calendar: in that order.

    The gas quantity is derived before gaps are filled, then filled and capped like any other
    column. ``order`` is the load order that decides which duplicate stays. ``observe`` sees
    every stage: ``ObservedReports`` counts rows where they pass by, ``QualityReports`` keeps tables
    whose evaluation costs passes of their own.

    Readings cross the network by (customer, time) to drop duplicates, after a map-side reduction,
    and by (customer, chunk) to fill gaps. The filled rows are written once; the limits (a shuffle
    of values by customer) and the capped result both read them, so no window runs twice.
    """
    tell = partial(observed, observe)

    def dates(rows: DataFrame) -> DataFrame:
        return infinities_to_null(parse_dates(rows, date, TIME), params.base_columns)

    # Which chunks each customer has and an upper bound of their rows (duplicates included): where the unit is to
    # be found from them, they are counted now, else in the written rows below.
    unit, spans = params.chunk, None
    if unit == "auto":
        unit, spans = measured_spans(dates(raw).select(KEY, TIME), unit)
    dated = dates(tell("carga", raw))
    needed = [KEY, TIME, *[c for c in params.base_columns if c in dated.columns]]
    order_columns = [order] if isinstance(order, str) else list(order)
    unique = keep_first(dated.select(*needed, *order_columns), order).select(*needed)
    unique = tell("fechas", unique)

    with_gas = tell("cantidad_gas", with_gas_quantity(unique, params.gas))

    columns = params.numeric_columns(with_gas.columns)
    chunked = split_into_chunks(with_gas, unit)
    filled = settle(tell("faltantes", fill_gaps(chunked, columns, params.fill_method, unit)))
    if spans is None:
        spans = settle(count_rows(filled))

    limited = cap_outliers(filled, columns, params, direct_rows=direct_rows, spans=spans)
    limited = tell("atipicos", limited.drop(CHUNK))
    return tell("calendario", with_calendar(limited, params))


class QualityReports:
    """An observer that keeps the three quality tables of every stage, unevaluated."""

    def __init__(self) -> None:
        self.stages: dict[str, dict[str, DataFrame]] = {}

    def __call__(self, stage: str, df: DataFrame) -> None:
        self.stages[stage] = {
            "completitud": completeness(df), "faltantes": missing_by_column(df), "resumen": describe(df)}
