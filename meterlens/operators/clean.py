"""Row-level cleaning: names, dates, duplicates, missing values and the gas quantity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlens.functions.columns import finite, gas_quantity, valid_denominator
from meterlens.params import BASE_COLUMNS, KEY, TIME, GasLaw

# Older column names and the names they stand for.
READING_ALIASES = {"ID_cliente": "cliente_id", "Fecha": "datetime"}
ANOMALY_ALIASES = {"cliente": "cliente_id", "Fecha": "datetime", "severidad": "criticidad_predicha"}


def rename_aliases(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Rename a legacy column only when it is there and its target is not."""
    found = {old: new for old, new in aliases.items() if old in df.columns and new not in df.columns}
    return df.withColumnsRenamed(found)


def keep_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns in the wanted order, absent names skipped."""
    return df.select(*[c for c in wanted if c in df.columns])


def parse_dates(df: DataFrame, source: str, target: str = TIME) -> DataFrame:
    """Text to timestamp; rows whose date does not parse are dropped."""
    if isinstance(df.schema[source].dataType, T.StringType):
        parsed = F.try_to_timestamp(F.col(source))
    else:
        parsed = F.col(source).cast("timestamp")
    out = df.withColumn(target, parsed).where(F.col(target).isNotNull())
    return out if source == target else out.drop(source)


def keep_first(df: DataFrame, order: str | Sequence[str],
               keys: Sequence[str] = (KEY, TIME)) -> DataFrame:
    """One row per key: the first in ``order``, which must be unique within a key.

    A grouped ``min_by`` instead of a ranking window: copies of a key are reduced before the
    shuffle, so a key holding a third of all rows costs one row per input split. With a
    single numeric order column the buffers are plain numbers and the aggregate hashes.
    """
    rest = [c for c in df.columns if c not in keys]
    if isinstance(order, str):
        picked = [F.min_by(F.col(c), F.col(order)).alias(c) for c in rest]
        return df.groupBy(*keys).agg(*picked).select(*df.columns)
    row = F.struct(*[F.col(c) for c in rest])
    first = df.groupBy(*keys).agg(F.min_by(row, F.struct(*[F.col(c) for c in order])).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


def infinities_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c).cast("double")) for c in columns if c in df.columns})


def with_gas_quantity(df: DataFrame, law: GasLaw) -> DataFrame:
    """Add the gas quantity: unchanged when inactive, a NULL column when an input is absent."""
    if not law.active:
        return df
    if any(c not in df.columns for c in BASE_COLUMNS):
        return df.withColumn(law.output, F.lit(None).cast("double"))
    return df.withColumn(law.output, gas_quantity(law))


def gas_summary(df: DataFrame, law: GasLaw) -> DataFrame:
    """Range, mean and missing count of the gas quantity, and how many denominators were unusable."""
    gas = F.col(law.output)
    return df.agg(
        F.min(gas).alias("minimo"), F.max(gas).alias("maximo"), F.avg(gas).alias("media"),
        F.count_if(gas.isNull()).alias("nulos"),
        F.count_if(~valid_denominator(law)).alias("denominadores_invalidos"),
    )


def fill_constants(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Replace NULLs by one constant per column."""
    present = {c: v for c, v in values.items() if c in df.columns}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
                           for c, v in present.items()})


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(subset))


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast by column; a value that does not convert becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})
