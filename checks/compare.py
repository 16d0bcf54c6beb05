"""Run queries against their SQL and list the differences.

Usage: python -m checks.compare FOLDER [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

from meterlens.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(value):
        if value is None or (not isinstance(value, (list, str)) and pd.isna(value)):
            return None
        if isinstance(value, float) or hasattr(value, "dtype") and value.dtype.kind == "f":
            return round(float(value), 6) + 0.0
        return value.item() if hasattr(value, "item") else value

    frame = frame[sorted(frame.columns)]
    rows = [tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: {"i": "int", "f": "float", "b": "bool"}.get(frame[c].dtype.kind, "object") for c in frame.columns}


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    odd = [(x, y) for x, y in zip(a, b) if x != y]
    if odd:
        return f"{len(odd)} of {len(a)} rows differ, first {odd[0]}"
    left, right = kinds(got), kinds(want)
    types = {c: (left[c], right[c]) for c in left if left[c] != right[c] and "object" not in (left[c], right[c])}
    return f"types {types}" if types else None


def main() -> int:
    from checks.oracles import oracles
    from checks.queries import REGISTRY

    folder, chosen = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="8g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), oracles(), 0
    for name in chosen or REGISTRY:
        start = time.monotonic()
        try:
            got = REGISTRY[name](spark, folder).toPandas()
            took = time.monotonic() - start
            problem = difference(got, con.execute(sqls[name]).df()) if name in sqls else None
            if problem is None and len(got) == 0:
                problem = "no rows"
        except Exception as error:
            took, problem = time.monotonic() - start, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name:40s} {took:6.2f}s {'' if name in sqls else '(rows only)'} {problem or ''}", flush=True)
    print(f"{bad} bad; without a query: {sorted(set(sqls) - set(REGISTRY))}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
