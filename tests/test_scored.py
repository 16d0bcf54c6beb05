"""Readings scored across customers: by the components of the training windows, on rows of the test's own."""

import numpy as np
import pandas as pd
import pytest

from checks.compare import connect, difference
from checks.oracles import oracles
from checks.queries import REGISTRY, placed
from meterlens.params import BASE_COLUMNS, GAS, WINDOW_FEATURES

NAME, STEPS, RANK = "scored_readings_across_customers", 24, 16


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Twelve customers of sixty hours; only clusters 1 and 2 have a validation window."""
    n = np.arange(720)
    path = tmp_path_factory.mktemp("eventos")
    pd.DataFrame({
        "event_id": n, "ts": (pd.Timestamp("2024-01-30") + pd.to_timedelta(n // 12 * 7, unit="h")).astype("datetime64[us]"),
        "user_id": n % 12, "event_type": "view", "props": "{}",
        "value": 30 + 20 * np.sin(n / 31) + np.random.default_rng(3).normal(0, 5, len(n))}).to_parquet(path / "events.parquet")
    return str(path)


def windows(part: pd.DataFrame) -> np.ndarray:
    values = part[list(WINDOW_FEATURES)].to_numpy()
    if len(values) < STEPS:
        return np.zeros((0, STEPS * values.shape[1]))
    return np.lib.stride_tricks.sliding_window_view(values, STEPS, axis=0).transpose(0, 2, 1).reshape(len(values) - STEPS + 1, -1)


def plainly(rows: pd.DataFrame) -> pd.DataFrame:
    """Score and flag of each row, from a singular value decomposition of each cluster's training windows."""
    out = []
    for _, part in rows.sort_values(["cliente_id", "Fecha"]).groupby("cluster_id"):
        part = part.copy()
        for c in (*BASE_COLUMNS, GAS):
            part[f"{c}_scaled"] = (part[c] - part[c].mean()) / (part[c].std(ddof=0) or 1.0)
        train, val = windows(part[part["particion"] == "train"]), windows(part[part["particion"] == "val"])
        mean = train.mean(axis=0)
        axes = np.linalg.svd(train - mean, full_matrices=False)[2][:RANK]

        def errors(of):
            return np.abs((of - mean) - (of - mean) @ axes.T @ axes).mean(axis=1)

        judge = errors(val if len(val) else train)
        score = np.concatenate([np.full(STEPS - 1, np.nan), errors(windows(part))])
        out.append(part.assign(score=score, flagged=score > judge.mean() + 2 * judge.std()))
    return pd.concat(out)


def test_scores_come_from_the_components(spark, folder):
    got = REGISTRY[NAME](spark, folder).toPandas()
    rows = placed(spark, folder).toPandas()
    want = plainly(rows)
    want["Fecha"] = want["Fecha"].dt.strftime("%Y-%m-%d %H:%M:%S")
    both = got.merge(want, on=["cliente_id", "Fecha"], suffixes=("", "_w"))
    assert len(both) == len(got) == len(rows) > 600
    assert both["score_anomalia_final"].notna().sum() == len(rows) - 3 * (STEPS - 1)
    np.testing.assert_allclose(both["score_anomalia_final"], both["score"], rtol=0, atol=2e-6)
    assert (both["anomalia_predicha"] == both["flagged"]).all() and both["flagged"].any()


def test_sql_gives_the_same_rows(spark, folder):
    got = REGISTRY[NAME](spark, folder).toPandas()
    assert difference(got, connect(folder).execute(oracles()[NAME]).df()) is None
