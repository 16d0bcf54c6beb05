"""What holds for every registered query, and the dashboard's dates."""

import os
import re
import time

import pytest

from checks.queries import REGISTRY, anomalies_view, readings_view
from meterlens.params import Filters
from meterlens.plans.dashboard import explore
from meterlens.session import checkpoint_root, scratch, settle


@pytest.mark.parametrize("name", ["system_metrics_without_matches", "sliding_windows", "external_reconstructor",
                                  "cap_keeps_undated_rows", "quantiles_narrowed_whole", "describe_with_nan"])
def test_plans_read_tables(spark, small, name):
    plan = REGISTRY[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search("Relation .*parquet", plan)


def test_dashboard_dates_do_not_depend_on_the_drivers_zone(spark, small, monkeypatch):
    readings, found = readings_view(spark, small), anomalies_view(spark, small)
    rows = readings.where("datetime IS NOT NULL").count()
    monkeypatch.setenv("TZ", "America/Bogota")
    time.tzset()
    try:
        kept = explore(readings, found, Filters(variable="Volumen"))["serie"].count()
    finally:
        monkeypatch.undo()
        os.environ.setdefault("TZ", "UTC")
        time.tzset()
    assert kept == rows


def test_scratch_leaves_nothing_behind(spark, tmp_path):
    before = set(os.listdir(checkpoint_root(spark)))
    with scratch(spark) as folder:
        kept = settle(spark.range(10).withColumnRenamed("id", "n"))
        assert kept.count() == 10 and os.listdir(folder.removeprefix("file:"))
        kept.write.parquet(str(tmp_path / "kept"))
    assert set(os.listdir(checkpoint_root(spark))) == before
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 10
