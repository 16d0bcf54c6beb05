"""Every query that SQL can express gives the same rows as its SQL."""

import re

import pytest

from checks.compare import connect, difference
from checks.oracles import oracles
from checks.queries import REGISTRY

SQL = oracles()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


def test_every_oracle_belongs_to_a_query():
    assert set(SQL) <= set(REGISTRY)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, duck, name):
    found = REGISTRY[name](spark, small)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and not re.search(r"Join Inner\s*$", plan, re.M)
    assert difference(found.toPandas(), duck.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(SQL)))
def test_rows_without_sql(spark, small, name):
    assert REGISTRY[name](spark, small).count() > 0
