"""Every query of the registry against its SQL; those without SQL give rows."""

from __future__ import annotations

import oracle
import pytest

from folioscope.plans import queries  # noqa: F401  fills the registry
from folioscope.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    assert oracle.differences(spark, sf_dir, QUERIES[name], ORACLE_SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
