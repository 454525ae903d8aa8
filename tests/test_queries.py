"""Every registered query against its SQL on the smallest scale factor."""

from __future__ import annotations

import os

import pytest
from oracle import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        assert compare(df, con, sql) is None


def test_fallback_evidence_has_every_assignment_and_period(spark):
    """Also those without eligible tickets for some outcome, as many as the adjusted metrics have."""
    rows = queries()["pg4_cell_fallback_evidence_all"](spark, SF).collect()
    assert len(rows) == queries()["pg3_adjusted_agent_metrics"](spark, SF).count()
    empty = [r for r in rows if not r.csat_eligible_count]
    assert empty and {r.csat_fallback_level for r in empty} == {"no_supported_peer_cell"}


def test_entry(spark):
    df = entry(spark)
    assert len(df.columns) > 10 and df.limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
