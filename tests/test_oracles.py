"""Every registered query against its DuckDB twin on sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as entry_mod
from helpers import SF01
from oracle_compare import compare, duck
from ticketscope.plans.catalog import QUERIES as TICKET_QUERIES

QUERIES = entry_mod.queries()
SQL = entry_mod.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_ticket_query_has_a_twin():
    assert set(TICKET_QUERIES) <= set(SQL) <= set(QUERIES)


def test_twins_import_nothing_of_the_engine():
    import oracle_queries
    assert "ticketscope" not in open(oracle_queries.__file__).read().split('"""', 2)[2]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF01), con, SQL[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["med_hrs", "pct_within", "tickets"]
    rows = df.collect()
    assert len(rows) == 1 and rows[0].tickets > 0
