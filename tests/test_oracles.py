"""Every query with an oracle must equal it in columns, types and all values."""

import pytest

import __spark_entry__ as entry
from oracle_check import check, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, sf_dir, name):
    assert check(spark, con, name, QUERIES[name], ORACLES[name], sf_dir) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.columns == ["model", "fold", "score", "n_rows"] and out.count() > 0
