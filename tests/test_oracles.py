from __future__ import annotations

import pytest

from tests.compare import rows
from tessera.plans import log_queries, mining_queries

KNOWN = {**log_queries.queries(), **mining_queries.queries()}
SQL = {**log_queries.oracle_sql(), **mining_queries.oracle_sql()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_oracle(spark, sf_dir, duck, name):
    got, want = KNOWN[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_an_oracle():
    assert set(KNOWN) == set(SQL)


def test_entry_point(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
