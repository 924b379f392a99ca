"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from codecorpus.plans.all_queries import oracles as oracle_sql
from codecorpus.plans.all_queries import queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, con, name):
    assert name in oracle_sql()
    assert compare(spark, con, queries()[name], oracle_sql()[name], SF) is None


def test_entry_has_rows(spark):
    assert entry(spark).count() == 3
