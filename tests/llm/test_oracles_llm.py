"""Queries with SQL give DuckDB's rows."""

import pytest
from helpers import duck, same

from crease.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir).toPandas(), duck(sf_dir).sql(registry.oracle_sql()[name]).df())
