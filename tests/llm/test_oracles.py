"""Every query with SQL gives its rows at the smallest size."""

import pytest

from curaloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, sf_dir, same, name):
    same(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLE_SQL[name]).df())
