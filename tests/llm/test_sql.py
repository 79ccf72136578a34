"""The queries that SQL can express against their SQL."""

import pytest

from lintel.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, same_rows, name):
    same_rows(queries.queries()[name](spark, sf_dir), SQL[name])
