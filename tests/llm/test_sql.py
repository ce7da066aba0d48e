"""Every query of the subpackage that SQL can express, against its SQL."""

import pytest

from netsets.llm import queries, sql


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_equals_sql(name, against_sql):
    against_sql(queries.QUERIES[name], sql.SQL[name])
