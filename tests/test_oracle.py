"""Every query of the core library against its SQL."""

import pytest

from netsets.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(name, against_sql):
    against_sql(catalog.QUERIES[name], catalog.SQL[name])


def test_queries_without_sql_give_rows(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.SQL)):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0, name
