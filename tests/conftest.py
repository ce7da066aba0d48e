import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from netsets.session import local_session

    return local_session(cores=4, shuffle_partitions=4, memory="4g")


def normal(value):
    """A value as the comparison with SQL takes it."""
    if isinstance(value, float):
        return "nan" if value != value else round(value + 0.0, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(normal, value))
    return value


@pytest.fixture(scope="session")
def against_sql(spark):
    """Run a query and its SQL over the smallest tables and compare all rows."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{SMALL}/{name}')")

    def compare(query, sql):
        df = query(spark, SMALL)
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        order = sorted(columns)
        want = sorted((tuple(normal(row[columns.index(c)]) for c in order) for row in found.fetchall()), key=repr)
        got = sorted((tuple(normal(row[c]) for c in order) for row in df.collect()), key=repr)
        assert got == want

    return compare
