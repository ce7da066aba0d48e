from collections import defaultdict

from pyspark.sql import functions as F

from netsets.operators.skew import heavy_keys, per_key_runs
from netsets.plans.edge_queries import edge_ends

SCHEMA = "key string, pos long, n_rows int"  # n_rows clashes with a result column


def brute(rows):
    by = defaultdict(list)
    for k, p, _ in rows:
        if k is not None and p is not None:
            by[k].append(p)
    out = {}
    for k, v in by.items():
        v.sort()
        out[k] = (len(v), v[0], v[-1], max([b - a for a, b in zip(v, v[1:])], default=0))
    return out


def test_a_hot_key_is_spread_and_stitched(spark):
    rows = [("hot", i * 3 % 5000, 0) for i in range(3000)] + [(f"k{i % 40}", i * i % 7919, 0) for i in range(2000)] + [("one", 5, 1), (None, 1, 1), ("two", None, 1), ("tie", 4, 0), ("tie", 4, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 3, 16):
        got = {r["key"]: tuple(r)[1:] for r in per_key_runs(df, "key", "pos", n).collect()}
        assert got == brute(rows)
    ranged = df.where("key is not null and pos is not null").repartitionByRange(16, "key", "pos")
    assert ranged.where("key = 'hot'").select(F.spark_partition_id()).distinct().count() > 3


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert per_key_runs(empty, "key", "pos").collect() == []
    assert heavy_keys(per_key_runs(empty, "key", "pos"), "key", 0, 0.02).collect() == []


def test_heavy_keys_include_the_threshold(spark):
    df = spark.createDataFrame([("a", i, 0) for i in range(2)] + [("b", 9, 0)], SCHEMA)
    assert [r["key"] for r in heavy_keys(per_key_runs(df, "key", "pos"), "key", 100, 0.02).collect()] == ["a"]


def test_edge_ends_count_a_self_loop_once_and_drop_nameless_ends(spark):
    rows = [(1, "a-1", "A1"), (2, " A1", None), (3, "--", "b"), (4, None, None), (5, "", "")]
    got = edge_ends(spark.createDataFrame(rows, "edge_id long, node1 string, node2 string")).collect()
    assert sorted((r["gene"], r["edge_id"]) for r in got) == [("A1", 1), ("A1", 2), ("B", 3)]
