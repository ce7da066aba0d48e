"""Copies and top-N against brute force."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from netsets.llm import copies, topn
from netsets.llm.queries import _edge_tree, _named_edges
from netsets.sources.tables import number_in

EDGES = "edge_id long, node1 string, node2 string, weight_text string"


def found(spark, rows):
    """The query's edge rows, with columns whose names clash with the result's."""
    return _named_edges(spark.createDataFrame(rows, EDGES)).withColumns({"first_id": F.lit(0), "copies": F.lit(0)})


def test_formatting_hides_no_copy(spark):
    rows = [
        (1, "ab-1", "C2", "0.71"), (2, "c2 ", "AB1", "7.100E-01"), (3, "(Ab.1)", "c_2", "'0,710;"), (4, "AB1", "C2", ".71"),
        (5, "AB1", "C2", "NA"), (6, "AB1", "C2", None), (7, "C2", "AB1", " "), (8, "AB1", "C2", "0.711"), (9, "AB", "1C2", "0.71"),
        (10, "AB1", "--", "0.71"), (11, None, "C2", "0.71"), (12, "X", "X", "1"), (13, "x", "x ", "+1.0"), (14, "X", "Y", "1"),
    ]
    df = found(spark, rows)
    got = sorted((r["first_id"], r["edge_id"]) for r in copies.copies(df, _edge_tree(), "edge_id").collect())
    assert got == [(1, 2), (1, 3), (1, 4), (5, 6), (5, 7), (12, 13)]
    sizes = {r["first_id"]: r["copies"] for r in copies.records(df, _edge_tree(), "edge_id").collect()}
    assert sizes == {1: 4, 5: 3, 8: 1, 9: 1, 12: 2, 14: 1}
    assert copies.copies(df.where("false"), _edge_tree(), "edge_id").collect() == []


def test_a_collision_of_digests_merges_nothing(spark):
    class Colliding(copies.Node):
        def digest(self):
            return F.lit(1).cast("long")

    tree = Colliding((copies.Leaf(F.col("node1")), copies.Leaf(F.col("node2"))))
    df = spark.createDataFrame([(1, "a", "b"), (2, "a", "c"), (3, "a", "b"), (None, "a", "b")], "edge_id long, node1 string, node2 string")
    assert [(r["first_id"], r["edge_id"]) for r in copies.copies(df, tree, "edge_id").collect()] == [(1, 3)]


def test_numbers_in_texts(spark):
    texts = ["0.5", " 0,5 ", "(.5)", "5e-1", "5E-01;", "+0.50", "half", "", None, "1e999", "-0"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(number_in(F.col("t"))).collect()]
    assert got == [0.5] * 6 + [None] * 3 + [float("inf"), 0.0] and str(got[-1]) == "0.0"


def test_top_n(spark):
    random.seed(4)
    rows = [(f"s{random.choice([0] * 6 + list(range(1, 30)))}", f"g{random.randrange(300)}", random.choice([None, float("nan"), *[round(random.gauss(0, 2), 1) for _ in range(8)]])) for _ in range(6000)]
    rows += [(None, "g1", 1.0), ("s1", None, 1.0), ("unlisted", "g1", 1.0), ("s1", "neg", -0.0), ("s1", "pos", 0.0)]
    limits = [(f"s{i}", random.choice([None, 0, 1, 3, 10, 1000])) for i in range(20)] + [("s0", 70), ("s3", 2), ("nothing", 5), (None, 3), ("s4", -2)]
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], "set_id string, gene string, score double, rank int, n int")
    asked = defaultdict(int)
    for s, n in limits:
        if s:
            asked[s] = max(asked[s], 50 if n is None else n)
    want = set()
    for s, n in asked.items():
        best = {}
        for t, g, x in rows:
            if t == s and g is not None and x is not None and x == x:
                best[g] = max(best.get(g, float("-inf")), x)
        want |= {(s, g, x, i + 1) for i, (g, x) in enumerate(sorted(best.items(), key=lambda v: (-v[1], v[0]))[:n])}
    got = [tuple(r) for r in topn.top_n(df, spark.createDataFrame(limits, "set_id string, top_n int"), "set_id", "gene", "score", "top_n").collect()]
    assert Counter(got) == Counter(want)
    assert topn.top_n(df.where("false"), spark.createDataFrame(limits, "set_id string, top_n int"), "set_id", "gene", "score", "top_n").collect() == []


def test_small_arrow_batches_carry_the_group_over(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame([("s", f"g{i:03d}", float(i)) for i in range(100)], "set_id string, gene string, score double")
        got = topn.top_n(df, spark.createDataFrame([("s", 30)], "set_id string, top_n int"), "set_id", "gene", "score", "top_n").collect()
        assert [(r["gene"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(f"g{99 - i:03d}", i + 1) for i in range(30)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_group_with_most_rows_and_a_limit_above_its_size(spark):
    """Nine tenths of the rows are one group of which all is asked for: its ranks are put together from many parts."""
    df = spark.range(4000).select(F.when(F.col("id") % 10 > 0, "huge").otherwise(F.concat(F.lit("s"), F.col("id") % 70)).alias("set_id"), F.concat(F.lit("g"), F.col("id")).alias("gene"), (F.col("id") * 7 % 101).cast("double").alias("score"))
    limits = spark.createDataFrame([("huge", 10**6), ("s0", 3), ("s10", 1)], "set_id string, top_n int")
    got = [tuple(r) for r in topn.top_n(df, limits, "set_id", "gene", "score", "top_n").collect()]
    rows = [(("huge" if i % 10 else f"s{i % 70}"), f"g{i}", float(i * 7 % 101)) for i in range(4000)]
    want = []
    for group, n in (("huge", 10**6), ("s0", 3), ("s10", 1)):
        want += [(*r, k + 1) for k, r in enumerate(sorted((r for r in rows if r[0] == group), key=lambda r: (-r[2], r[1]))[:n])]
    assert sorted(got) == sorted(want)


def test_a_record_with_most_rows(spark):
    tree = copies.Node((copies.Leaf(F.col("x")),))
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "same").otherwise(F.concat(F.lit("x"), F.col("id") % 900)).alias("x"), F.lit(1).alias("first_id"))
    got = sorted(map(tuple, copies.copies(df, tree, "id").collect()))
    want = [(1, i) for i in range(3000) if i % 3 and i > 1] + [(i % 900, i) for i in range(900, 3000, 3)]
    assert got == sorted(want)
