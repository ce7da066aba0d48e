"""Joins that spread the rows of frequent keys."""

from pyspark.sql import functions as F

from netsets.functions.spread import hot_keys, spread_join
from netsets.session import partitions


def test_spread_join_equals_a_plain_join(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") < 3000, "hot").when(F.col("id") < 4000, "warm").otherwise(F.concat(F.lit("k"), F.col("id") % 300)).alias("key"), F.lit(1).alias("clash"))
    table = rows.where("key <> 'k7'").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("most"))
    for how in ("inner", "left"):
        got = spread_join(rows, table, ["key"], "n", [F.col("id")], how)
        want = rows.join(table.drop("n"), "key", how)
        assert sorted(map(tuple, got.select("id", "key", "clash", "most").collect()), key=str) == sorted(map(tuple, want.select("id", "key", "clash", "most").collect()), key=str)
    hot = {r["key"]: r["_salts"] for r in hot_keys(table, ["key"], "n").collect()}
    assert set(hot) == {"hot", "warm"} and hot["hot"] > hot["warm"] > 1 and len(hot) <= 4 * partitions(spark)


def test_an_empty_table(spark):
    rows = spark.range(3).select("id", F.lit("a").alias("key"))
    table = spark.createDataFrame([], "key string, n long, x int")
    assert spread_join(rows, table, ["key"], "n", [F.col("id")]).count() == 0
    assert spread_join(rows, table, ["key"], "n", [F.col("id")], "left").where("x is null").count() == 3
