"""Joins with a table of one row per key, where a few keys may hold most rows of the other side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsets.session import partitions


def salts(table: DataFrame, n: str, per_partition: int = 4) -> Column:
    """How many parts the rows of a key are split into: its share `n` of all rows in parts of a fraction of a partition.

    Only keys with more than 1 / (per_partition * shuffle partitions) of all rows get more than one part, so there are at most
    per_partition * shuffle partitions of them.
    """
    total = table.agg(F.sum(n)).first()[0] or 1
    share = per_partition * partitions(table.sparkSession) / total
    return F.greatest(F.ceil(F.col(n) * F.lit(share)), F.lit(1)).cast("int")


def hot_keys(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """(keys, _salts) of the keys that salts() splits, to be broadcast: there are few, whatever the table's size."""
    return F.broadcast(counts.select(*keys, salts(counts, n).alias("_salts")).where("_salts > 1"))


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str, by: list[Column], how: str = "inner") -> DataFrame:
    """`rows` joined with `table` on `keys`; the rows of keys that hold many are spread over tasks by the hash of `by`.

    `table` has one row per key and the number `n` of the key's rows; it is read three times (pass a written table). The list of
    spread keys is broadcast: see salts() for its bound. Key columns must not be null; `_salt` and `_salts` are reserved names.
    """
    salted = table.withColumn("_salts", salts(table, n))
    hot = F.broadcast(salted.where("_salts > 1").select(*keys, "_salts"))
    part = F.pmod(F.xxhash64(F.lit(29), *by), F.coalesce(F.col("_salts"), F.lit(1))).cast("int")
    left = rows.join(hot, keys, "left").withColumn("_salt", part).drop("_salts")
    right = salted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts", n)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
