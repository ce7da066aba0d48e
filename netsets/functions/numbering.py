"""Consecutive numbers and false-discovery rates without a window over the whole table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsets.session import partitions, written


def with_numbers(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """`df` with `number`, 0, 1, 2, ... in the given order: a range sort, and offsets from the partitions' row counts.

    Rows that tie in `order` are numbered in any order, but once and for all, as the sorted rows are written.
    """
    n = partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = written(ranged, name)
    part = F.shiftrightunsigned("_id", 33).cast("int")
    counts = ranged.groupBy(part.alias("part")).count().collect()  # one row per partition
    sizes = np.zeros(max([n, *(r["part"] + 1 for r in counts)]) + 1, np.int64)
    for r in counts:
        sizes[r["part"] + 1] = r["count"]
    starts = F.array(*[F.lit(int(x)) for x in np.cumsum(sizes)])
    local = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("number", F.element_at(starts, part + 1) + local).drop("_id")


def discoveries(tests: DataFrame, p: str, keys: list[str], total: int, q: str = "q_value") -> DataFrame:
    """`tests` with the Benjamini-Hochberg rate of `p` over `total` tests, those not in the table having p = 1; a null p has a null rate.

    The sorted tests are cut into as many blocks as there are shuffle partitions; the running minimum from the end is taken in
    each block, and the blocks' minima are stitched.
    """
    ranked = with_numbers(tests.where(F.col(p).isNotNull()), [p, *keys], "by-p")
    n, count = partitions(tests.sparkSession), max(1, ranked.count())
    raw = ranked.withColumn("_raw", F.col(p) * F.lit(float(total)) / (F.col("number") + 1)).withColumn("_block", F.floor(F.col("number") * n / F.lit(count)).cast("int"))
    lowest = {r["_block"]: r["low"] for r in raw.groupBy("_block").agg(F.min("_raw").alias("low")).collect()}  # one row per block
    later, after = 1.0, [1.0] * n
    for b in range(n - 1, -1, -1):
        after[b] = later
        later = min(later, lowest.get(b, 1.0))
    rest = F.element_at(F.array(*[F.lit(float(x)) for x in after]), F.col("_block") + 1)
    backwards = Window.partitionBy("_block").orderBy(F.col("number").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rated = raw.withColumn(q, F.least(F.min("_raw").over(backwards), rest, F.lit(1.0))).drop("_raw", "_block", "number")
    return rated.unionByName(tests.where(F.col(p).isNull()).withColumn(q, F.lit(None).cast("double")))
