"""Top N items within every group by a secondary sort.

Repeated (group, item) rows are first reduced to their best score, which spreads a huge group over all tasks by its items. Rows
are then hash-partitioned by (group, salt), with as many salts as the group's share of all rows asks for, sorted by score and item,
and streamed as Arrow batches that keep the first N rows of each group. The few survivors are range-partitioned by group, score and
item, so that even a group whose N exceeds any task is ranked by many. No pass buffers a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsets.functions.numbering import with_numbers
from netsets.functions.spread import hot_keys, salts, spread_join
from netsets.session import written


def _first_n(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the rows whose place within their run of equal group ids is at most `n`; only the last group and its count are carried over."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("group_id").dictionary_encode()
        codes = group.indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)]))
        first, final = group.dictionary[codes[0]].as_py(), group.dictionary[codes[-1]].as_py()
        head = starts[1] if len(starts) > 1 else len(codes)
        if first == last:
            place[:head] += seen
        seen, last = int(place[-1]) + 1, final
        kept = batch.filter(pa.array(place < batch.column("n").to_numpy()))
        if kept.num_rows:
            yield kept


def top_n(scores: DataFrame, limits: DataFrame, group: str, item: str, score: str, n: str, default_n: int = 50) -> DataFrame:
    """(group, item, score, rank) of the `n` best items of every group listed in `limits`.

    Highest score first, ties by item in byte order. Null and NaN scores don't count, nor do null groups or items; an item
    scored more than once in a group counts once with its best score. A null limit is `default_n`, a zero or negative one
    gives no rows, a group listed more than once takes its largest limit. Groups without scores and scores of unlisted groups
    give nothing; empty tables give an empty result. Other columns aren't read.
    """
    listed = (
        limits.select(F.col(group).alias("group_id"), F.coalesce(F.col(n), F.lit(default_n)).cast("int").alias("n"))
        .where("group_id is not null")
        .groupBy("group_id")
        .agg(F.max("n").alias("n"))
        .where("n > 0")
    )
    known = scores.select(F.col(group).alias("group_id"), F.col(item).alias("item"), (F.col(score).cast("double") + F.lit(0.0)).alias("score"))
    known = known.where("group_id is not null and item is not null and score is not null and not isnan(score)")
    asked = written(known.groupBy("group_id").agg(F.count(F.lit(1)).alias("rows")).join(listed, "group_id"), "asked-groups")
    best = known.groupBy("group_id", "item").agg(F.max("score").alias("score"))
    hot = best.join(hot_keys(asked, ["group_id"], "rows"), "group_id", "left")
    salted = hot.select("group_id", "item", "score", F.pmod(F.xxhash64("item"), F.coalesce(F.col("_salts"), F.lit(1))).cast("int").alias("salt"))
    spread = asked.select("group_id", "n", F.explode(F.sequence(F.lit(0), salts(asked, "rows") - 1)).alias("salt"))
    order = ["group_id", F.col("score").desc(), "item"]
    first = salted.join(spread.hint("shuffle_hash"), ["group_id", "salt"]).select("group_id", "item", "score", "n").sortWithinPartitions(*order)
    kept = written(first.mapInArrow(_first_n, first.schema), "best-of-parts")
    # any rows of a group before the range sort are more than enough: the rank over all parts decides
    ranked = with_numbers(kept, order, "by-score")
    starts = written(ranked.groupBy("group_id").agg(F.min("number").alias("start"), F.count(F.lit(1)).alias("rows")), "group-starts")
    placed = spread_join(ranked, starts, ["group_id"], "rows", [F.col("number")]).withColumn("rank", (F.col("number") - F.col("start") + 1).cast("int"))
    return placed.where("rank <= n").select(F.col("group_id").alias(group), F.col("item").alias(item), F.col("score").alias(score), "rank")
