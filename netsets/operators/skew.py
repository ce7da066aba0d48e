"""Per-key results when a handful of keys hold most rows.

Rows are range-partitioned on the composite (key, order) with Spark's sampled quantiles, so a heavy key is spread over as many
partitions as its rows need. Each partition reduces its sorted rows to one partial state per key; as every key occupies a
contiguous run of partitions, the partial states, one per key and partition, are then stitched in partition order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsets.session import partitions

_PARTIAL = "key string, part int, n long, first_pos long, last_pos long, max_gap long"


def _partial_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, pos, part) batches to one state per key; the open key is carried from batch to batch."""
    names = ["key", "part", "n", "first_pos", "last_pos", "max_gap"]
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    open_state: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).dictionary_encode()
        codes = keys.indices.to_numpy(zero_copy_only=False)
        pos, part = batch.column(1).to_numpy(), batch.column(2)[0].as_py()
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        ends = np.r_[starts[1:], len(codes)] - 1
        gaps = np.diff(pos, prepend=pos[0])
        gaps[starts] = 0
        words = keys.dictionary.take(pa.array(codes[starts])).to_pylist()
        states = [list(s) for s in zip(words, [part] * len(words), (ends - starts + 1).tolist(), pos[starts].tolist(), pos[ends].tolist(), np.maximum.reduceat(gaps, starts).tolist())]
        if open_state is not None and states[0][0] == open_state[0]:
            head = states[0]
            gap = max(open_state[5], head[5], head[3] - open_state[4])
            states[0] = [head[0], part, open_state[2] + head[2], open_state[3], head[4], gap]
        elif open_state is not None:
            states.insert(0, open_state)
        open_state = states.pop()
        if states:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*states), types)], names=names)
    if open_state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(open_state, types)], names=names)


def per_key_runs(rows: DataFrame, key: str, pos: str, num_partitions: int | None = None) -> DataFrame:
    """Per key: number of rows, lowest and highest position, and the widest gap between neighbouring positions.

    `pos` orders a key's rows (a bigint). Rows with a null key or position are left out; repeated rows count each time (gap 0);
    an empty table gives no rows; other columns are not read. Ties in position don't matter to any state. A key with a single
    row has gap 0. Columns: `key`, n_rows, first_pos, last_pos, max_gap.
    """
    spark = rows.sparkSession
    n = num_partitions or partitions(spark)
    slim = rows.select(F.col(key).cast("string").alias("key"), F.col(pos).cast("long").alias("pos")).where("key is not null and pos is not null")
    ranged = slim.repartitionByRange(n, "key", "pos").sortWithinPartitions("key", "pos").withColumn("part", F.spark_partition_id())
    partial = ranged.mapInArrow(_partial_states, _PARTIAL)
    # at most one state per key and partition: the list is bounded by the number of partitions, whatever the key's size
    stitched = partial.groupBy("key").agg(
        F.sum("n").alias("n_rows"),
        F.min("first_pos").alias("first_pos"),
        F.max("last_pos").alias("last_pos"),
        F.array_sort(F.collect_list(F.struct("part", "first_pos", "last_pos", "max_gap"))).alias("states"),
    )
    inner = F.array_max(F.transform("states", lambda s: s["max_gap"]))
    seams = F.transform(F.expr("slice(states, 2, size(states))"), lambda s, i: s["first_pos"] - F.element_at("states", i + 1)["last_pos"])
    widest = F.greatest(inner, F.coalesce(F.array_max(seams), F.lit(0)))
    return stitched.select(F.col("key").alias(key), "n_rows", "first_pos", "last_pos", widest.cast("long").alias("max_gap"))


def heavy_keys(runs: DataFrame, key: str, total_rows: int, share: float) -> DataFrame:
    """The keys whose `n_rows` reach `share` of `total_rows`; none when the table is empty."""
    return runs.where((F.col("n_rows") >= F.lit(share) * F.lit(total_rows)) & (F.lit(total_rows) > 0)).select(key, "n_rows")
