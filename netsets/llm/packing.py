"""Filling fixed-capacity containers with items: sum-of-squares online packing.

Each task packs its share of the items in a fixed order. A level array counts the partially filled containers at each fill
level; an item goes where the sum of the squared counts grows least, a container that becomes full leaves the array. The number
of shares follows from the total size, so a share fills thousands of containers and what its last partial ones leave unused is
small at any scale, and from the number of items, as any number of empty ones may come.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Containers that one task fills, about, and items that it takes at most, about.
CONTAINERS_PER_TASK, ITEMS_PER_TASK = 4096, 1_000_000


class Levels:
    """The open containers of one task by fill level; `counts` holds twice the number at each level.

    With 1 at level 0 and -1 at level `capacity`, counts[h + s] - counts[h] orders the growth of the sum of squares of
    putting size s on level h, opening a container (h = 0) and completing one (h + s = capacity) included.
    """

    def __init__(self, capacity: int):
        self.capacity, self.made = capacity, 0
        self.counts = np.zeros(capacity + 1, np.int64)
        self.counts[0], self.counts[capacity] = 1, -1
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """The container and the start within it for an item of 1..capacity; ties go to the fullest level."""
        low = self.counts[: self.capacity - size + 1]
        growth = np.where(low > 0, self.counts[size:] - low, np.iinfo(np.int64).max)
        level = self.capacity - size - int(np.argmin(growth[::-1]))
        if level:
            container = self.open[level].pop()
            self.counts[level] -= 2
        else:
            container, self.made = self.made, self.made + 1
        if level + size < self.capacity:
            self.open[level + size].append(container)
            self.counts[level + size] += 2
        return container, level


def pack(sizes: DataFrame, capacity: int, id_col: str, size_col: str, containers_per_task: int = CONTAINERS_PER_TASK) -> DataFrame:
    """(id_col, piece, container_id, start, n_tokens): where each item, or piece of an item, lies.

    Only an item larger than `capacity` is split: into full containers and one rest, which is packed like any item. A size of
    zero or null takes no space and lies at the start of its task's first container. Rows are packed in the order of id and
    size within a share picked by their hash, so a rerun gives the same result; repeated rows and null ids are items of their
    own; an empty table gives no rows. `sizes` is read twice (total, then packing): pass a written table if it is costly.
    """
    kind = sizes.schema[id_col].dataType.simpleString()
    slim = sizes.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"))
    total, items = slim.agg(F.sum("size"), F.count(F.lit(1))).first()
    tasks = max(1, ceil((total or 0) / (capacity * containers_per_task)), ceil(items / ITEMS_PER_TASK))
    share = slim.repartition(tasks, F.xxhash64("id", "size")).sortWithinPartitions("id", "size").withColumn("task", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(capacity)
        for batch in batches:
            if not batch.num_rows:
                continue
            base = batch.column(2)[0].as_py() << 33
            row, piece, container, start, used = [], [], [], [], []
            for i, size in enumerate(batch.column(1).to_numpy().tolist()):
                n, rest = divmod(size, capacity)
                parts = [capacity] * n + [rest] * (rest > 0 or not n)
                for k, part in enumerate(parts):
                    where, at = levels.place(part) if part else (0, 0)
                    row.append(i), piece.append(k), container.append(base + where), start.append(at), used.append(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(container, pa.int64()), pa.array(start, pa.int32()), pa.array(used, pa.int32())],
                names=["id", "piece", "container_id", "start", "n_tokens"],
            )

    return share.mapInArrow(run, f"id {kind}, piece int, container_id long, start int, n_tokens int").withColumnRenamed("id", id_col)
