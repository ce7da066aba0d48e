"""Sums and maps of list columns, batch by batch as matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def summed(rows: DataFrame, column: str, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of part(rows of a batch) over a table: one array per partition reaches the driver, of a size the features fix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            if batch.num_rows:
                own = part(matrix(batch.column(0)))
                sums = own if sums is None else sums + own
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sums.astype(np.float64).tobytes()], pa.binary())], names=["sums"])

    return sum(np.frombuffer(r["sums"]) for r in rows.select(column).mapInArrow(run, "sums binary").collect())


def mapped(rows: DataFrame, column: str, name: str, function: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """`rows` with `column` replaced by array<double> `name`, made batch by batch."""
    ids = [c for c in rows.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(matrix(batch.column(column)))
                offsets = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ids], pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))], names=[*ids, name])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in ids], f"{name} array<double>"]))
