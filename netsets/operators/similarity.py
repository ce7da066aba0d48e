"""Similarities of genes and distances of sets, in blocks.

Every row of the left table against every row of the right one is what these operators are asked for. Both sides are packed into
blocks of a bounded number of rows by a hash of their ids. Blocks meet on a grid with as many cells as tasks are wanted: a left
block goes to the cells of its row and a right block to those of its column, so a vector is copied about as often as the root of
the number of tasks. A cell multiplies its blocks one pair at a time. Limits per row (`top`) are applied in the cell, so only
what is wanted leaves it: kernels with a screen take one product that bounds the values from below, and the kernel's own values
only of the pairs that the bound leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil, sqrt
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsets.contracts import check, embedding_contract, gaussian_contract, one_of, require, width
from netsets.functions.batches import mapped, matrix, summed
from netsets.session import partitions, written

#: Rows of a block that one product takes, at most about, and right blocks that a cell holds, without a screen and with one.
BLOCK, CELL_BLOCKS, SCREENED_BLOCKS = 512, 512, 128
#: Right rows that a screen takes at once, pairs of rows of a screened cell (about, while there are tasks enough), pairs valued at once, and pairs held before they are given out.
CHUNK, CELL_PAIRS, VALUED, HELD = 2048, 1 << 33, 1 << 15, 1 << 20
METRICS = ("w2", "sym_kl", "sym_kl_compat")


def _cosine(a: list[np.ndarray], b: list[np.ndarray], eps: float) -> np.ndarray:
    one, two = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), eps) for x in (a[0], b[0]))
    return one @ two.T


def _w2(a: list[np.ndarray], b: list[np.ndarray], eps: float) -> np.ndarray:
    out = np.zeros((len(a[0]), len(b[0])))
    for x, y in ((a[0], b[0]), (np.sqrt(np.maximum(a[1], eps)), np.sqrt(np.maximum(b[1], eps)))):
        for d in range(x.shape[1]):
            out += np.square(x[:, d, None] - y[None, :, d])
    return out


def _sym_kl(a: list[np.ndarray], b: list[np.ndarray], eps: float) -> np.ndarray:
    va, vb = np.maximum(a[1], eps), np.maximum(b[1], eps)
    out = va @ (1 / vb).T + (1 / va) @ vb.T
    for d in range(va.shape[1]):
        out += np.square(a[0][:, d, None] - b[0][None, :, d]) * (1 / va[:, d, None] + 1 / vb[None, :, d])
    return out / 2


def _sym_kl_compat(a: list[np.ndarray], b: list[np.ndarray], eps: float) -> np.ndarray:
    va, vb = np.maximum(a[1], eps), np.maximum(b[1], eps)
    ratios = va @ (1 / vb).T + (1 / va) @ vb.T
    cross = a[0] @ (b[0] / vb).T + (a[0] / va) @ b[0].T
    return ratios / 2 + np.square(a[0]).sum(1)[:, None] + np.square(b[0]).sum(1)[None, :] - cross


def _gaussian_score(a: list[np.ndarray], b: list[np.ndarray], eps: float) -> np.ndarray:
    var = np.maximum(b[1], eps)
    out = np.zeros((len(a[0]), len(b[0])))
    for d in range(var.shape[1]):
        out -= np.square(a[0][:, d, None] - b[0][None, :, d]) / var[None, :, d]
    return out


def _loglik(a: list[np.ndarray], b: list[np.ndarray], eps: float) -> np.ndarray:
    return (_gaussian_score(a, b, eps) - np.log(np.maximum(b[1], eps)).sum(1)[None, :]) / 2


KERNELS: dict[str, Callable] = {"cosine": _cosine, "w2": _w2, "sym_kl": _sym_kl, "sym_kl_compat": _sym_kl_compat, "loglik": _loglik, "neg_mahalanobis": _gaussian_score}


def _w2_points(arrays: list[np.ndarray], eps: float) -> np.ndarray:
    """w2 is the squared distance of these points."""
    return np.concatenate([arrays[0], np.sqrt(np.maximum(arrays[1], eps))], axis=1)


#: Kernels that are squared distances of points, and the points.
SCREENS: dict[str, Callable] = {"w2": _w2_points}


def _factors(points: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points, their squared lengths, and what a screen multiplies by (point, 1): the bound of a distance but for the point's own share."""
    squares = np.square(points).sum(1)
    return points, squares, np.concatenate([-2 * points, _less(points, kind) * squares[:, None]], axis=1).astype(kind)


def _less(points: np.ndarray, kind: type) -> float:
    """1 less the greatest relative error of the product and what goes into it."""
    return 1 - (points.shape[1] + 16) * float(np.finfo(kind).eps)


def _lowest(own: np.ndarray, right: tuple[np.ndarray, np.ndarray, np.ndarray], top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, squared distance) of every row's `top` lowest, and what is within 1e-9 of the last of them; some others may be among them.

    A product in single precision, less its greatest error, bounds the squared distances from below.
    """
    squares = np.square(own).sum(1)
    if not max(squares.max(initial=0), right[1].max(initial=0)) < 1e30:  # single precision overflows; what isn't a number is valued itself
        right = _factors(right[0], np.float64)
    other, _, factors = right
    kind, less = factors.dtype.type, _less(own, factors.dtype.type)
    left = np.concatenate([own, np.ones((len(own), 1))], axis=1).astype(kind)
    limit, held = np.full(len(own), np.inf), []

    def valued(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.concatenate([np.square(own[i[at : at + VALUED]] - other[j[at : at + VALUED]]).sum(1) for at in range(0, max(1, len(i)), VALUED)])

    for first in range(0, len(other), CHUNK):
        bound = left @ factors[first : first + CHUNK].T
        if not first and bound.shape[1] > top:
            near = np.argpartition(bound[:, : max(1024, top + 1)], top - 1, axis=1)[:, :top]
            limit = valued(np.repeat(np.arange(len(own)), top), near.ravel()).reshape(-1, top).max(1)
        most = np.nextafter((limit + 1e-9 - less * squares).astype(kind), kind(np.inf))
        i, j = np.divmod(np.flatnonzero(~(bound > most[:, None])), bound.shape[1])
        held.append((i, j + first, valued(i, j + first)))
        i, j, value = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((value, i))
        i, j, value = i[order], j[order], value[order]
        starts, counts = np.searchsorted(i, np.arange(len(own))), np.bincount(i, minlength=len(own))
        full = counts >= top
        limit[full] = np.fmin(limit[full], value[starts[full] + top - 1])
        kept = ~(value > limit[i] + 1e-9)
        held = [(i[kept], j[kept], value[kept])]
        if kept.sum() > HELD:
            yield held.pop()
    yield from held


def _narrowed(rows: DataFrame, arrays: list[str]) -> DataFrame:
    """`rows` with its arrays in single precision, or as they are where a value has no equal there."""
    equal = lambda c: F.forall(c, lambda x: x.cast("float").cast("double") == x)
    if not rows.where(~F.coalesce(reduce(and_, [equal(c) for c in arrays]), F.lit(False))).isEmpty():
        return rows
    return rows.select("id", *[F.col(c).cast("array<float>").alias(c) for c in arrays])


def _packed(rows: DataFrame, arrays: list[str], side: str, n: int) -> DataFrame:
    block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(f"block_{side}")
    return rows.groupBy(block).agg(F.collect_list(F.struct("id", *arrays)).alias(side))


def pairwise(left: DataFrame, right: DataFrame, arrays_left: list[str], arrays_right: list[str], kernel: str, eps: float, top: int | None = None, lowest: bool = False, block: int = BLOCK) -> DataFrame:
    """(id_1, id_2, value) of the kernel over (id, arrays...) of both sides; `top` keeps each left row's best in a pair of blocks."""
    # both sides are counted and packed: compute each once
    same = left is right
    left = written(left, "left")
    right = left if same else written(right, "right")
    n_left, n_right = (max(1, ceil(x.count() / block)) for x in (left, right))
    cores = left.sparkSession.sparkContext.defaultParallelism
    tasks = 4 * max(partitions(left.sparkSession), cores)
    screen = SCREENS.get(kernel) if top is not None and lowest else None
    if screen:  # a cell takes more pairs: fewer copies
        tasks = min(tasks, max(2 * cores, ceil(n_left * n_right * block * block / CELL_PAIRS)))
    down = min(n_left, max(1, ceil(sqrt(tasks * n_left / n_right))))
    across = min(n_right, max(ceil(tasks / down), ceil(n_right / (SCREENED_BLOCKS if screen else CELL_BLOCKS))))
    function = KERNELS[kernel]
    if screen:  # half the bytes go to the cells where no value loses by it
        left = _narrowed(left, arrays_left)
        right = left if same else _narrowed(right, arrays_right)
    a = _packed(left, arrays_left, "left", n_left).select((F.col("block_left") % down).alias("row"), F.col("left").alias("one"), F.lit(None).cast("int").alias("column"))
    b = _packed(right, arrays_right, "right", n_right).select((F.col("block_right") % across).alias("column"), F.col("right").alias("two"))
    a = a.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    b = b.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    cells = a.select("row", "column", "one", F.lit(None).cast(b.schema["two"].dataType).alias("two")).unionByName(b.select("row", "column", F.lit(None).cast(a.schema["one"].dataType).alias("one"), "two"))
    # a cell's right blocks come first and are held (its column's share of one side); the left blocks stream by
    cells = cells.repartitionById(down * across, (F.col("row") * across + F.col("column")).cast("int")).sortWithinPartitions("row", "column", F.col("two").isNull())

    def arrays_of(packed: pa.Array, names: list[str]) -> list[np.ndarray]:
        return [matrix(packed.field(n)) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, points = None, [], None
        for batch in batches:
            rows, columns = batch.column("row").to_pylist(), batch.column("column").to_pylist()
            for r in range(batch.num_rows):
                if (rows[r], columns[r]) != cell:
                    cell, held, points = (rows[r], columns[r]), [], None
                if batch.column("two")[r].is_valid:
                    two = batch.column("two")[r].values
                    own = arrays_of(two, arrays_right)
                    held.append((two.field("id"), screen(own, eps) if screen else own))
                    continue
                one = batch.column("one")[r].values
                own = arrays_of(one, arrays_left)
                if screen and held:
                    if points is None:
                        points = (pa.concat_arrays([x for x, _ in held]), _factors(np.concatenate([x for _, x in held]), np.float32))
                        held = [None]
                    for i, j, value in _lowest(screen(own, eps), points[1], top):
                        yield pa.RecordBatch.from_arrays([one.field("id").take(pa.array(i)), points[0].take(pa.array(j)), pa.array(value)], names=["id_1", "id_2", "value"])
                    continue
                for ids, other in held:
                    value = function(own, other, eps)
                    if top is not None and top < value.shape[1]:
                        kth = np.partition(value if lowest else -value, top - 1, axis=1)[:, top - 1, None]
                        i, j = np.nonzero((value if lowest else -value) <= kth + 1e-9)
                    else:
                        i, j = (x.ravel() for x in np.indices(value.shape))
                    yield pa.RecordBatch.from_arrays([one.field("id").take(pa.array(i)), ids.take(pa.array(j)), pa.array(value[i, j])], names=["id_1", "id_2", "value"])

    return cells.mapInArrow(run, "id_1 string, id_2 string, value double")


def _chosen(rows: DataFrame, ids: list[str] | None, what: str) -> DataFrame:
    """The rows of the requested ids; unknown and repeated ids are ignored, ValueError where none is left."""
    if ids is None:
        return rows
    asked = rows.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
    found = rows.join(asked, "id", "left_semi")
    check(not found.isEmpty(), f"no {what} found")
    return found


def _sides(rows: DataFrame, ids: list[str] | None, others: list[str] | None, what: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a request: with `ids` alone they are compared with themselves, with `others` alone all rows with those."""
    one = _chosen(rows, ids, what)
    return one, one if others is None else _chosen(rows, others, what)


def cosine(embedding: DataFrame, other: DataFrame | None = None, genes: list[str] | None = None, other_genes: list[str] | None = None, eps: float = 1e-12) -> DataFrame:
    """(gene_1, gene_2, similarity) of all pairs, or of the requested ones. A zero vector has similarity 0 with all.

    Null genes and vectors are left out; vectors of different lengths are an error; an empty side gives no rows.
    """
    rows = embedding_contract(embedding).select(F.col("gene").alias("id"), "vec")
    if other is not None:
        one, two = rows, embedding_contract(other).select(F.col("gene").alias("id"), "vec")
        check(0 in (a := {width(one, "vec"), width(two, "vec")}) or len(a) == 1, "the embeddings differ in dimension")
    else:
        one, two = _sides(rows, genes, other_genes, "gene")
    return pairwise(one, two, ["vec"], ["vec"], "cosine", eps).select(F.col("id_1").alias("gene_1"), F.col("id_2").alias("gene_2"), F.col("value").alias("similarity"))


def cosine_top(embedding: DataFrame, k: int = 10, genes: list[str] | None = None, eps: float = 1e-12) -> DataFrame:
    """(gene_1, gene_2, similarity, rank): the k most similar other genes of each gene, ties (to 9 decimals) by id."""
    rows = embedding_contract(embedding).select(F.col("gene").alias("id"), "vec")
    near = pairwise(rows if genes is None else _chosen(rows, genes, "gene"), rows, ["vec"], ["vec"], "cosine", eps, top=k + 1).where("id_1 <> id_2")
    order = Window.partitionBy("id_1").orderBy(F.round("value", 9).desc(), "id_2")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("id_1").alias("gene_1"), F.col("id_2").alias("gene_2"), F.col("value").alias("similarity"), "rank")


def mean_cosine(embedding: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(gene, mean, n): each gene's mean similarity to all genes, itself included, by the product with the mean of the unit vectors."""
    rows = written(embedding_contract(embedding).select("gene", "vec"), "embedding")
    width(rows, "vec")
    n = rows.count()
    if not n:
        return rows.select("gene", F.lit(0.0).alias("mean"), F.lit(0).cast("long").alias("n"))
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), eps)
    centre = summed(rows, "vec", lambda x: unit(x).sum(0)) / n  # one vector
    means = mapped(rows, "vec", "mean", lambda x: (unit(x) @ centre)[:, None])
    return means.select("gene", F.col("mean")[0].alias("mean"), F.lit(n).cast("long").alias("n"))


def set_distance(gaussians: DataFrame, other: DataFrame | None = None, sets: list[str] | None = None, other_sets: list[str] | None = None, metric: str = "w2", eps: float = 1e-8) -> DataFrame:
    """(set_1, set_2, distance) of all pairs, or of the requested ones; sets without a Gaussian are left out.

    w2 is the squared 2-Wasserstein distance; sym_kl is KL(p, q) + KL(q, p) + dimensions; sym_kl_compat keeps the mean terms
    unweighted but for the cross term, for comparison with results made that way.
    """
    one_of(metric, METRICS, "metric")
    rows = gaussian_contract(gaussians).where("mu is not null and var is not null").select(F.col("set_id").alias("id"), "mu", "var")
    if other is not None:
        one, two = rows, gaussian_contract(other).where("mu is not null and var is not null").select(F.col("set_id").alias("id"), "mu", "var")
        check(0 in (a := {width(one, "mu"), width(two, "mu")}) or len(a) == 1, "the Gaussians differ in dimension")
    else:
        one, two = _sides(rows, sets, other_sets, "set")
    return pairwise(one, two, ["mu", "var"], ["mu", "var"], metric, eps).select(F.col("id_1").alias("set_1"), F.col("id_2").alias("set_2"), F.col("value").alias("distance"))


def closest_sets(gaussians: DataFrame, k: int = 10, metric: str = "w2", eps: float = 1e-8) -> DataFrame:
    """(set_1, set_2, distance, rank): the k closest other sets of each set, ties (to 9 decimals) by id."""
    one_of(metric, METRICS, "metric")
    rows = gaussian_contract(gaussians).where("mu is not null and var is not null").select(F.col("set_id").alias("id"), "mu", "var")
    near = pairwise(rows, rows, ["mu", "var"], ["mu", "var"], metric, eps, top=k + 1, lowest=True).where("id_1 <> id_2")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("id_1").orderBy(F.round("value", 9), "id_2"))).where(F.col("rank") <= k)
    return ranked.select(F.col("id_1").alias("set_1"), F.col("id_2").alias("set_2"), F.col("value").alias("distance"), "rank")


def as_embedding(wide: DataFrame, id_col: str, columns: list[str] | None = None) -> DataFrame:
    """(gene, vec) from a table with one numeric column per dimension; ValueError where a column is missing or not numeric."""
    columns = columns or [c for c in wide.columns if c != id_col]
    slim = require(wide, id_col, *columns)
    kinds = dict(slim.dtypes)
    bad = [c for c in columns if not kinds[c].startswith(("double", "float", "int", "bigint", "smallint", "tinyint", "decimal"))]
    check(not bad, f"columns that aren't numeric: {', '.join(bad)}")
    return slim.select(F.col(id_col).cast("string").alias("gene"), F.array(*[F.col(c).cast("double") for c in columns]).alias("vec"))
