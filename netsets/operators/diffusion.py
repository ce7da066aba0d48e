"""Random walks with restart from seed distributions, and the features read from them.

Three ways to the same fixed point, with one stopping rule. Where the number of edges is checked to be small, they are broadcast as
arrays and the seed columns are spread over the tasks. As long as a task can hold them, packed edges are shuffled to each of a few
tasks that walk the columns, without passing the driver. Beyond that the edges lie in a grid of blocks by their ends, and the values
of many columns move together: in each step the values of a block of nodes meet the cells of its column of the grid and are
summed along the rows. Several steps are one plan, in which the edges are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsets.contracts import check, membership_contract, one_of, require
from netsets.functions.numbering import with_numbers
from netsets.operators.graph import Graph, landmarks, settled, transition
from netsets.session import discard, tidy, written

#: Edges that may be broadcast to the tasks (16 bytes each).
MAX_BROADCAST_EDGES = 4_000_000
#: Edges that a task may hold (about 17 bytes each), and edges of a packed piece of them.
MAX_COPIED_EDGES, PIECE = 24_000_000, 1 << 16
#: Nodes of a block of dense values.
NODES = 4096
#: Steps between two looks at the change.
EVERY = 5
#: Edges of a cell of the grid, about, and columns that move together.
CELL, COLUMNS = 500_000, 64


def _normal_seeds(seeds: DataFrame) -> DataFrame:
    """Seed columns divided by their sums; ValueError where one has no positive mass."""
    slim = require(seeds, "node", "col", "val").where("node is not null and col is not null")
    slim = slim.groupBy("node", "col").agg(F.sum(F.coalesce(F.col("val").cast("double"), F.lit(0.0))).alias("val"))
    sums = slim.groupBy("col").agg(F.sum("val").alias("mass"))
    check(sums.where("mass <= 0").isEmpty(), "every seed column must have positive mass")
    return slim.join(sums, "col").select("node", "col", (F.col("val") / F.col("mass")).alias("val")).where("val <> 0")


def _share(p: DataFrame) -> DataFrame:
    sums = p.groupBy("col").agg(F.sum("val").alias("mass"))
    return p.join(sums, "col").select("node", "col", (F.col("val") / F.col("mass")).alias("val"))


def _by_grid(edges: DataFrame, n: int, count: int, seeds: DataFrame, columns: int, alpha: float, stop: float, max_iter: int) -> DataFrame:
    """(number, place, val): the walks of at most COLUMNS seed columns (number, place, val) over `count` edges (i, j, x)."""
    side = min(max(2, ceil(sqrt(count / CELL))), max(n, 1))
    size = ceil(n / side)
    block = lambda c: F.floor(F.col(c) / size).cast("int")
    at = lambda c: (F.col(c) % size).cast("int").alias(c)
    cells = edges.select(block("i").alias("row"), block("j").alias("block"), F.struct(at("i"), at("j"), "x").alias("e")).groupBy("row", "block").agg(F.collect_list("e").alias("edges"))
    cells = written(cells, "walk-cells")
    live = np.arange(columns)  # the places of the columns that still walk

    def dense(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros((size, columns))
        np.add.at(values, (rows["number"] % size, rows["place"]), rows["val"])
        return pd.DataFrame({"block": [int(rows["number"].iloc[0] // size)], "values": [values.tobytes()]})

    start = written(seeds.withColumn("block", block("number")).groupBy("block").applyInPandas(dense, "block int, values binary"), "walk-seeds")

    def moved(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    e, values = batch.column("edges")[k].values, np.frombuffer(batch.column("values")[k].as_py()).reshape(size, width)
                    i, j, x = (e.field(c).to_numpy() for c in ("i", "j", "x"))
                    order = np.argsort(i, kind="stable")
                    starts = np.flatnonzero(np.r_[True, np.diff(i[order]) > 0])
                    sums = np.zeros((size, width))
                    sums[i[order][starts]] = np.add.reduceat(values[j[order]] * x[order, None], starts, axis=0)
                    yield pa.RecordBatch.from_arrays([batch.column("row").slice(k, 1), pa.array([((1 - alpha) * sums).tobytes()], pa.binary()), pa.array(["sum"])], names=["block", "values", "what"])

        return run

    def added(width: int):
        """The sum of a block's parts, and for each column how far it is from the block's values before."""

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            old = new = np.zeros(size * width)
            for what, values in zip(rows["what"], rows["values"]):
                own = np.frombuffer(values)
                new = new + {"sum": 1.0, "seed": alpha, "old": 0.0}[what] * own
                old = own if what == "old" else old
            return pd.DataFrame({"block": rows["block"].iloc[:1], "values": [new.tobytes()], "change": [np.abs(new - old).reshape(size, width).sum(0).tobytes()]})

        return run

    def narrowed(table: DataFrame, width: int, kept: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [np.frombuffer(v).reshape(size, width)[:, kept].tobytes() for v in batch.column("values").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(own, pa.binary())], names=["block", "values"])

        return table.select("block", "values").mapInArrow(run, "block int, values binary")

    def listed(table: DataFrame, width: int, kept: np.ndarray, places: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own, v in zip(batch.column("block").to_pylist(), batch.column("values").to_pylist()):
                    values = np.frombuffer(v).reshape(size, width)[:, kept]
                    row, k = np.nonzero(values)
                    yield pa.RecordBatch.from_arrays([pa.array(own * size + row), pa.array(places[k].astype(np.int32)), pa.array(values[row, k])], names=["number", "place", "val"])

        return table.select("block", "values").mapInArrow(run, "number long, place int, val double")

    p, found, done = start, None, 0
    while len(live):
        steps = min(EVERY, max_iter - done)
        new = p
        for step in range(steps):
            parts = cells.join(new.select("block", "values").hint("shuffle_hash"), "block").select("row", "edges", "values").mapInArrow(moved(len(live)), "block int, values binary, what string")
            parts = parts.unionByName(start.select("block", "values", F.lit("seed").alias("what")))
            if step == steps - 1:
                parts = parts.unionByName(new.select("block", "values", F.lit("old").alias("what")))
            new = parts.groupBy("block").applyInPandas(added(len(live)), "block int, values binary, change binary")
        if steps:
            new = written(new, "walk")
            change = sum((np.frombuffer(r["change"]) for r in new.select("change").collect()), np.zeros(len(live)))  # one row per block
        else:
            change = np.full(len(live), np.inf)
        done += steps
        ended = np.flatnonzero((change < stop) | (done >= max_iter))
        if len(ended):
            out = written(listed(new, len(live), ended, live[ended]), "walked")
            found = out if found is None else found.unionByName(out)
            kept = np.setdiff1d(np.arange(len(live)), ended)
            start, before = written(narrowed(start, len(live), kept), "walk-seeds"), start
            new, last = written(narrowed(new, len(live), kept), "walk"), new
            discard(before, last)
            live = live[kept]
        if p is not start:
            discard(p)
        p = new
        tidy(edges.sparkSession)
    discard(cells, p, start)
    return found


def _by_broadcast(edges: DataFrame, n: int, seeds: DataFrame, alpha: float, stop: float, max_iter: int) -> DataFrame:
    """As _by_grid, any number of columns, with the edges broadcast."""
    coo = edges.select(F.col("i").cast("int"), F.col("j").cast("int"), "x").toArrow()  # at most MAX_BROADCAST_EDGES rows
    i, j, x = (coo.column(k).to_numpy() for k in ("i", "j", "x"))
    order = np.argsort(i, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(i[order]) > 0][: len(i)])
    shared = edges.sparkSession.sparkContext.broadcast((i[order][starts], starts, j[order], x[order]))
    columns = seeds.groupBy("place").agg(F.collect_list(F.struct("number", "val")).alias("seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, starts, j, x = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                start = batch.column("seed")[at].values
                s = np.bincount(start.field("number").to_numpy(), start.field("val").to_numpy(), n)
                p = s
                for step in range(1, max_iter + 1):
                    new = alpha * s
                    if len(rows):
                        new[rows] += (1 - alpha) * np.add.reduceat(x * p[j], starts)
                    ended = step % EVERY == 0 and np.abs(new - p).sum() < stop
                    p = new
                    if ended:
                        break
                held = np.flatnonzero(p)
                yield pa.RecordBatch.from_arrays([pa.array(held), batch.column("place").take(pa.array([at] * len(held))), pa.array(p[held])], names=["number", "place", "val"])

    # places are 0, 1, ...: each task gets as many columns as any other
    tasks = edges.sparkSession.sparkContext.defaultParallelism
    return columns.repartitionByRange(tasks, "place").mapInArrow(run, "number long, place int, val double")


def _packed_edges(edges: DataFrame) -> DataFrame:
    """Edges (i, j, x) in pieces: the rows that a piece has, and for each edge its row's place among them, its end and its weight."""

    def piece(i: np.ndarray, j: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        rows, own = np.unique(i, return_inverse=True)
        own = [rows.astype(np.int32), own.astype(np.int32), j.astype(np.int32), x]
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in own], names=["rows", "places", "ends", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(c).to_numpy() for c in ("i", "j", "x")])
                size += batch.num_rows
            if size >= PIECE:
                yield piece(*(np.concatenate(a) for a in zip(*held)))
                held, size = [], 0
        if held:
            yield piece(*(np.concatenate(a) for a in zip(*held)))

    return edges.select("i", "j", "x").mapInArrow(run, "rows binary, places binary, ends binary, weights binary")


def _by_copies(edges: DataFrame, n: int, seeds: DataFrame, columns: int, alpha: float, stop: float, max_iter: int, dense: bool) -> DataFrame:
    """As _by_broadcast, with all packed edges shuffled to each of a few tasks; `dense`: (block, place, values), columns scaled to sum 1."""
    tasks = min(columns, edges.sparkSession.sparkContext.defaultParallelism)
    pieces = _packed_edges(edges).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    starts = seeds.groupBy("place").agg(F.collect_list(F.struct("number", "val")).alias("seed")).withColumn("task", F.col("place") % tasks)
    rows = pieces.unionByName(starts, allowMissingColumns=True).repartitionById(tasks, F.col("task").cast("int"))

    def given(place: int, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        if dense:
            p = p / p.sum()
            for block in range(0, n, NODES):
                yield pa.RecordBatch.from_arrays([pa.array([block // NODES], pa.int32()), pa.array([place], pa.int32()), pa.array([p[block : block + NODES].tobytes()], pa.binary())], names=["block", "place", "values"])
        else:
            held = np.flatnonzero(p)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(np.full(len(held), place, np.int32)), pa.array(p[held])], names=["number", "place", "val"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = [], []
        for batch in batches:
            for at in range(batch.num_rows):
                if batch.column("seed")[at].is_valid:
                    seed = batch.column("seed")[at].values
                    own.append((batch.column("place")[at].as_py(), (seed.field("number").to_numpy(), seed.field("val").to_numpy())))
                else:
                    held.append([np.frombuffer(batch.column(c)[at].as_buffer(), kind) for c, kind in (("rows", np.int32), ("places", np.int32), ("ends", np.int32), ("weights", np.float64))])
        for place, seed in own:
            s = np.bincount(*seed, n)
            p = s
            for step in range(1, max_iter + 1):
                new = alpha * s
                for rows, places, ends, weights in held:
                    new[rows] += (1 - alpha) * np.bincount(places, weights * p[ends], len(rows))
                ended = step % EVERY == 0 and np.abs(new - p).sum() < stop
                p = new
                if ended:
                    break
            yield from given(place, p)

    return rows.mapInArrow(run, "block int, place int, values binary" if dense else "number long, place int, val double")


@dataclass(frozen=True)
class _Setting:
    """Numbered nodes (node, number) and edges (i, j, x), the columns (col, place), the seeds (number, place, val), and how many there are."""

    numbered: DataFrame
    edges: DataFrame
    names: DataFrame
    placed: DataFrame
    nodes: int
    columns: int
    method: str


def _set_up(edges: DataFrame, graph: Graph, seeds: DataFrame, method: str) -> _Setting:
    numbered = graph.nodes.select("node", F.col("pos").alias("number")) if graph.numbered else with_numbers(graph.nodes.select("node"), ["node"], "walk-nodes")
    numbered = written(numbered.select("node", "number"), "numbered-nodes")
    src, dst = (numbered.select(F.col("node").alias(end), F.col("number").alias(k)) for end, k in (("src", "i"), ("dst", "j")))
    edges = written(edges.join(dst, "dst").select("src", "j", "x").join(src, "src").select("i", "j", "x"), "walk-edges")
    names = written(with_numbers(seeds.select("col").distinct(), ["col"], "columns").select("col", F.col("number").cast("int").alias("place")), "places")
    placed = written(seeds.join(names, "col").join(numbered, "node").select("number", "place", F.col("val").cast("double").alias("val")), "seeds")
    count = edges.count()
    if method == "auto":
        method = "blocks" if count <= MAX_BROADCAST_EDGES else "copies" if count <= MAX_COPIED_EDGES else "joins"
    tidy(edges.sparkSession)
    return _Setting(numbered, edges, names, placed, numbered.count(), names.count(), method)


def _walk(edges: DataFrame, graph: Graph, seeds: DataFrame, alpha: float, tol: float, max_iter: int, method: str) -> DataFrame:
    """(node, col, val) where the walks over (src, dst, x) from the columns (node, col, val) end, as they are."""
    return _walked(_set_up(edges, graph, seeds, method), alpha, tol, max_iter)


def _walked(given: _Setting, alpha: float, tol: float, max_iter: int) -> DataFrame:
    edges, placed, n, columns = given.edges, given.placed, given.nodes, given.columns
    stop = tol / max(1, columns)
    if not columns:
        found = placed
    elif given.method == "blocks":
        found = written(_by_broadcast(edges, n, placed, alpha, stop, max_iter), "walked")
    elif given.method == "copies":
        found = written(_by_copies(edges, n, placed, columns, alpha, stop, max_iter, dense=False), "walked")
    else:
        found, count = None, edges.count()
        for first in range(0, columns, COLUMNS):
            some = placed.where(F.col("place").between(first, first + COLUMNS - 1)).withColumn("place", F.col("place") - first)
            own = _by_grid(edges, n, count, some, min(COLUMNS, columns - first), alpha, stop, max_iter).withColumn("place", F.col("place") + first)
            found = own if found is None else found.unionByName(own)
    return found.join(given.numbered, "number").join(given.names, "place").select("node", "col", "val")


def _dense(parts: DataFrame, numbered: DataFrame, columns: int) -> DataFrame:
    """(node, pos, features): the values (block, place, values) of all columns, a node a row; pos is the node's number."""
    names = numbered.select(F.floor(F.col("number") / NODES).cast("int").alias("block"), "number", "node")

    def run(table: pa.Table) -> pa.Table:
        part, own = table.filter(pc.is_valid(table["values"])), table.filter(pc.is_valid(table["node"]))
        values = np.zeros((NODES, columns))
        for place, v in zip(part["place"].to_pylist(), part["values"]):
            column = np.frombuffer(v.as_buffer())
            values[: len(column), place] = column
        number = own["number"].to_numpy()
        values = values[number % NODES]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(number) + 1, dtype=np.int32) * columns), pa.array(values.ravel()))
        return pa.table({"node": own["node"], "pos": own["number"], "features": lists})

    return parts.unionByName(names, allowMissingColumns=True).groupBy("block").applyInArrow(run, "node string, pos long, features array<double>")


def spread_over(graph: Graph, seeds: DataFrame, columns: list, alpha: float = 0.5, tol: float = 1e-10, max_iter: int = 200, normalize: str = "col", method: str = "auto") -> DataFrame:
    """(node, pos, features): diffuse() with a row for each node, the values of `columns` in their order, 0 where nothing arrives."""
    _check_walk(alpha, max_iter, method)
    graph = settled(graph)
    seeds = written(_normal_seeds(seeds), "seeds")
    check(seeds.join(graph.nodes, "node", "left_anti").isEmpty(), "a seed is not a node of the graph")
    given = _set_up(transition(graph, normalize), graph, seeds, method)
    at = {r["col"]: r["place"] for r in given.names.collect()}  # the columns, as many as were asked for
    if given.method == "copies" and given.columns:
        parts = _by_copies(given.edges, given.nodes, given.placed, given.columns, alpha, tol / given.columns, max_iter, dense=True)
        rows = _dense(parts, given.numbered, given.columns)
        order = F.array(*[F.col("features")[at[c]] if c in at else F.lit(0.0) for c in columns])
        if list(at) != columns or [at[c] for c in columns] != list(range(given.columns)):
            rows = rows.withColumn("features", order)
        return rows if graph.numbered else rows.drop("pos").join(graph.nodes, "node").select("node", "pos", "features")
    p = _share(_walked(given, alpha, tol, max_iter))
    by_column = p.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("col", "val"))).alias("m"))
    full = F.array(*[F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0.0)) for c in columns]) if columns else F.array().cast("array<double>")
    return graph.nodes.join(by_column, "node", "left").select("node", "pos", full.alias("features"))


def diffuse(graph: Graph, seeds: DataFrame, alpha: float = 0.5, tol: float = 1e-10, max_iter: int = 200, normalize: str = "col", method: str = "auto") -> DataFrame:
    """(node, col, val): the distribution of a random walk with restart for each seed column of (node, col, val).

    p <- (1 - alpha) W p + alpha s until a step changes a column by less than its share of `tol`, tol / columns, or for `max_iter`
    steps (0: the normalised seed); the change is looked at every EVERY steps, whatever the method. Columns are scaled to sum
    1 at the end, which also mends what leaks at isolated nodes. Seeds outside the graph are an error, as is a column without
    positive mass. Only non-zero values come out. `method` is joins (a grid of edge blocks), blocks (the edges broadcast),
    copies (the edges shuffled to a few tasks that hold them), or auto: blocks where the graph has at most MAX_BROADCAST_EDGES
    edges, copies up to MAX_COPIED_EDGES.
    """
    _check_walk(alpha, max_iter, method)
    graph = settled(graph)
    seeds = written(_normal_seeds(seeds), "seeds")
    check(seeds.join(graph.nodes, "node", "left_anti").isEmpty(), "a seed is not a node of the graph")
    return _share(_walk(transition(graph, normalize), graph, seeds, alpha, tol, max_iter, method))


def _check_walk(alpha: float, max_iter: int, method: str) -> None:
    one_of(method, ("auto", "joins", "blocks", "copies"), "method")
    check(0 < alpha <= 1 and max_iter >= 0, "alpha must be in (0, 1] and max_iter not negative")


def random_walk(graph: Graph, seed: DataFrame, **how) -> DataFrame:
    """(node, val) for one seed vector (node, val)."""
    return diffuse(graph, seed.select("node", F.lit(0).alias("col"), "val"), **how).select("node", "val")


def node_features(graph: Graph, marks: DataFrame | None = None, k: int = 128, landmark_method: str = "degree", seed: int = 1, **how) -> DataFrame:
    """(node, pos, features): the walk's mass at each node from each landmark, in the landmarks' rank order; 0 where none arrives."""
    graph = settled(graph)
    given = marks is not None
    marks = written(marks if given else landmarks(graph, k, landmark_method, seed), "landmarks")
    check(not given or marks.join(graph.nodes, marks["landmark"] == graph.nodes["node"], "left_anti").isEmpty(), "a landmark is not a node of the graph")
    starts = marks.select(F.col("landmark").alias("node"), F.col("rank").alias("col"), F.lit(1.0).alias("val"))
    return spread_over(graph, starts, list(range(1, marks.count() + 1)), **how)


def set_seeds(graph: Graph, membership: DataFrame) -> DataFrame:
    """(node, col, val): each set's mass spread evenly on its members in the graph; sets without any have no column."""
    members = membership_contract(membership).select("set_id", F.col("gene").alias("node")).join(graph.nodes.select("node"), "node", "left_semi")
    return members.select("node", F.col("set_id").alias("col"), F.lit(1.0).alias("val"))


def set_features(graph: Graph, membership: DataFrame, marks: DataFrame, alpha: float = 0.5, tol: float = 1e-10, max_iter: int = 200, normalize: str = "col", method: str = "auto") -> DataFrame:
    """(set_id, features): the mass at each landmark of a walk from the set's members; null for a set without members in the graph.

    The mass at a landmark of the walk from a seed is the seed's product with the reversed walk from the landmark, and its total
    mass that with the reversed walk from all nodes. So one walk per landmark, and one more, serve any number of sets.
    """
    _check_walk(alpha, max_iter, method)
    graph = settled(graph)
    marks = written(marks, "landmarks")
    check(marks.join(graph.nodes, marks["landmark"] == graph.nodes["node"], "left_anti").isEmpty(), "a landmark is not a node of the graph")
    sets = membership.select(F.col("set_id").cast("string").alias("set_id")).where("set_id is not null").distinct()
    reversed_edges = transition(graph, normalize).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "x")
    starts = marks.select(F.col("landmark").alias("node"), F.col("rank").cast("int").alias("col"), F.lit(1.0).alias("val"))
    ones = graph.nodes.select("node", F.lit(0).alias("col"), F.lit(1.0).alias("val"))
    p = _walk(reversed_edges, graph, starts.unionByName(ones), alpha, tol, max_iter, method)
    members = set_seeds(graph, membership).select("node", F.col("col").alias("set_id"))
    sums = members.join(p, "node").groupBy("set_id", "col").agg(F.sum("val").alias("val"))
    by_rank = sums.groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("col", "val"))).alias("m"))
    full = F.transform(F.sequence(F.lit(1), F.lit(marks.count())), lambda r: F.coalesce(F.try_element_at("m", r), F.lit(0.0)) / F.col("m")[0])
    return sets.join(by_rank.select("set_id", full.alias("features")), "set_id", "left")
