"""Weighted graphs from edge lists: adjacency, transition weights, degrees, landmarks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsets.contracts import check, one_of, require
from netsets.functions.numbering import with_numbers
from netsets.session import written


@dataclass(frozen=True)
class Graph:
    """nodes(node, pos) and adjacency(src, dst, w) without zero weights; isolated nodes are in `nodes` alone.

    `numbered` tells that pos is 0, 1, 2, ... without gaps.
    """

    nodes: DataFrame
    adjacency: DataFrame
    numbered: bool = False


def build_graph(edges: DataFrame, node1: str = "node1", node2: str = "node2", weight: str | None = None, directed: bool = False, nodes: list[str] | DataFrame | None = None) -> Graph:
    """Sum repeated edges, symmetrise unless `directed`, drop zero sums.

    Ids become strings; a null weight counts as 0, without `weight` each row counts 1. Undirected, each row is counted in both
    directions, so a self-loop is doubled and an edge listed both ways has the sum. Rows with a null end are no edges. A node
    seen only on zero or null weights stays as an isolated node. Nodes are numbered in binary order of their ids; a given list
    (or a table node, pos) restricts and orders them instead. An empty table gives an empty graph.
    """
    slim = require(edges, *[c for c in (node1, node2, weight) if c])
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    rows = slim.select(F.col(node1).cast("string").alias("src"), F.col(node2).cast("string").alias("dst"), w.alias("w"))
    if nodes is None:
        ends = rows.select(F.explode(F.array("src", "dst")).alias("node")).where("node is not null").distinct()
        known = with_numbers(ends, ["node"], "nodes").withColumnRenamed("number", "pos")
    elif isinstance(nodes, DataFrame):
        known = require(nodes, "node", "pos")
    else:
        unique = list(dict.fromkeys(nodes))
        known = edges.sparkSession.createDataFrame(list(zip(unique, range(len(unique)))), "node string, pos long")
    used = rows.where("src is not null and dst is not null and w <> 0")
    if nodes is not None:
        used = used.join(known.select(F.col("node").alias("src")), "src", "left_semi").join(known.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", "w")
    if directed:
        adjacency = used.groupBy("src", "dst").agg(F.sum("w").alias("w")).where("w <> 0")
    else:
        # each pair is summed once and then given in both directions
        pairs = used.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w")).where("w <> 0")
        way = lambda src, dst, w: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), w.alias("w"))
        both = F.when(F.col("a") == F.col("b"), F.array(way("a", "b", 2 * F.col("w")))).otherwise(F.array(way("a", "b", F.col("w")), way("b", "a", F.col("w"))))
        adjacency = pairs.select(F.explode(both).alias("e")).select("e.*")
    return Graph(known, adjacency, not isinstance(nodes, DataFrame))


def from_adjacency(adjacency: DataFrame, nodes: DataFrame | None = None) -> Graph:
    """A graph from a weighted adjacency (src, dst, w), taken as it is: each row is one direction of an edge.

    ValueError for a null end, a null, negative, NaN or infinite weight, an edge listed twice, or an end that is not among the
    given `nodes` (node, pos). Zero weights are dropped, their ends stay as nodes.
    """
    slim = require(adjacency, "src", "dst", "w")
    rows = written(slim.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("w").cast("double").alias("w")), "adjacency")
    check(rows.where("src is null or dst is null").isEmpty(), "an edge has a null end")
    check(rows.where("w is null or isnan(w) or w < 0 or w = double('inf')").isEmpty(), "weights must be finite and not negative")
    check(rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty(), "an edge is listed twice")
    ends = rows.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    if nodes is None:
        known = with_numbers(ends, ["node"], "nodes").withColumnRenamed("number", "pos")
    else:
        known = require(nodes, "node", "pos")
        check(ends.join(known, "node", "left_anti").isEmpty(), "an end of an edge is not among the nodes")
    return Graph(known, rows.where("w <> 0"), nodes is None)


def settled(graph: Graph) -> Graph:
    """The graph with its adjacency written, so that it is made once."""
    if getattr(graph.adjacency, "_written_at", None):
        return graph
    return Graph(graph.nodes, written(graph.adjacency, "adjacency"), graph.numbered)


def transition(graph: Graph, normalize: str = "col", eps: float = 1e-12) -> DataFrame:
    """(src, dst, x): weights divided by their column's (dst) or row's (src) sum, which counts as eps at least."""
    by = {"col": "dst", "row": "src"}[one_of(normalize, ("col", "row"), "normalize")]
    sums = graph.adjacency.groupBy(by).agg(F.greatest(F.sum("w"), F.lit(eps)).alias("total"))
    return graph.adjacency.join(sums, by).select("src", "dst", (F.col("w") / F.col("total")).alias("x"))


def degrees(graph: Graph, weighted: bool = False) -> DataFrame:
    """(node, pos, degree) of all nodes: number or summed weight of the edges leaving each; 0 for an isolated one."""
    own = graph.adjacency.groupBy("src").agg((F.sum("w") if weighted else F.count(F.lit(1)).cast("double")).alias("degree"))
    return graph.nodes.join(own, graph.nodes["node"] == own["src"], "left").select("node", "pos", F.coalesce("degree", F.lit(0.0)).alias("degree"))


def landmarks(graph: Graph, k: int = 128, method: str = "degree", seed: int = 1) -> DataFrame:
    """(landmark, rank from 1): the k nodes of highest unweighted degree, ties by node order; or k nodes drawn by a seeded hash."""
    one_of(method, ("degree", "random"), "method")
    check(k >= 1, "k must be at least 1")
    if method == "degree":
        top = degrees(graph).orderBy(F.col("degree").desc(), "pos").limit(k).select((-F.col("degree")).alias("a"), F.col("pos").alias("b"), "node")
    else:
        draw = F.md5(F.concat_ws("|", F.lit(str(seed)), "node"))
        top = graph.nodes.withColumn("a", draw).orderBy("a", "pos").limit(k).select("a", F.col("pos").alias("b"), "node")
    # k rows, gathered for their ranks
    ranked = top.agg(F.array_sort(F.collect_list(F.struct("a", "b", "node"))).alias("l")).select(F.posexplode("l"))
    return ranked.select(F.col("col.node").alias("landmark"), (F.col("pos") + 1).alias("rank"))
