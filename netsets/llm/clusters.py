"""Grouping records into clusters of mutually similar records: power-iteration spectral clustering.

The affinities are the cosines of linked records, found by multi-index hashing and kept sparse. They are normalised by the records'
total affinity, and several distributed random vectors are iterated with them: within a cluster the values run together, while
clusters stay apart. The values are the records' embedding, which k-means clusters from grid seeds: its clusters are the groups.
An exact check of the clusters against the links follows: a cluster whose members aren't connected, or that a link leaves, is
repaired by the links, and its records are marked so that the share of repaired groups can be seen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsets.llm import vectors
from netsets.session import discard, written

#: Iterations of the vectors, and their number.
ROUNDS, VECTORS = 7, 4
#: Cells of the seed grid along each axis of the embedding; a point this near to a border, in cells, also looks at the next cell.
GRID, BORDER = 1024, 0.125
#: Links of a record that one batch of pairs passes on, beside those that keep what it connects connected.
LINKS = 24


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all that the edges (a, b) of the nodes 0..n-1 connect, and each node's component."""
    label, live, kept = np.arange(n), np.arange(len(a)), [np.empty(0, np.int64)]
    while len(live := live[label[a[live]] != label[b[live]]]):
        one, two = label[a[live]], label[b[live]]
        first = np.full(n, len(a))
        np.minimum.at(first, one, live)
        np.minimum.at(first, two, live)
        picked = np.unique(first[first < len(a)])
        kept.append(picked)
        one, two = label[a[picked]], label[b[picked]]
        parent = np.arange(n)
        np.minimum.at(parent, np.maximum(one, two), np.minimum(one, two))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
    return np.concatenate(kept), label


def _sparse(most: int):
    """Affinities of a batch of pairs, sparsified: `most` pairs of each record by hash, and what keeps connected records connected.

    Rows with a = b hold a record's total affinity over all its pairs of the batch.
    """

    def keep(low: np.ndarray, high: np.ndarray, cos: np.ndarray, off: np.ndarray, threshold: float) -> pa.RecordBatch:
        sure = cos - off >= threshold
        ids, at = np.unique(np.r_[low, high], return_inverse=True)
        a, b = at[: len(low)], at[len(low) :]
        total = np.bincount(at, np.r_[cos, cos], len(ids))
        draw = (low * np.int64(-7046029254386353131) ^ high * np.int64(-4417276706812531889)) * np.int64(1609587929392839161)
        order = np.lexsort((np.r_[draw, draw], at))
        starts = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        wanted = np.zeros(len(low), bool)
        wanted[order[place < most] % len(low)] = True
        known = np.flatnonzero(sure)
        tree, label = _forest(a[known], b[known], len(ids))
        wanted[known[tree]] = True
        wanted |= ~sure & (label[a] != label[b])
        empty = np.ones(len(ids), bool)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[x, y]) for x, y in ((low[wanted], ids), (high[wanted], ids), (cos[wanted], total), (sure[wanted], empty))], names=["a", "b", "affinity", "sure"]
        )

    return keep


def links(distinct: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(a, b, affinity) of pairs of distinct vectors with a cosine of at least `threshold`, and (item_id, internal), each record's total.

    The links are sparse, but connect all records that pairs above the threshold connect; doubtful ones are decided by their float
    vectors. The totals are over all pairs, by their 16-bit vectors.
    """
    counts = {r["kind"]: r["n"] for r in distinct.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per kind
    schema = "a long, b long, affinity double, sure boolean"
    if not counts:
        met = distinct.sparkSession.createDataFrame([], schema)
    else:
        codes = {kind: vectors.learn(distinct.where(F.col("kind") == kind), n, threshold) for kind, n in counts.items()}
        met = written(vectors.meetings(distinct, codes, threshold, _sparse(LINKS), schema), "links")
    exact = vectors.exact_cosines(met.where("not sure"), distinct).where(F.col("cos") >= threshold)
    totals = met.where("a = b").groupBy(F.col("a").alias("item_id")).agg(F.sum("affinity").alias("internal"))
    return met.where("sure and a <> b").select("a", "b", "affinity").unionByName(exact.select("a", "b", F.col("cos").alias("affinity"))), totals


def _iterate(around: DataFrame, start: DataFrame) -> DataFrame:
    """(item_id, low, x_0, ...): ROUNDS steps of the affinity-weighted mean over each record and its links, and the lowest id met on the way.

    `around` (src, dst, affinity) has each link in both directions and each record with itself.
    """
    values = start
    names = [f"x_{i}" for i in range(VECTORS)]
    for _ in range(ROUNDS):
        step = around.join(values.hint("shuffle_hash"), around["dst"] == values["item_id"]).groupBy("src")
        values = step.agg(F.min("low").alias("low"), *[(F.sum(F.col("affinity") * F.col(x)) / F.sum("affinity")).alias(x) for x in names])
        values = values.withColumnRenamed("src", "item_id")
    return values


def _cell(axes: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for c in axes:
        out = out * (GRID * 2) + c
    return out


def _k_means(points: DataFrame, rounds: int = 2) -> DataFrame:
    """(item_id, centre) of (item_id, x_0, ...): k-means seeded with the means of the occupied grid cells.

    A centre is sought in a point's cell and in those whose border is near. Centres within a quarter of a cell of a point are
    as near as each other and the lowest is taken, so a cluster much tighter than a cell takes one centre even on a border.
    """
    names = [f"x_{i}" for i in range(VECTORS)]
    scaled = [F.col(x) * GRID for x in names]
    at = [F.floor(y).cast("long") for y in scaled]
    placed = points.withColumn("cell", _cell(at))
    means = [F.avg(x).alias(f"c_{x}") for x in names]
    centres = placed.groupBy(F.col("cell").alias("centre")).agg(*means)
    around = placed
    for i, (y, c) in enumerate(zip(scaled, at)):
        near = F.when(y - c < BORDER, F.array(c, c - 1)).when(y - c > 1 - BORDER, F.array(c, c + 1)).otherwise(F.array(c))
        around = around.withColumn(f"at_{i}", F.explode(near))
    around = around.select("item_id", *names, _cell([F.col(f"at_{i}") for i in range(VECTORS)]).alias("centre"))
    far = sum(((F.col(x) - F.col(f"c_{x}")) * (F.col(x) - F.col(f"c_{x}")) for x in names), F.lit(0.0))
    for step in range(rounds):
        nearest = around.join(centres, "centre").groupBy("item_id").agg(F.min(F.struct(F.floor(far * (16 * GRID * GRID)).alias("far"), "centre"))["centre"].alias("centre"))
        if step < rounds - 1:
            centres = nearest.join(points, "item_id").groupBy("centre").agg(*means)
    return nearest


def _joined(pairs: DataFrame) -> DataFrame:
    """(label, root) of the connected labels of (a, b): lowest label reached, doubling the reach in each round."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "label-links")
    roots = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("label"), "root"), "roots")
    while True:
        of_b = roots.select(F.col("label").alias("b"), F.col("root").alias("root_b"))
        reach = both.join(of_b, "b").groupBy("a").agg(F.min("root_b").alias("low"))
        lower = roots.join(reach, roots["label"] == reach["a"]).select("label", F.least("root", "low").alias("next"))
        hop = roots.select(F.col("label").alias("next"), F.col("root").alias("beyond"))
        new = written(lower.join(hop, "next").select("label", F.least("next", "beyond").alias("root")), "roots")
        changed = new.join(roots.withColumnRenamed("root", "before"), "label").where("root <> before").isEmpty()
        discard(roots)
        roots = new
        if changed:
            discard(both)
            return roots


def _checked(clustered: DataFrame, found: DataFrame) -> DataFrame:
    """(item_id, root, repaired): the k-means clusters (item_id, low, centre) as groups where the links bear them out, and repaired ones.

    `low` is the lowest id met over a record's links, so members with one `low` are connected. A cluster with several, or with a
    link to another cluster, is repaired: its records go by `low`, and what links join is one group.
    """
    one = clustered.select(F.col("item_id").alias("a"), F.col("low").alias("low_a"), F.col("centre").alias("centre_a"))
    two = clustered.select(F.col("item_id").alias("b"), F.col("low").alias("low_b"), F.col("centre").alias("centre_b"))
    differing = written(found.select("a", "b").join(one, "a").join(two, "b").where("low_a <> low_b or centre_a <> centre_b").select("low_a", "low_b", "centre_a", "centre_b").distinct(), "crossing")
    lows = clustered.groupBy("centre").agg(F.min("low").alias("root"), (F.min("low") != F.max("low")).alias("several"))
    left = differing.where("centre_a <> centre_b").select(F.explode(F.array("centre_a", "centre_b")).alias("centre")).distinct().withColumn("left", F.lit(True))
    judged = lows.join(left, "centre", "left").select("centre", "root", (F.col("several") | F.coalesce("left", F.lit(False))).alias("repaired"))
    groups = clustered.join(judged, "centre")
    crossing = differing.where("low_a <> low_b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b")).distinct()
    if crossing.isEmpty():
        return groups.select("item_id", F.when(F.col("repaired"), F.col("low")).otherwise(F.col("root")).alias("root"), "repaired")
    joined = _joined(crossing).select(F.col("label").alias("low"), F.col("root").alias("joined"))
    return groups.join(joined, "low", "left").select("item_id", F.when(F.col("repaired"), F.coalesce("joined", "low")).otherwise(F.col("root")).alias("root"), "repaired")


def clusters(rows: DataFrame, threshold: float = 0.85, seed: int = 11) -> DataFrame:
    """(root, kind, item_id, internal, repaired): the members of each group of the records (kind, item_id, vec); `root` names the group.

    Two records of one kind are linked at a cosine of at least `threshold`; a group is a connected set of records. `internal` is
    a member's total affinity inside its group; `repaired` tells the groups that the check had to mend. Records of no group, with
    unusable vectors, null ids or null kinds are left out; an empty table gives no rows. Equal vectors are compared once and come
    back as members. A group may have two members only.
    """
    good = rows.select("kind", F.col("item_id").cast("long").alias("item_id"), "vec").where(vectors.usable(F.col("vec")) & F.col("item_id").isNotNull() & F.col("kind").isNotNull())
    distinct = written(vectors.distinct_vectors(good), "distinct-vectors")
    found, totals = links(distinct, threshold)
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("p")
    alone = totals.select(F.col("item_id").alias("src"), F.col("item_id").alias("dst"), F.lit(1.0).alias("affinity"))
    around = written(found.select(ends, "affinity").select("p.src", "p.dst", "affinity").unionByName(alone), "affinities")
    random = [((F.pmod(F.xxhash64("dst", F.lit(seed + i)), F.lit(1 << 40)) + 0.5) / float(1 << 40)).alias(f"x_{i}") for i in range(VECTORS)]
    start = around.where("src = dst").select(F.col("dst").alias("item_id"), F.col("dst").alias("low"), *random)
    points = written(_iterate(around, start), "embedding")
    centres = _k_means(points)
    clustered = written(points.select("item_id", "low").join(centres, "item_id"), "k-means")
    grouped = _checked(clustered, around.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))).join(totals, "item_id")
    repeated = distinct.where("copies > 1").select("kind", "digest_1", "digest_2", F.col("item_id").alias("head"), "copies")
    digests = [F.col("kind"), F.xxhash64("vec").alias("digest_1"), F.xxhash64(F.lit(17), "vec").alias("digest_2")]
    copies = good.select(*digests, "item_id").join(repeated, ["kind", "digest_1", "digest_2"]).select("head", "item_id", "copies")
    return _members(distinct, grouped, copies)


def _members(distinct: DataFrame, grouped: DataFrame, copies: DataFrame) -> DataFrame:
    """Every record of a group: a distinct vector's record, and the copies of it."""
    known = distinct.select("item_id", "copies", "kind").join(grouped, "item_id", "left").where("root is not null or copies > 1")
    internal = F.coalesce("internal", F.lit(0.0)) + F.col("copies") - 1
    roots = known.select(F.col("item_id").alias("head"), "kind", F.coalesce("root", "item_id").alias("root"), internal.alias("internal"), "copies", F.coalesce("repaired", F.lit(False)).alias("repaired"))
    single = roots.where("copies = 1").select("root", "kind", F.col("head").alias("item_id"), "internal", "repaired")
    many = roots.where("copies > 1").select("root", "kind", "head", "internal", "repaired").join(copies.select("head", "item_id"), "head").select("root", "kind", "item_id", "internal", "repaired")
    return written(single.unionByName(many), "members")


def described(members: DataFrame, least: int = 3, typical: int = 3) -> DataFrame:
    """(head_item_id, kind, size, typical, internal, repaired): groups of at least `least` records with their most typical ones.

    The head is the lowest id; typical members are ranked by their affinity inside the group, ties by the lower id; `internal`
    is the best one's. `repaired` tells the groups that k-means alone did not give.
    """
    sizes = members.groupBy("root").agg(F.min("item_id").alias("head_item_id"), F.first("kind").alias("kind"), F.count(F.lit(1)).alias("size"), F.max("repaired").alias("repaired")).where(F.col("size") >= least)
    order = Window.partitionBy("root").orderBy(F.col("internal").desc(), "item_id")
    best = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= typical)
    lists = best.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("place", "item_id"))).alias("t"), F.max("internal").alias("internal"))
    return sizes.join(lists, "root").select("head_item_id", "kind", "size", F.transform("t", lambda s: s["item_id"]).alias("typical"), "internal", "repaired")


def grouped_pairs(members: DataFrame, least: int = 3) -> DataFrame:
    """(head_item_id, item_id) of every member but the head of the groups of at least `least` records."""
    sizes = members.groupBy("root").agg(F.min("item_id").alias("head_item_id"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return members.join(sizes, "root").where("item_id > head_item_id").select("head_item_id", "item_id")
