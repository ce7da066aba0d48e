"""Most similar vectors for every vector, by multi-index hashing and a rerank with the float vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsets.llm import vectors
from netsets.session import written


def _best(k: int):
    """Both directions of the pairs of a batch: of each row what may be among its k best, as far as 16-bit cosines tell."""

    def keep(low: np.ndarray, high: np.ndarray, cos: np.ndarray, off: np.ndarray, threshold: float) -> pa.RecordBatch:
        src, dst, c, o = np.r_[low, high], np.r_[high, low], np.r_[cos, cos], np.r_[off, off]
        order = np.lexsort((o - c, src))
        src, dst, c, o = src[order], dst[order], c[order], o[order]
        starts = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
        sizes = np.diff(np.r_[starts, len(src)])
        # k rows are surely at least as similar as the k-th best lower bound
        kth = np.where(sizes >= k, (c - o)[np.minimum(starts + k - 1, len(c) - 1)], -2)
        near = c + o >= np.repeat(kth, sizes)
        return pa.RecordBatch.from_arrays([pa.array(x[near]) for x in (src, dst, c - o, c + o)], names=["src", "dst", "least", "most"])

    return keep


def nearest(rows: DataFrame, k: int = 5, threshold: float = 0.85) -> DataFrame:
    """(item_id, neighbour_id, cos, rank): the k most similar other vectors of each vector of (kind, item_id, vec), of the same kind.

    Only pairs with a cosine, rounded to 6 decimals, of at least `threshold` are given; equal values are ranked by the lower id.
    Unusable vectors (see vectors.usable) have no neighbours and are none; equal vectors under several ids are compared once and
    are each other's neighbours with cosine 1. Ids must be unique and not null (rows without an id are left out). Which pairs
    meet in the index is a matter of accuracy: recall is measured in the tests, values and ranks of the pairs found are exact, as
    every pair whose 16-bit cosine and its largest error leave room for one of the k places is decided by the float vectors.
    """
    good = rows.select("kind", F.col("item_id").cast("long").alias("item_id"), "vec").where(vectors.usable(F.col("vec")) & F.col("item_id").isNotNull() & F.col("kind").isNotNull())
    distinct = written(vectors.distinct_vectors(good), "distinct-vectors")
    counts = {r["kind"]: r["n"] for r in distinct.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per kind
    codes = {kind: vectors.learn(distinct.where(F.col("kind") == kind), n, threshold) for kind, n in counts.items()}
    repeated = distinct.where("copies > 1").select("kind", "digest_1", "digest_2", F.col("item_id").alias("head"))
    digests = [F.col("kind"), F.xxhash64("vec").alias("digest_1"), F.xxhash64(F.lit(17), "vec").alias("digest_2")]
    members = written(good.select(*digests, "item_id").join(repeated, ["kind", "digest_1", "digest_2"]).select("head", "item_id"), "copies-of-vectors")
    lowest = members.withColumn("place", F.row_number().over(Window.partitionBy("head").orderBy("item_id"))).where(F.col("place") <= k + 1).select("head", F.col("item_id").alias("copy_id"))
    if codes:
        met = vectors.meetings(distinct, codes, threshold, _best(k), "src long, dst long, least double, most double")
        ranked = met.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.col("least").desc())))
        kth = F.max(F.when(F.col("place") == k, F.col("least"))).over(Window.partitionBy("src"))
        near = ranked.withColumn("kth", kth).where(F.col("kth").isNull() | (F.col("most") >= F.col("kth")))
        pairs = near.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    else:
        pairs = distinct.select(F.col("item_id").alias("a"), F.col("item_id").alias("b")).where("false")
    exact = written(vectors.exact_cosines(pairs, distinct).where(F.col("cos") >= threshold), "exact-pairs")
    both = exact.select(F.col("a").alias("head"), F.col("b").alias("other"), "cos").unionByName(exact.select(F.col("b").alias("head"), F.col("a").alias("other"), "cos"))
    # a class of equal vectors stands for its k + 1 lowest ids, for others and for itself
    expanded = both.join(lowest.withColumnRenamed("head", "other"), "other", "left").select("head", F.coalesce("copy_id", "other").alias("neighbour_id"), "cos")
    own = lowest.select("head", F.col("copy_id").alias("neighbour_id"), F.lit(1.0).alias("cos"))
    order = [F.col("cos").desc(), F.col("neighbour_id")]
    lists = expanded.unionByName(own).withColumn("place", F.row_number().over(Window.partitionBy("head").orderBy(*order))).where(F.col("place") <= k + 1).drop("place")
    asked = distinct.where("copies = 1").select(F.col("item_id").alias("head"), "item_id").unionByName(members)
    answers = lists.join(asked, "head").where("item_id <> neighbour_id")
    return answers.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k).select("item_id", "neighbour_id", "cos", "rank")
