"""Sets as diagonal Gaussians of their members' embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsets.contracts import check, embedding_contract, membership_contract, width

#: Members of a set, on average, up to which whole sets go to a task.
SMALL = 1000


def set_gaussians(embedding: DataFrame, membership: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(set_id, n, mu, var): mean and sample variance, at least eps, of each set's members in the embedding.

    A single member has variance eps everywhere; a set without members in the embedding keeps a row with nulls and n = 0.
    Repeated members count once; an empty membership gives no rows. Sets of at most SMALL members on average are shuffled as
    their members' vectors; of larger ones partial moments, one row per set, dimension and task.
    """
    vectors = embedding_contract(embedding)
    width(vectors, "vec")
    members = membership_contract(membership)
    sets = membership.select(F.col("set_id").cast("string").alias("set_id")).where("set_id is not null").distinct()
    size, number = members.agg(F.count(F.lit(1)), F.approx_count_distinct("set_id")).first()
    rows = members.join(vectors, "gene").select("set_id", "vec")
    if size <= SMALL * number:  # partial moments would be about as many rows, one for each dimension
        rows = rows.repartition("set_id")
    long = rows.select("set_id", F.posexplode("vec").alias("k", "x"))
    moments = long.groupBy("set_id", "k").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mu"), F.var_samp("x").alias("v"))
    floor = F.greatest(F.coalesce("v", F.lit(eps)), F.lit(eps))
    fitted = moments.groupBy("set_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "mu", floor.alias("var")))).alias("g"))
    arrays = fitted.select("set_id", "n", F.transform("g", lambda s: s["mu"]).alias("mu"), F.transform("g", lambda s: s["var"]).alias("var"))
    return sets.join(arrays, "set_id", "left").select("set_id", F.coalesce("n", F.lit(0)).alias("n"), "mu", "var")


def cluster_gaussians(embedding: DataFrame, clusters: DataFrame, eps: float = 1e-8, min_size: int = 2) -> DataFrame:
    """set_gaussians of the clusters with at least `min_size` members in the embedding; ValueError where none remains."""
    fitted = set_gaussians(embedding, clusters, eps).where(F.col("n") >= min_size)
    check(not fitted.isEmpty(), "no cluster has enough members in the embedding")
    return fitted
