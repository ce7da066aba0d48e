"""Gene to set scores, and concise versions of sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsets.contracts import check, embedding_contract, gaussian_contract, membership_contract, one_of
from netsets.functions.arrays import floored, gaussian_score
from netsets.operators.similarity import pairwise

SCORES = ("loglik", "neg_mahalanobis")
MODES = ("top_n", "softmax_mass", "quantile", "score_threshold")


def gene_set_scores(embedding: DataFrame, gaussians: DataFrame, score: str = "loglik", eps: float = 1e-8, membership: DataFrame | None = None) -> DataFrame:
    """(set_id, gene, pos, score) of every gene under every set's Gaussian, or of the sets' members alone where `membership` is given.

    loglik leaves out the constant of the dimensions. Sets without a Gaussian are left out. Restricted, the membership is joined
    first and the score is an expression of the row; unrestricted, it is a product of blocks. `pos` is the members' order, or
    the embedding's.
    """
    one_of(score, SCORES, "score")
    vectors = embedding_contract(embedding)
    sets = gaussian_contract(gaussians).where("mu is not null and var is not null")
    if membership is not None:
        members = membership_contract(membership)
        rows = members.join(vectors.select("gene", "vec"), "gene").join(sets, "set_id")
        value = gaussian_score(F.col("vec"), F.col("mu"), floored(F.col("var"), eps), score)
        return rows.select("set_id", "gene", F.col("gene_pos").alias("pos"), value.alias("score"))
    blocks = pairwise(vectors.select(F.col("gene").alias("id"), "vec"), sets.select(F.col("set_id").alias("id"), "mu", "var"), ["vec"], ["mu", "var"], score, eps)
    scored = blocks.select(F.col("id_2").alias("set_id"), F.col("id_1").alias("gene"), F.col("value").alias("score"))
    if "pos" not in embedding.columns:
        return scored.select("set_id", "gene", F.col("gene").alias("pos"), "score")
    return scored.join(vectors.select("gene", "pos"), "gene").select("set_id", "gene", "pos", "score")


def concise_sets(
    embedding: DataFrame,
    gaussians: DataFrame,
    membership: DataFrame | None = None,
    select: str = "top_n",
    top_n: int = 50,
    mass: float = 0.8,
    temperature: float = 1.0,
    quantile: float = 0.9,
    score_threshold: float | None = None,
    restrict_to_members: bool = True,
    min_size: int = 5,
    max_size: int = 500,
    score: str = "loglik",
    eps: float = 1e-8,
) -> DataFrame:
    """(set_id, gene, score, rank): each set's best genes by score, ties (to 9 decimals) by the candidates' order.

    How many: top_n; those until the softmax of scores / temperature holds `mass`; those at or above the set's `quantile`
    (linear interpolation) or `score_threshold`. The number is then raised to min_size, cut to max_size (for top_n the
    other way round) and to the candidates there are. Candidates are the members, or all genes where there is no membership
    or no restriction; sets without candidates or Gaussian give no rows. A mass counts as reached within 1e-12.
    """
    one_of(select, MODES, "select")
    check(0 < mass <= 1 and temperature > 0, "mass must be in (0, 1] and temperature positive")
    check(0 < quantile < 1, "quantile must be above 0 and below 1")
    check(select != "score_threshold" or score_threshold is not None, "score_threshold is missing")
    check(top_n >= 0 and min_size >= 0 and max_size >= 0, "sizes must not be negative")
    restricted = membership is not None and restrict_to_members
    scores = gene_set_scores(embedding, gaussians, score, eps, membership if restricted else None)
    if membership is not None and not restricted:
        scores = scores.join(membership.select(F.col("set_id").cast("string").alias("set_id")).distinct(), "set_id", "left_semi")
    order = Window.partitionBy("set_id").orderBy(F.round("score", 9).desc(), "pos")
    if select == "top_n":
        wanted = max(min(top_n, max_size), min_size)
        return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted).select("set_id", "gene", "score", "rank")
    ranked = scores.withColumn("rank", F.row_number().over(order))
    if select == "softmax_mass":
        top = scores.groupBy("set_id").agg(F.max("score").alias("top"))
        weight = F.exp((F.col("score") - F.col("top")) / temperature)
        weights = ranked.join(top, "set_id").withColumn("weight", weight)
        sums = weights.groupBy("set_id").agg(F.sum("weight").alias("total"))
        running = F.sum("weight").over(Window.partitionBy("set_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
        reached = weights.withColumn("running", running).join(sums, "set_id").where(F.col("running") >= (F.lit(mass) - 1e-12) * F.col("total"))
        ks = reached.groupBy("set_id").agg(F.min("rank").alias("k"))
    elif select == "quantile":
        cut = scores.groupBy("set_id").agg(F.percentile("score", quantile).alias("cut"))
        ks = scores.join(cut, "set_id").groupBy("set_id").agg(F.count_if(F.col("score") >= F.col("cut")).alias("k"))
    else:
        ks = scores.groupBy("set_id").agg(F.count_if(F.col("score") >= score_threshold).alias("k"))
    kept = F.least(F.greatest(F.col("k"), F.lit(min_size)), F.lit(max_size))
    return ranked.join(ks, "set_id").where(F.col("rank") <= kept).select("set_id", "gene", "score", "rank")
