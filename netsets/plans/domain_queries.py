"""Queries of the same operators on the interaction network, its gene sets, their fitted model and the genes' statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsets.operators import concise, diffusion, enrichment, graph, similarity
from netsets.plans.model import fit
from netsets.plans.model_queries import r
from netsets.sources.tables import folded, number_in, table

DIM = 64


def _usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == DIM) & ~bad & F.exists(vector, lambda x: x != 0)


def gene_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(gene, vec): the vector of each gene's first usable record."""
    rows = table(spark, d, "gsemb_embedding").where(F.col("kind") == "gene").where(_usable(F.col("gene_embedding")))
    first = rows.groupBy(F.col("name").alias("gene")).agg(F.min_by("gene_embedding", "item_id").alias("vec"))
    return first.select("gene", F.col("vec").cast("array<double>").alias("vec"))


def set_models(spark: SparkSession, d: str) -> DataFrame:
    """(set_id, mu, var) of the sets whose record has a usable mean and variance."""
    rows = table(spark, d, "gsemb_embedding").where(F.col("kind") == "set").where(_usable(F.col("set_mu")) & _usable(F.col("set_var")))
    first = rows.groupBy(F.col("name").alias("set_id")).agg(F.min_by(F.struct("set_mu", "set_var"), "item_id").alias("g"))
    return first.select("set_id", F.col("g.set_mu").cast("array<double>").alias("mu"), F.col("g.set_var").cast("array<double>").alias("var"))


def members(spark: SparkSession, d: str) -> DataFrame:
    """(set_id, gene): the members of the highest revision of each set, trimmed and upper-cased."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform("gene_sets", lambda x: F.upper(F.trim(x))), lambda x: x.isNotNull() & (x != ""))))
    rows = table(spark, d, "gene_sets").where("set_id is not null").groupBy("set_id").agg(F.max(F.struct("revision", clean.alias("m")))["m"].alias("m"))
    return rows.select("set_id", F.explode("m").alias("gene"))


def statistics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gene_stats").where("stat is not null").select("gene", "stat")


def hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gene_stats").where("y is not null").select("gene", "y")


def interactions(spark: SparkSession, d: str) -> DataFrame:
    """(node1, node2, weight): folded names, null where blank, and the weight, or the number in its text where the loader read none."""
    name = lambda c: F.nullif(folded(F.col(c)), F.lit("")).alias(c)
    return table(spark, d, "ppi").select(name("node1"), name("node2"), F.coalesce("weight", number_in(F.col("weight_text"))).alias("weight"))


def network(spark: SparkSession, d: str) -> graph.Graph:
    return graph.build_graph(interactions(spark, d), weight="weight")


def _folded_members(spark: SparkSession, d: str) -> DataFrame:
    return members(spark, d).select("set_id", folded(F.col("gene")).alias("gene")).where("gene <> ''").distinct()


# queries

def net_walk(spark, d):
    """Walks from the 16 nodes of highest degree to the fixed point: each node's largest and total mass."""
    f = diffusion.node_features(network(spark, d), k=16)
    return f.select("node", F.array_max("features").alias("most"), F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("mass")).select("node", r("most"), r("mass"))


def net_walk_grid(spark, d):
    """The same by the grid of edge blocks."""
    f = diffusion.node_features(network(spark, d), k=16, method="joins")
    return f.select("node", F.array_max("features").alias("most"), F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("mass")).select("node", r("most"), r("mass"))


def net_random_walk(spark, d):
    """The walk from the node of highest degree."""
    g = graph.settled(network(spark, d))
    start = graph.landmarks(g, 1).select(F.col("landmark").alias("node"), F.lit(2.0).alias("val"))
    return diffusion.random_walk(g, start).select("node", r("val"))


def net_set_features(spark, d):
    """What a walk from each set's members brings to the four nodes of highest degree."""
    g = graph.settled(network(spark, d))
    f = diffusion.set_features(g, _folded_members(spark, d), graph.landmarks(g, 4)).where("features is not null")
    return f.select("set_id", F.posexplode("features").alias("rank", "val")).select("set_id", (F.col("rank") + 1).alias("rank"), r("val"))


def net_fit_svd(spark, d):
    """Graph, walks, full-rank SVD and Gaussians: each set's size, the length of its mean and its total variance, whatever the signs."""
    m = fit(interactions(spark, d), _folded_members(spark, d), weight="weight", dim=8, k=8)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    length = F.sqrt(total(F.transform("mu", lambda x: x * x)))
    return m.gaussians.where("mu is not null").select("set_id", "n", length.alias("length"), total(F.col("var")).alias("spread")).select("set_id", "n", r("length", 5), r("spread", 5))


def net_fit_autoencoder(spark, d):
    """The autoencoder with its defaults on the network's walks: the losses, the lowest possible one, and the features' variance."""
    return fit(interactions(spark, d), _folded_members(spark, d), weight="weight", method="autoencoder", dim=16, k=32).losses


def net_fit_joint(spark, d):
    """Three epochs of the joint training on the network and its sets: the losses."""
    return fit(interactions(spark, d), _folded_members(spark, d), weight="weight", method="joint", k=16, dim=8, epochs=3, lr=1e-2).losses


def net_closest_sets(spark, d):
    """The five closest sets of each set's fitted Gaussian."""
    return similarity.closest_sets(set_models(spark, d), 5).select("set_1", "set_2", r("distance"), "rank")


def net_mean_cosine(spark, d):
    """Each gene's mean similarity to all genes."""
    return similarity.mean_cosine(gene_vectors(spark, d)).select("gene", r("mean"), "n")


def _concise(**how):
    def query(spark, d):
        return concise.concise_sets(gene_vectors(spark, d), set_models(spark, d), members(spark, d), **how).select("set_id", "gene", "rank")

    return query


def _tested(test, data, **how):
    def query(spark, d):
        out = test(data(spark, d), gene_vectors(spark, d), set_models(spark, d), members(spark, d), restrict_to_members=True, temperature=8.0, top_genes=0, **how)
        return out.select("ID", r("ES", 4), r("z", 4), r("pvalue"), r("p_adjust"), "setSize")

    return query


QUERIES = {
    **{f.__name__: f for f in (net_walk, net_walk_grid, net_random_walk, net_set_features, net_fit_svd, net_fit_autoencoder, net_fit_joint, net_closest_sets, net_mean_cosine)},
    "net_concise_top_n": _concise(top_n=20, score="neg_mahalanobis"),
    "net_concise_mass": _concise(select="softmax_mass", temperature=8.0),
    "net_gsea": _tested(enrichment.gsea, statistics, nperm=100),
    "net_ora": _tested(enrichment.ora, hits, nperm=100, alternative="greater"),
}
