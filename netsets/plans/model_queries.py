"""Queries of the graph, embedding, similarity, concise-set and enrichment operators on the star-schema tables.

Roles: entities are the vectors of `embeddings` ('P' and the id, in the order of the ids), their sets the labels, their
statistics the parts' prices; the weighted graph joins parts and suppliers by quantity, the small directed one the nations that
trade. Doubles are rounded where they leave a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsets.operators import concise, diffusion, enrichment, gaussians, graph, similarity
from netsets.operators.embedding import autoencoder_embedding, svd_embedding
from netsets.plans.model import SetEmbedding, fit
from netsets.sources.tables import table
from netsets.streaming.scoring import stream_scores


def r(name: str, digits: int = 6, alias: str | None = None):
    return (F.round(F.col(f"`{name}`"), digits) + F.lit(0.0)).alias(alias or name)


def part_id(name: str):
    return F.concat(F.lit("P"), F.col(name).cast("string"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(part_id("vec_id").alias("gene"), F.col("vec_id").alias("pos"), F.col("embedding").cast("array<double>").alias("vec"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").cast("string").alias("set_id"), part_id("vec_id").alias("gene"), F.col("vec_id").alias("gene_pos"))


def prices(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(part_id("p_partkey").alias("gene"), F.col("p_partkey").alias("pos"), F.col("p_retailprice").alias("stat"))


def large_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(part_id("p_partkey").alias("gene"), F.col("p_partkey").alias("pos"), F.when(F.col("p_size") > 25, 1.0).otherwise(0.0).alias("y"))


def supply_edges(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return lines.select(part_id("l_partkey").alias("node1"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("node2"), "l_quantity")


def supply(spark: SparkSession, d: str) -> graph.Graph:
    return graph.build_graph(supply_edges(spark, d), weight="l_quantity")


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    buyers = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("node1"))
    sellers = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("node2"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select("node1", "node2", "l_quantity")


def trade(spark: SparkSession, d: str, directed: bool = True) -> graph.Graph:
    return graph.build_graph(trade_edges(spark, d), weight="l_quantity", directed=directed)


def regions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("set_id"), F.col("n_nationkey").cast("string").alias("gene"))


def fitted(spark: SparkSession, d: str) -> DataFrame:
    return gaussians.set_gaussians(vectors(spark, d), labels(spark, d))


# graphs

def graph_undirected(spark, d):
    return supply(spark, d).adjacency


def graph_directed(spark, d):
    return trade(spark, d).adjacency


def graph_self_loops(spark, d):
    return trade(spark, d, directed=False).adjacency.where("src = dst")


def graph_nodes_subset(spark, d):
    """The supply graph among the parts of one brand and all suppliers."""
    parts = table(spark, d, "part").where("p_brand = 'Brand#11'").select(part_id("p_partkey").alias("node"), F.col("p_partkey").alias("pos"))
    sellers = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"), F.col("s_suppkey").alias("pos"))
    return graph.build_graph(supply_edges(spark, d), weight="l_quantity", nodes=parts.unionByName(sellers)).adjacency


def transition_col(spark, d):
    return graph.transition(trade(spark, d), "col").select("src", "dst", r("x"))


def transition_row(spark, d):
    return graph.transition(trade(spark, d), "row").select("src", "dst", r("x"))


def degree_unweighted(spark, d):
    return graph.degrees(supply(spark, d)).select("node", "degree")


def degree_weighted(spark, d):
    return graph.degrees(supply(spark, d), weighted=True).select("node", "degree")


def landmarks_degree(spark, d):
    return graph.landmarks(supply(spark, d), 16)


def landmarks_random(spark, d):
    return graph.landmarks(supply(spark, d), 16, "random", seed=1)


# walks

WALK = {"tol": 0.0, "max_iter": 5}


def walk_steps(spark, d):
    """Five steps of the walk from each region's nations, by joins."""
    g = trade(spark, d)
    return diffusion.diffuse(g, diffusion.set_seeds(g, regions(spark, d)), method="joins", **WALK).select("node", "col", r("val"))


def walk_blocks(spark, d):
    """The same walk by blocks."""
    g = trade(spark, d)
    return diffusion.diffuse(g, diffusion.set_seeds(g, regions(spark, d)), method="blocks", **WALK).select("node", "col", r("val"))


def node_features(spark, d):
    f = diffusion.node_features(trade(spark, d), k=4, **WALK)
    return f.select("node", F.posexplode("features").alias("rank", "val")).select("node", (F.col("rank") + 1).alias("rank"), r("val"))


def set_features(spark, d):
    g = trade(spark, d)
    f = diffusion.set_features(g, regions(spark, d), graph.landmarks(g, 4), **WALK)
    return f.select("set_id", F.posexplode("features").alias("rank", "val")).select("set_id", (F.col("rank") + 1).alias("rank"), r("val"))


def walk_converged(spark, d):
    """Landmark walks on the supply graph to the fixed point."""
    f = diffusion.node_features(supply(spark, d), k=16)
    return f.select("node", F.array_max("features").alias("most"), F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("mass")).select("node", r("most"), r("mass"))


def svd_gram(spark, d):
    """Inner products of the full-rank embedding: those of the centred features, whatever the signs."""
    e = svd_embedding(diffusion.node_features(trade(spark, d), k=4, **WALK), 4).select("gene", F.posexplode("vec").alias("k", "x"))
    two = e.select(F.col("gene").alias("gene_2"), "k", F.col("x").alias("y"))
    return e.withColumnRenamed("gene", "gene_1").join(two, "k").groupBy("gene_1", "gene_2").agg(F.round(F.sum(F.col("x") * F.col("y")), 8).alias("product")).select("gene_1", "gene_2", (F.col("product") + 0.0).alias("product"))


# Gaussians, similarities, distances

def set_gaussians(spark, d):
    return fitted(spark, d).select("set_id", F.posexplode(F.arrays_zip("mu", "var")).alias("k", "g")).select("set_id", "k", F.round("g.mu", 6).alias("mu"), F.round("g.var", 6).alias("var"))


def gaussians_edge_cases(spark, d):
    """Sets of one vector each, and a set of suppliers, which have no vectors."""
    single = labels(spark, d).groupBy("set_id").agg(F.min_by("gene", "gene_pos").alias("gene"))
    none = table(spark, d, "supplier").select(F.lit("suppliers").alias("set_id"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("gene"))
    g = gaussians.set_gaussians(vectors(spark, d), single.unionByName(none))
    return g.select("set_id", F.col("n").cast("int"), F.round(F.col("mu")[0], 6).alias("mu_0"), F.col("var")[0].alias("var_0"))


def cosine_top(spark, d):
    return similarity.cosine_top(vectors(spark, d), 10).select("gene_1", "gene_2", r("similarity"), "rank")


def cosine_subset(spark, d):
    """The entities of label 0 against those of labels 1 and 2, one of them asked for twice, beside an unknown one."""
    of = lambda *which: [x["gene"] for x in labels(spark, d).where(F.col("set_id").isin(*which)).select("gene").collect()]
    return similarity.cosine(vectors(spark, d), genes=of("0"), other_genes=of("1", "2") + of("1")[:1] + ["unknown"]).select("gene_1", "gene_2", r("similarity"))


def cosine_mean(spark, d):
    """Each entity's mean similarity to all."""
    return similarity.mean_cosine(vectors(spark, d)).select(F.col("gene").alias("gene_1"), r("mean"), "n")


def all_similarities(spark, d):
    """The three tables of similarities of a fitted model, one below the other."""
    m = SetEmbedding(trade(spark, d), "svd", vectors(spark, d), fitted(spark, d), vectors(spark, d))
    parts = [t.toDF("id_1", "id_2", "value").withColumn("what", F.lit(what)) for what, t in m.all_similarities().items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("what", "id_1", "id_2", r("value", 4))


def wide_embedding(spark, d):
    """A table with a column for each dimension as an embedding: the squared length of each vector."""
    wide = table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].alias(f"d{i}") for i in range(8)])
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    return similarity.as_embedding(wide, "vec_id").select("gene", square.alias("square")).select("gene", r("square"))


def _distance(metric):
    def query(spark, d):
        return similarity.set_distance(fitted(spark, d), metric=metric).select("set_1", "set_2", r("distance", 4))

    return query


def closest_sets(spark, d):
    """The ten closest pairs of sets."""
    pairs = similarity.set_distance(fitted(spark, d)).where("set_1 < set_2").select("set_1", "set_2", r("distance"))
    return pairs.orderBy("distance", "set_1", "set_2").limit(10)


def cluster_w2(spark, d, metric="w2"):
    """Distances of clusters of label and id ending, those of four or more members."""
    c = table(spark, d, "embeddings").select(F.concat_ws("-", F.col("label").cast("string"), (F.col("vec_id") % 13).cast("string")).alias("set_id"), part_id("vec_id").alias("gene"))
    g = gaussians.cluster_gaussians(vectors(spark, d), c, min_size=4)
    return similarity.set_distance(g, metric=metric).select("set_1", "set_2", r("distance"))


def cluster_sym_kl(spark, d):
    return cluster_w2(spark, d, "sym_kl")


# scores and concise sets

def _score(score):
    def query(spark, d):
        return concise.gene_set_scores(vectors(spark, d), fitted(spark, d), score).select("set_id", "gene", r("score", 4))

    return query


def _concise(**how):
    def query(spark, d):
        return concise.concise_sets(vectors(spark, d), fitted(spark, d), labels(spark, d), **how).select("set_id", "gene", "rank")

    return query


# enrichment

def _weights(spark, d, restricted=False):
    e = vectors(spark, d)
    return enrichment.soft_membership(e, fitted(spark, d), enrichment.overlap(prices(spark, d), e), labels(spark, d), temperature=8.0, restrict_to_members=restricted)


def soft_membership(spark, d):
    return _weights(spark, d).select("set_id", "gene", r("w"))


def soft_membership_restricted(spark, d):
    return _weights(spark, d, True).select("set_id", "gene", r("w"))


def hub_weights(spark, d):
    return enrichment.hub_weights(_weights(spark, d), graph.degrees(supply(spark, d), weighted=True), 0.5).select("set_id", "gene", r("w"))


def _gsea(test=enrichment.gsea, data=prices, **how):
    def query(spark, d):
        out = test(data(spark, d), vectors(spark, d), fitted(spark, d), labels(spark, d), temperature=8.0, **how)
        return out.select("ID", r("ES", 4), r("z", 4), r("pvalue"), r("p_adjust"), "setSize", "core_enrichment")

    return query


def perm_null(spark, d):
    """Null scores of twenty permutations, by blocks."""
    genes = enrichment.overlap(prices(spark, d), vectors(spark, d))
    nulls = enrichment.null_scores(_weights(spark, d), genes, 20)
    return nulls.select("set_id", F.col("b").cast("int").alias("b"), r("null", 4, "null_score"))


def sweep_compare(spark, d):
    _, wide = enrichment.sweep_hub_beta(prices(spark, d), vectors(spark, d), fitted(spark, d), labels(spark, d), supply(spark, d), betas=(0, 0.5, 1), temperature=8.0, nperm=0, top_genes=0)
    return wide.select("ID", *[r(c, 4) for c in wide.columns[1:]])


def sweep_long(spark, d):
    long, _ = enrichment.sweep_hub_beta(prices(spark, d), vectors(spark, d), fitted(spark, d), labels(spark, d), supply(spark, d), betas=(0, 0.5, 1), temperature=8.0, nperm=0, top_genes=0)
    return long.select("ID", "degree_beta", r("ES", 4), "setSize")


def _sweep_tested(mode, data):
    """Each beta's tests with twenty permutations."""
    def query(spark, d):
        long, _ = enrichment.sweep_hub_beta(data(spark, d), vectors(spark, d), fitted(spark, d), labels(spark, d), supply(spark, d), betas=(0, 0.5, 1), mode=mode, temperature=8.0, nperm=20, top_genes=0)
        return long.select("ID", "degree_beta", r("ES", 4), r("z", 4), r("pvalue"), r("p_adjust"), "setSize")

    return query


# fits

def fit_autoencoder(spark, d):
    _, losses = autoencoder_embedding(diffusion.node_features(trade(spark, d), k=8, **WALK), 4, epochs=10)
    return losses


def fit_joint(spark, d):
    m = fit(trade_edges(spark, d), regions(spark, d), weight="l_quantity", method="joint", k=4, dim=4, epochs=3, batch_size=2, lr=1e-2)
    return m.losses


def event_scores(spark, d):
    """Hourly enrichment of the users' event values in the labels' soft memberships (the streaming plan, on the whole table)."""
    events = table(spark, d, "events").select("ts", part_id("user_id").alias("gene"), F.col("value").alias("stat"))
    out = stream_scores(events, _weights(spark, d), window="1 day")
    return out.select(F.col("window.start").cast("string").alias("day"), "set_id", r("ES", 4), "n_genes")


QUERIES = {
    **{f.__name__: f for f in (graph_undirected, graph_directed, graph_self_loops, graph_nodes_subset, transition_col, transition_row, degree_unweighted, degree_weighted, landmarks_degree, landmarks_random)},
    **{f.__name__: f for f in (walk_steps, walk_blocks, node_features, set_features, walk_converged, svd_gram, set_gaussians, gaussians_edge_cases, cosine_top, cosine_subset, cosine_mean)},
    **{f"distance_{m}": _distance(m) for m in similarity.METRICS},
    **{f.__name__: f for f in (closest_sets, cluster_w2, cluster_sym_kl, all_similarities, wide_embedding)},
    **{f"score_{s}": _score(s) for s in concise.SCORES},
    "concise_top_n": _concise(top_n=20),
    "concise_mass": _concise(select="softmax_mass", temperature=8.0),
    "concise_quantile": _concise(select="quantile", quantile=0.7),
    "concise_threshold": _concise(select="score_threshold", score_threshold=90.0),
    "concise_unrestricted": _concise(top_n=20, restrict_to_members=False),
    "concise_mass_unrestricted": _concise(select="softmax_mass", temperature=8.0, restrict_to_members=False),
    **{f.__name__: f for f in (soft_membership, soft_membership_restricted, hub_weights)},
    "gsea_scores": _gsea(nperm=0),
    "ora_scores": _gsea(enrichment.ora, large_parts, nperm=0),
    "gsea_two_sided": _gsea(nperm=20),
    "gsea_greater": _gsea(nperm=20, alternative="greater"),
    "gsea_less": _gsea(nperm=20, alternative="less"),
    "gsea_1000": _gsea(nperm=1000),
    "ora_tested": _gsea(enrichment.ora, large_parts, nperm=50),
    "sweep_tested_gsea": _sweep_tested("gsea", prices),
    "sweep_tested_ora": _sweep_tested("ora", large_parts),
    **{f.__name__: f for f in (perm_null, sweep_compare, sweep_long, fit_autoencoder, fit_joint, event_scores)},
}
