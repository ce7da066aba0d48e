"""End-to-end fit, and queries on the fitted model."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from netsets.contracts import one_of
from netsets.operators import concise, enrichment, similarity
from netsets.operators.diffusion import node_features
from netsets.operators.embedding import autoencoder_embedding, svd_embedding
from netsets.operators.gaussians import cluster_gaussians, set_gaussians
from netsets.operators.graph import Graph, build_graph, landmarks
from netsets.operators.joint import joint_fit
from netsets.session import tidy, written

METHODS = ("svd", "autoencoder", "joint")
_TABLES = ("nodes", "adjacency", "embedding", "gaussians", "marks", "losses")


@dataclass(frozen=True)
class SetEmbedding:
    """A fitted model: the graph, the genes' embedding, the sets' Gaussians, the landmarks, and losses where a method has them."""

    graph: Graph
    method: str
    embedding: DataFrame
    gaussians: DataFrame
    marks: DataFrame
    losses: DataFrame | None = None

    def gene_similarity(self, genes: list[str] | None = None, other_genes: list[str] | None = None, eps: float = 1e-12) -> DataFrame:
        return similarity.cosine(self.embedding, genes=genes, other_genes=other_genes, eps=eps)

    def set_similarity(self, sets: list[str] | None = None, other_sets: list[str] | None = None, metric: str = "w2", eps: float = 1e-8) -> DataFrame:
        return similarity.set_distance(self.gaussians, sets=sets, other_sets=other_sets, metric=metric, eps=eps)

    def cluster_similarity(self, clusters: DataFrame, other_clusters: DataFrame | None = None, metric: str = "w2", eps: float = 1e-8, min_size: int = 2) -> DataFrame:
        """Distances of ad-hoc clusters (set_id, gene); those with fewer members in the embedding than `min_size` are left out."""
        one = cluster_gaussians(self.embedding, clusters, eps, min_size)
        two = cluster_gaussians(self.embedding, other_clusters, eps, min_size) if other_clusters is not None else None
        return similarity.set_distance(one, two, metric=metric, eps=eps)

    def all_similarities(self, eps_gene: float = 1e-12, eps_set: float = 1e-8) -> dict[str, DataFrame]:
        """gene_gene, set_set_w2 and set_set_kl."""
        return {
            "gene_gene": self.gene_similarity(eps=eps_gene),
            "set_set_w2": self.set_similarity(metric="w2", eps=eps_set),
            "set_set_kl": self.set_similarity(metric="sym_kl", eps=eps_set),
        }

    def concise_sets(self, membership: DataFrame | None, **how) -> DataFrame:
        return concise.concise_sets(self.embedding, self.gaussians, membership, **how)

    def gsea(self, stats: DataFrame, membership: DataFrame | None = None, **how) -> DataFrame:
        return enrichment.gsea(stats, self.embedding, self.gaussians, membership, self.graph, **how)

    def ora(self, labels: DataFrame, membership: DataFrame | None = None, **how) -> DataFrame:
        return enrichment.ora(labels, self.embedding, self.gaussians, membership, self.graph, **how)

    def sweep_hub_beta(self, stats: DataFrame, membership: DataFrame | None = None, **how) -> tuple[DataFrame, DataFrame]:
        return enrichment.sweep_hub_beta(stats, self.embedding, self.gaussians, membership, self.graph, **how)

    def save(self, path: str) -> None:
        """Write the model's tables and its description below `path`."""
        tables = {"nodes": self.graph.nodes, "adjacency": self.graph.adjacency, "embedding": self.embedding, "gaussians": self.gaussians, "marks": self.marks, "losses": self.losses}
        for name, df in tables.items():
            if df is not None:
                df.write.parquet(os.path.join(path, name))
        spark = self.embedding.sparkSession
        spark.createDataFrame([(json.dumps({"method": self.method, "losses": self.losses is not None, "numbered": self.graph.numbered}),)], "about string").coalesce(1).write.json(os.path.join(path, "about"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> SetEmbedding:
        about = json.loads(spark.read.json(os.path.join(path, "about")).first()["about"])
        t = {n: spark.read.parquet(os.path.join(path, n)) for n in _TABLES if n != "losses" or about["losses"]}
        return SetEmbedding(Graph(t["nodes"], t["adjacency"], about["numbered"]), about["method"], t["embedding"], t["gaussians"], t["marks"], t.get("losses"))


def fit(
    edges: DataFrame | Graph,
    membership: DataFrame,
    node1: str = "node1",
    node2: str = "node2",
    weight: str | None = None,
    directed: bool = False,
    nodes: list[str] | DataFrame | None = None,
    method: str = "svd",
    dim: int = 64,
    k: int = 128,
    alpha: float = 0.5,
    tol: float = 1e-10,
    max_iter: int = 200,
    normalize: str = "col",
    seed: int = 1,
    **training,
) -> SetEmbedding:
    """Graph, landmark walks, embedding and set Gaussians from an edge list (or a graph) and a membership (set_id, gene).

    `training` goes to the autoencoder (epochs, lr, batch_size) or the joint trainer (tau, lambda_set, epochs, lr, batch_size).
    """
    one_of(method, METHODS, "method")
    graph = edges if isinstance(edges, Graph) else build_graph(edges, node1, node2, weight, directed, nodes)
    graph = Graph(written(graph.nodes, "nodes"), written(graph.adjacency, "adjacency"), graph.numbered)
    tidy(graph.nodes.sparkSession)
    marks = written(landmarks(graph, k, seed=seed), "landmarks")
    walk = {"alpha": alpha, "tol": tol, "max_iter": max_iter, "normalize": normalize}
    if method == "joint":
        embedding, gaussians, losses = joint_fit(graph, membership, marks, dim=dim, seed=seed, **training, **walk)
        return SetEmbedding(graph, method, embedding, gaussians, marks, losses)
    features = node_features(graph, marks, **walk)
    losses = None
    if method == "svd":
        embedding = svd_embedding(features, dim)
    else:
        embedding, losses = autoencoder_embedding(features, dim, seed=seed, **{"epochs": 200, "lr": 5e-3, "batch_size": max(64, 4 * dim), **training})
    embedding = written(embedding, "embedding")
    tidy(embedding.sparkSession)
    return SetEmbedding(graph, method, embedding, written(set_gaussians(embedding, membership), "gaussians"), marks, losses)
