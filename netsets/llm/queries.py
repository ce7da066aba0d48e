"""The queries of the training-data operators, by problem number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsets.llm import clusters, cooccurrence, copies, encoding, neighbours, packing, set_join, subjects, topn
from netsets.session import written
from netsets.sources.tables import folded, number_in, table


def _edge_tree() -> copies.Node:
    """An interaction: the unordered pair of folded names, and the weight as delivered."""
    ends = copies.Node((copies.Leaf(F.col("name_1")), copies.Leaf(F.col("name_2"))), ordered=False)
    return copies.Node((ends, copies.Leaf(F.col("number"))))


def _named_edges(ppi: DataFrame) -> DataFrame:
    """The edge rows with a name on both sides: (edge_id, name_1, name_2, number), each normalised once."""
    named = ppi.where(F.col("node1").rlike("[A-Za-z0-9]") & F.col("node2").rlike("[A-Za-z0-9]"))
    return named.select("edge_id", folded(F.col("node1")).alias("name_1"), folded(F.col("node2")).alias("name_2"), number_in(F.col("weight_text")).alias("number"))


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per interaction record and its number of copies."""
    return copies.records(_named_edges(table(spark, sf_dir, "ppi")), _edge_tree(), "edge_id").select(F.col("first_id").alias("first_edge_id"), "copies")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row but the lowest edge id of its record, with that id."""
    return copies.copies(_named_edges(table(spark, sf_dir, "ppi")), _edge_tree(), "edge_id").select(F.col("first_id").alias("first_edge_id"), "edge_id")


def p6_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top_n genes of each listed set with score and rank."""
    return topn.top_n(table(spark, sf_dir, "gsemb_gene_to_set_score"), table(spark, sf_dir, "gsemb_make_concise_gene_sets"), "set_id", "gene", "score", "top_n")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top_n genes of each listed set."""
    return p6_top(spark, sf_dir).select("set_id", "gene")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte_bpe_50k ids of every document's text."""
    return encoding.encode(table(spark, sf_dir, "documents"))


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs between classes of equal sets: the classes' lowest set ids, sizes and common members."""
    distinct, _ = set_join.classes(_current(spark, sf_dir))
    return set_join.similar_classes(distinct)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of sets with a Jaccard similarity of their clean members of at least 0.8."""
    return set_join.similar_sets(_current(spark, sf_dir))


def p3_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered rows of gene_sets, of any revision, and the current sets they are similar to."""
    rows = table(spark, sf_dir, "gene_sets")
    delivered = rows.select(F.col("row_id").alias("set_id"), F.coalesce(set_join.clean_members(F.col("gene_sets")), F.expr("array()").cast("array<string>")).alias("members"))
    return set_join.similar_between(delivered, _current(spark, sf_dir)).select(F.col("left_id").cast("long").alias("row_id"), F.col("right_id").alias("set_id"))


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.current_sets(table(spark, sf_dir, "gene_sets"), "set_id", "gene_sets", "revision")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    container = table(spark, sf_dir, "pack_containers").first()  # one fixed row
    sizes = encoding.token_counts(table(spark, sf_dir, "documents"), path=encoding.vocabulary(container["tokenizer"]))
    return packing.pack(written(sizes, "token-counts"), container["capacity_tokens"], "doc_id", "n_tokens")


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document, or piece of a split one, lies."""
    return _packed(spark, sf_dir)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that had to be split: those with a second piece."""
    return _packed(spark, sf_dir).where("piece = 1").select("doc_id")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of both kinds as records of their own: (kind, item_id, vec)."""
    fitted = table(spark, sf_dir, "gsemb_embedding").where("kind in ('gene', 'set')")
    return fitted.select("kind", "item_id", F.when(F.col("kind") == "gene", F.col("gene_embedding")).otherwise(F.col("set_mu")).alias("vec"))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group of three or more similar records: its size and most typical members."""
    return clusters.described(clusters.clusters(_records(spark, sf_dir))).drop("internal")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of groups of three or more, with the group's lowest id."""
    return clusters.grouped_pairs(clusters.clusters(_records(spark, sf_dir)))


def _genes_in_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _current(spark, sf_dir).select(F.col("set_id").alias("basket"), F.explode("members").alias("item"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of genes in at least 8 sets: counts, the null's expectation, tail probability and false-discovery rate."""
    found = cooccurrence.surprising_pairs(_genes_in_sets(spark, sf_dir), 8)
    return found.select(F.col("item_1").alias("gene_1"), F.col("item_2").alias("gene_2"), "n12", "n1", "n2", "expected", "p_value", "q_value")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of genes in at least 8 sets, with the sets of both and of each."""
    found = cooccurrence.frequent_pairs(_genes_in_sets(spark, sf_dir), 8)
    return found.select(F.col("item_1").alias("gene_1"), F.col("item_2").alias("gene_2"), "n12", "n1", "n2")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of genes in at least 8 sets and at least four times as often together as by chance."""
    found = cooccurrence.surprising_pairs(_genes_in_sets(spark, sf_dir), 8)
    return found.where(cooccurrence.at_least(4)).select(F.col("item_1").alias("gene_1"), F.col("item_2").alias("gene_2"))


def _gene_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "gsemb_embedding").where("kind = 'gene'").select("kind", "item_id", F.col("gene_embedding").alias("vec"))


def p7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar gene vectors of each gene vector, from a cosine of 0.85."""
    return neighbours.nearest(_gene_vectors(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of gene rows where one is among the other's five most similar."""
    found = neighbours.nearest(_gene_vectors(spark, sf_dir))
    return found.select(F.least("item_id", "neighbour_id").alias("item_id_1"), F.greatest("item_id", "neighbour_id").alias("item_id_2")).distinct()


def p10_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of each document with its number of sentences and of those about the subject."""
    docs = table(spark, sf_dir, "documents")
    names = sorted(r["subject"] for r in table(spark, sf_dir, "subject_areas").select("subject").distinct().collect())  # a fixed table
    return subjects.subjects_of(docs, subjects.train(docs, table(spark, sf_dir, "subject_labels"), names), names)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that at least a third of a document's sentences are about."""
    return p10_subjects(spark, sf_dir).select("doc_id", "subject")


QUERIES = {
    f.__name__: f
    for f in (p1_clusters, p1_found, p2_pairs, p2_counts, p2_found, p3_pairs, p3_found, p3_between, p5_records, p5_found, p6_top, p6_found, p7_neighbours, p7_found, p8_ids, p9_packed, p9_found, p10_subjects, p10_found)
}
