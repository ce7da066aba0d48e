"""Queries on the edge list that face heavy keys (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsets.operators.skew import heavy_keys, per_key_runs
from netsets.sources.tables import folded, table


def edge_ends(ppi: DataFrame) -> DataFrame:
    """One row per edge row and distinct non-empty folded end point: (gene, edge_id); a self-loop gives one."""
    ends = ppi.select("edge_id", folded(F.col("node1")).alias("a"), folded(F.col("node2")).alias("b"))
    pair = F.when(F.col("a").eqNullSafe(F.col("b")), F.array("a")).otherwise(F.array("a", "b"))
    return ends.select("edge_id", F.explode(pair).alias("gene")).where("gene <> ''")


def p4_gene_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per gene: edge rows, first and last edge id, widest gap between two of its edges in the delivery order."""
    return per_key_runs(edge_ends(table(spark, sf_dir, "ppi")), "gene", "edge_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes that are an end point in at least 2 % of all rows."""
    ppi = table(spark, sf_dir, "ppi")
    return heavy_keys(per_key_runs(edge_ends(ppi), "gene", "edge_id"), "gene", ppi.count(), 0.02).select("gene")


_ENDS = """with f as (select edge_id, upper(regexp_replace(node1, '[^A-Za-z0-9]', '', 'g')) a, upper(regexp_replace(node2, '[^A-Za-z0-9]', '', 'g')) b from ppi),
ends as (select edge_id, a as gene from f where a <> '' union select edge_id, b from f where b <> '')"""

SQL = {
    "p4_gene_runs": _ENDS + """, g as (select gene, edge_id, edge_id - lag(edge_id) over (partition by gene order by edge_id) as gap from ends)
select gene, count(*) as n_rows, min(edge_id) as first_pos, max(edge_id) as last_pos, coalesce(max(gap), 0) as max_gap from g group by gene""",
    "p4_found": _ENDS + " select gene from ends group by gene having count(*) >= 0.02 * (select count(*) from ppi)",
}
QUERIES = {"p4_gene_runs": p4_gene_runs, "p4_found": p4_found}
