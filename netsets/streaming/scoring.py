"""Enrichment scores over statistics that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_scores(stats: DataFrame, weights: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, set_id, ES, n_genes): the weighted sum of a stream of (gene, stat, time) per event-time window.

    `weights` (set_id, gene, w) is a static soft membership. Rows with a null gene, statistic or time are left out; those later
    than `late` behind the newest event are dropped by the watermark. Works on a batch table as well.
    """
    rows = stats.select(F.col(time).alias("ts"), "gene", F.col("stat").cast("double").alias("stat")).where("gene is not null and stat is not null and ts is not null")
    joined = rows.withWatermark("ts", late).join(weights.select("set_id", "gene", "w"), "gene")
    return joined.groupBy(F.window("ts", window), "set_id").agg(F.sum(F.col("w") * F.col("stat")).alias("ES"), F.count(F.lit(1)).alias("n_genes"))


def write_scores(scores: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the closed windows as parquet, once through the available data; `checkpoint` lies on shared storage."""
    return scores.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
