from pyspark.sql import functions as F

from netsets.streaming.scoring import stream_scores, write_scores


def test_a_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1.0, 0), ("B", 2.0, 60), ("A", 3.0, 4000), (None, 1.0, 0), ("A", None, 0), ("Z", 1.0, 0)], "gene string, stat double, s long")
    events = rows.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    weights = spark.createDataFrame([("S", "A", 0.25), ("S", "B", 0.75)], "set_id string, gene string, w double")
    batch = sorted((r["ES"], r["n_genes"]) for r in stream_scores(events, weights).collect())
    assert batch == [(0.75, 1), (1.75, 2)]
    events.unionByName(spark.createDataFrame([("Z", 1.0, 10**6)], "gene string, stat double, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("gene string, stat double, ts timestamp").parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([("A", 9.0, 2 * 10**6)], "gene string, stat double, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for _ in range(2):  # the watermark that closes the windows comes with the second run
        write_scores(stream_scores(stream, weights), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
        late.write.mode("append").parquet(str(tmp_path / "in"))
    got = sorted((r["ES"], r["n_genes"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[:2] == batch
