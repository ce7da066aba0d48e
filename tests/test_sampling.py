from netsets.functions.sampling import bounded_sample


def test_samples_are_bounded_and_repeatable(spark):
    df = spark.range(20_000)
    got = [r["id"] for r in bounded_sample(df, "id", 20_000, 900).orderBy("id").collect()]
    assert 650 < len(got) <= 900 and got == [r["id"] for r in bounded_sample(df.repartition(7), "id", 20_000, 900).orderBy("id").collect()]
    assert bounded_sample(df, "id", 20_000, 20_000).count() == 20_000
