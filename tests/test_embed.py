from pyspark.sql import functions as F

from docketry.operators import search


def test_embedding_takes_a_slice_of_texts_at_a_time(spark):
    rows = spark.range(0, 40, 1, 1).select(F.col("id"), F.when(F.col("id") < 8, F.repeat(F.lit("x"), 300_000)).otherwise("y").alias("text"))
    got = {r.id: tuple(r.embedding) for r in search.embed(rows, lambda texts: [[len(texts), sum(map(len, texts))] for _ in texts]).collect()}
    assert len(got) == 40 and max(n for n, _ in got.values()) == 16 and max(size for _, size in got.values()) <= 1 << 20
