import itertools
import random

from pyspark.sql import functions as F

from docketry.functions import text as X
from docketry.operators import names


def test_like_pairs_are_those_of_comparing_all(spark):
    rng = random.Random(3)
    words = ["Sicil", "Tecil", "Takip", "SERVİSİ", "Servisi", "İcra", "ve", "Şube", "Muhasebe", "Vergilendirme", "Kovuşturma", "Tarama", "Kontrol", "II", "a", "gelir"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))) for _ in range(160)] + ["", "  ", "S", "se", "VERGİ", "Ver", "erg", "Sicil-Servisi"]
    left, right = (spark.createDataFrame([(n,) for n in part] + [(None,)], "name string") for part in (made[:90], made[70:]))
    every = left.distinct().join(right.distinct().withColumnRenamed("name", "other"), X.same_service(F.col("name"), F.col("other")))
    want = {(r.name, r.other, r.strict) for r in every.withColumn("strict", X.same_service_strict(F.col("name"), F.col("other"))).collect()}
    got = [tuple(r) for r in names.like_pairs(left, right).collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_no_nested_loop(spark):
    left = spark.range(3000).select(F.concat(F.lit("Birim "), F.col("id").cast("string"), F.lit(" Görevlileri")).alias("name"))
    plan = names.like_pairs(left, left)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_best_service(spark):
    catalog = spark.createDataFrame([(s,) for s in ("Sicil Servisi", "Sicil ve Tecil Servisi", "Takip Servisi")], "service string")
    asked = spark.createDataFrame([(n,) for n in itertools.chain(("SİCİL servisi", "Tecil Servisi Müdürlüğü", "takip", "başka"), ("takip",))], "name string")
    assert {r.name: r.service for r in names.best_service(asked, catalog).collect()} == {"SİCİL servisi": "Sicil Servisi", "Tecil Servisi Müdürlüğü": "Sicil ve Tecil Servisi", "takip": "Takip Servisi"}
