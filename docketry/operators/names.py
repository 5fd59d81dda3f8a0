"""Tolerant names against a whole catalogue, as a similarity join: no name is compared with every other.

Two names are alike (``text.like_names``) if they are equal, one lies within the other, or they share three fifths of the long words of the
one that has fewer. Each of these leaves a mark on which both can be joined: a name within another has its first three characters among
the other's; and of names that share enough words, one shares a word of its *prefix*, the rarest of its words, without which too few are left.
What meets on a mark is then compared in full. Names are normalised and made distinct first, so repeated names cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as X


def _grams(c) -> Column:
    """Distinct runs of one, two and three characters."""
    own = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))))
    return F.array_distinct(F.flatten(F.array_compact(F.array(*map(own, (1, 2, 3))))))


def _distinct(names: DataFrame) -> DataFrame:
    return names.select(X.tr_normalize("name").alias("name")).where("name <> ''").distinct()


def _words(names: DataFrame, counts: DataFrame) -> DataFrame:
    """``name, word, prefix`` of each name's long words: whether the word is among the rarest, of which a like name with at least as many shares one."""
    rows = names.select("name", F.explode(X.long_words(F.col("name"))).alias("word")).join(counts, "word")
    nth = F.row_number().over(Window.partitionBy("name").orderBy("n", "word"))
    size = F.count("*").over(Window.partitionBy("name"))
    # so many words may be missing, and one more for the rounding of three fifths
    return rows.select("name", "word", (nth <= size - F.ceil(size * 6 / 10) + 2).alias("prefix"))


def like_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """``name, other, strict``: pairs of a ``name`` of the left and one of the right, as they are written, that are alike; ``strict`` where they are equal but for spelling."""
    a, b = _distinct(left), _distinct(right)
    counts = a.unionByName(b).select(F.explode(X.long_words(F.col("name"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    x, y = _words(a, counts).withColumnRenamed("name", "x"), _words(b, counts).withColumnRenamed("name", "y")
    first = lambda names, c: names.select(F.col("name").alias(c), F.substring("name", 1, 3).alias("gram"))
    grams = lambda names, c: names.select(F.col("name").alias(c), F.explode(_grams(F.col("name"))).alias("gram"))
    met = [
        x.where("prefix").drop("prefix").join(y.drop("prefix"), "word"),
        x.drop("prefix").join(y.where("prefix").drop("prefix"), "word"),
        first(a, "x").join(grams(b, "y"), "gram"),
        grams(a, "x").join(first(b, "y"), "gram"),
    ]
    every = met[0].select("x", "y")
    for more in met[1:]:
        every = every.unionByName(more.select("x", "y"))
    like = every.distinct().where(X.like_names(F.col("x"), F.col("y"), X.long_words(F.col("x")), X.long_words(F.col("y"))))
    written = lambda names, c, as_: names.select("name").distinct().select(X.tr_normalize("name").alias(c), F.col("name").alias(as_))
    return like.join(written(left, "x", "name"), "x").join(written(right, "y", "other"), "y").select("name", "other", (F.col("x") == F.col("y")).alias("strict"))


def best_service(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """``name, service``: for each asked name the service of the catalogue (``service``) that it means: one equal but for spelling, else a like
    one, of several the first by name. Names that are like no service are left out."""
    pairs = like_pairs(asked.select("name"), catalog.select(F.col("service").alias("name")))
    return pairs.groupBy("name").agg(F.min_by("other", F.struct((~F.col("strict")).alias("loose"), "other")).alias("service"))
