import random

import numpy as np
import pytest

from docketry.operators import dense_index, search
from docketry.operators.dense_index import DenseIndex

PAYLOAD = "struct<doc_type:string,entities:array<string>,contains_pii:boolean>"
ROW = "id string, embedding array<float>, doc_type string, entities array<string>, contains_pii boolean"


def rows(n, clusters, spread, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(clusters, 16))
    v = (middles[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, 16))).astype(np.float32)
    v[::50] = v[0]  # ties
    v[1] = 0
    return [(f"v{i:05}", None if i == 7 else x.tolist(), "tr" if i % 3 else "en", [f"e{i % 4}"], i % 5 == 0) for i, x in enumerate(v)]


def plain(made, asked, k, kept=lambda r: True):
    length = lambda x: max(float(np.linalg.norm(x)), 1e-12)
    out = []
    for q, e, *_ in asked:
        if e is None:
            continue
        x = np.array(e, np.float64)
        scores = [(-round(float(x @ np.array(r[1], np.float64)) / length(x) / length(np.array(r[1], np.float64)), 6), r[0]) for r in made if r[1] is not None and kept(r)]
        out += [(q, c, round(-s, 5), n + 1) for n, (s, c) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r.chunk_id, round(r.score, 5), r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("size", "block"), [(1024, 4096), (16, 5)])
def test_search_is_that_of_scoring_everything(spark, tmp_path, monkeypatch, size, block):
    monkeypatch.setattr(dense_index, "SHARD_VECTORS", size)
    made = rows(900, 12, 0.3)
    asked = made[::40] + [("none", None, "", [], False), ("zero", [0.0] * 16, "", [], False)]
    queries = spark.createDataFrame(asked, ROW)
    index = DenseIndex(spark, str(tmp_path / "index"), payload=PAYLOAD)
    assert index.search(queries, 5).collect() == []
    index.add(spark.createDataFrame(made[:600], ROW).repartition(3))
    assert found(index.search(queries, 5)) == plain(made[:600], asked, 5)
    # what comes later goes to the centres that are there
    index.add(spark.createDataFrame(made[600:], ROW))
    again = DenseIndex(spark, str(tmp_path / "index"))
    assert found(again.search(queries, 5, block=block)) == plain(made, asked, 5)
    got = again.search(queries, 5, search.passes(doc_type="en", entity="e2"))
    assert found(got) == plain(made, asked, 5, lambda r: r[2] == "en" and "e2" in r[3] and not r[4])
    assert found(again.search(queries, 5000)) == plain(made, asked, 5000)


def test_shards_are_passed_by_and_few_rows_leave_a_task(spark, tmp_path):
    made = rows(4000, 20, 0.05)
    index = DenseIndex(spark, str(tmp_path / "index"), payload=PAYLOAD)
    index.add(spark.createDataFrame(made, ROW))
    queries = spark.createDataFrame(random.Random(1).sample(made, 30), ROW)
    assert index.skipped(queries, 10) > 0.7
    for hits, _ in index._searched(queries, 10, None, 4096):
        per_task = hits.where("query_id IS NOT NULL").groupBy("query_id").count().toPandas()["count"].max()
        assert per_task <= 10 * hits.rdd.getNumPartitions()
