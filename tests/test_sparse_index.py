import random

import pytest
from pyspark.sql import functions as F

from docketry.operators import search, sparse_index
from docketry.operators.sparse_index import SparseIndex

PAYLOAD = "struct<doc_id:string,doc_type:string,entities:array<string>,contains_pii:boolean>"
CHUNK = "id string, text string, doc_id string, doc_type string, entities array<string>, contains_pii boolean"


def chunk(rng, i, words=60):
    text = " ".join(f"kelime{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.choice([0, 3, words])))
    return (f"c{i}", text if i % 17 else None, f"d{i % 7}", "tr" if i % 3 else "en", [f"e{i % 4}"], [None, True, False][i % 3 if i % 2 else 2])


@pytest.fixture(scope="module")
def made():
    rng = random.Random(6)
    return [chunk(rng, i) for i in range(700)], [(f"q{i}", " ".join(f"kelime{int(rng.paretovariate(0.5)) % 300}" for _ in range(n))) for i, n in enumerate([1, 2, 5, 40, 40, 3])] + [("none", "yok böyle"), ("empty", "")]


def plain(spark, chunks, queries, k, kept=None, scopes=None):
    """The same by scoring every pair."""
    every = spark.createDataFrame(chunks, CHUNK)
    postings = search.sparse_postings(every)
    scores = search.sparse_scores(spark.createDataFrame(queries, "id string, text string"), postings, search.term_idf(postings, every))
    scores = scores.join((every if kept is None else kept(every)).select(F.col("id").alias("chunk_id"), "doc_id"), "chunk_id")
    if scopes is not None:
        scores = scores.join(scopes, ["query_id", "doc_id"], "left_semi")
    keys = ["query_id"] if scopes is None else ["query_id", "doc_id"]
    return sorted((*[r[c] for c in keys], r.chunk_id, round(r.score, 5), r["rank"]) for r in search.ranked(scores, [F.desc("score"), F.col("chunk_id")], keys).where(F.col("rank") <= k).collect())


def rows_of(df, *keys):
    return sorted((*[r[c] for c in keys or ("query_id",)], r.chunk_id, round(r.score, 5), r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("shard", "width"), [(4096, 64), (100, 8), (1, 1)])
def test_search_is_that_of_scoring_everything(spark, tmp_path, monkeypatch, made, shard, width):
    monkeypatch.setattr(sparse_index, "SHARD_CHUNKS", shard)
    monkeypatch.setattr(sparse_index, "RANGE", width)
    chunks, queries = made
    chunks = chunks if shard > 1 else chunks[:60]
    asked = spark.createDataFrame(queries, "id string, text string")
    index = SparseIndex(spark, str(tmp_path / "index"), payload=PAYLOAD)
    assert index.search(asked, 5).collect() == []
    index.add(spark.createDataFrame(chunks, CHUNK).repartition(3))
    want = plain(spark, chunks, queries, 5)
    assert rows_of(index.search(asked, 5)) == want and want
    assert rows_of(index.search(asked, 5, block_terms=10)) == want
    # an index that is there already is opened, not made
    again = SparseIndex(spark, str(tmp_path / "index"))
    for filters in ({"doc_type": "en"}, {"entity": "e2", "include_pii": True}, {"doc_id": "d3"}, {}):
        got = again.search(asked, 5, search.passes(**filters))
        assert rows_of(got) == plain(spark, chunks, queries, 5, lambda e, f=filters: search.apply_filters(e, **f)), filters
    scopes = spark.createDataFrame([(q, d) for q, _ in queries for d in ("d1", "d4", "none")] + [("q1", None)], "query_id string, doc_id string")
    assert rows_of(again.search(asked, 3, scopes=scopes), "query_id", "doc_id") == plain(spark, chunks, queries, 3, scopes=scopes)


def test_changes_and_statistics(spark, tmp_path, made):
    chunks, queries = made
    asked = spark.createDataFrame(queries, "id string, text string")
    index = SparseIndex(spark, str(tmp_path / "index"), payload=PAYLOAD)
    make = lambda rows: spark.createDataFrame(rows, CHUNK)

    def same(held):
        every = make(held)
        want = {r.term_id: (r.df, round(r.idf, 9)) for r in search.term_idf(search.sparse_postings(every), every).collect()}
        assert {r.term_id: (r.df, round(r.idf, 9)) for r in index.idf().collect()} == want and index.size() == len(held)
        assert rows_of(index.search(asked, 5)) == plain(spark, held, queries, 5)

    index.add(make(chunks[:300]), batch=("load", 0))
    same(chunks[:300])
    shards = index.store.manifest()["tables"]["shards"]["folders"]["0"]
    index.add(make(chunks[300:]), batch=("load", 1))
    same(chunks)
    # what was there is neither read into new files nor written again, and a batch that comes twice counts once
    assert index.store.manifest()["tables"]["shards"]["folders"]["0"][: len(shards)] == shards
    index.add(make(chunks[300:]), batch=("load", 1))
    same(chunks)
    rng = random.Random(1)
    changed = [(c[0], "yeni kelime1 metin", *c[2:]) for c in rng.sample(chunks, 40)]
    index.add(make(changed))
    new = {c[0]: c for c in changed}
    held = [new.get(c[0], c) for c in chunks]
    same(held)
    index.remove(make(held[:100]).select(F.col("id").alias("chunk_id")))
    index.remove(make(held[:50]).select(F.col("id").alias("chunk_id")))
    same(held[100:])
    index.compact()
    same(held[100:])
    assert index.store.table("terms").count() == index.idf_counts().count()


def test_postings_are_skipped(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"c{i:05}", " ".join(["ortak", f"konu{i // 200}", *(f"konu{i // 200}x{rng.randrange(30)}" for _ in range(20))]), "d", "tr", [], False) for i in range(4000)]
    index = SparseIndex(spark, str(tmp_path / "index"), payload=PAYLOAD)
    index.add(spark.createDataFrame(rows, CHUNK).coalesce(1))
    asked = spark.createDataFrame([("q1", "ortak konu3 konu3x1 konu3x2"), ("q2", "ortak konu7x1")], "id string, text string")
    assert index.skipped(asked, 5) > 0.7


def test_memory_is_bounded_by_texts_and_postings(spark, tmp_path, monkeypatch, made):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from docketry.sources.versions import Store, append

    batch = pa.RecordBatch.from_pydict({"n": list(range(7)), "words": ["a" * 10, None, "b" * 10, "c" * 50, "", "d", "e"]})
    parts = list(search.slices(batch, "words", 25))
    assert [p.column("n").to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5, 6]]
    assert [p.num_rows for p in search.slices(batch, "words", 1000, 3)] == [3, 3, 1] and not list(search.slices(batch.slice(0, 0), "words"))

    chunks, queries = made
    monkeypatch.setattr(sparse_index, "SHARD_POSTINGS", 400)
    monkeypatch.setattr(search, "TEXT_BYTES", 1000)
    monkeypatch.setattr(sparse_index, "slices", lambda b, c, rows: search.slices(b, c, 1000, rows))
    index = SparseIndex(spark, str(tmp_path / "index"), payload=PAYLOAD)
    index.add(spark.createDataFrame(chunks, CHUNK).coalesce(1))
    sizes = [r.n for r in index.store.table("shards").select((F.length("docs") / 4).alias("n")).collect()]
    assert len(sizes) > 5 and max(sizes) <= 400
    assert rows_of(index.search(spark.createDataFrame(queries, "id string, text string"), 5)) == plain(spark, chunks, queries, 5)

    # row groups of very large rows close after a few of them, not after a hundred
    store = Store(spark, str(tmp_path / "store"), {"t": ("id bigint, b binary", "id", 1)})
    large = spark.range(8, numPartitions=1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100000)), lambda i: F.sha2(F.concat("id", i).cast("string"), 256)), "").cast("binary").alias("b"))
    store.commit(lambda s: [append("t", large)])
    file = next((tmp_path / "store" / "data").glob("t-*/*.parquet"))
    assert pq.ParquetFile(file).num_row_groups > 1 and store.table("t").count() == 8


def test_a_shard_has_a_quarter_of_a_million_postings_at_most(spark, tmp_path):
    # a shard is one row: a task holds several copies of it while it writes or reads one
    rows = spark.range(0, 1200, 1, 1).select(F.col("id").cast("string").alias("id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.concat(F.lit("w"), ((F.col("id") * 7 + i) % 3000).cast("string"))), " ").alias("text"))
    index = SparseIndex(spark, str(tmp_path / "index"))
    index.add(rows)
    sizes = [r.n for r in index.store.table("shards").select((F.octet_length("docs") / 4).cast("long").alias("n")).collect()]
    assert sum(sizes) == 1200 * 300 and max(sizes) <= 1 << 18


def test_shards_are_written_once_and_small(spark, tmp_path, made):
    index = SparseIndex(spark, f"{tmp_path}/x", payload=PAYLOAD)
    index.add(spark.createDataFrame(made[0], CHUNK))
    # the table's files are those that the tasks wrote, not a copy of them
    assert not [p for p in (tmp_path / "x" / "data").iterdir() if p.name.startswith("shards-")]
    size = {a: F.sum(F.octet_length(a)) for a in sparse_index.ARRAYS}
    n = index.store.table("shards").agg(*[v.alias(a) for a, v in size.items()]).first()
    postings = n["weights"] // 8
    assert n["docs"] == 4 * postings and n["terms"] <= 4 * postings and n["block_most"] <= 4 * postings
    for row in index.store.table("shards").collect():
        a = {k: sparse_index.np.frombuffer(row[k], kind) for k, kind in sparse_index.ARRAYS.items()}
        assert (a["block_most"].astype(float) >= sparse_index.np.maximum.reduceat(a["weights"], a["block_begin"][:-1])).all()
    assert index.size() == len(made[0])
    index.store.vacuum(keep=1)
    assert index.store.table("shards").count() > 0
