import json
import random

import pytest
from pyspark.sql import functions as F

from docketry.operators import registry, stored_registry
from docketry.sources import versions
from docketry.sources.versions import Store
from docketry.streaming import streams


def at(df, column="t"):
    return df.withColumn("ts", F.timestamp_seconds(column)).drop(column)


def played(spark, tmp_path, batches, schema, run, name):
    """A stream whose micro-batches are the given lists of rows; the rows that come out."""
    folder = tmp_path / name
    folder.mkdir()
    for i, rows in enumerate(batches):
        at(spark.createDataFrame(rows, schema)).coalesce(1).write.parquet(str(folder / "drafts" / str(i)))
    made = at(spark.createDataFrame([], schema)).schema
    (folder / "in").mkdir()
    for i in range(len(batches)):
        for f in (folder / "drafts" / str(i)).glob("*.parquet"):
            f.rename(folder / "in" / f"{i:03}-{f.name}")
        stream = spark.readStream.schema(made).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        q = run(stream).writeStream.format("parquet").option("checkpointLocation", str(folder / "cp")).outputMode("append").trigger(availableNow=True).start(str(folder / "out"))
        q.awaitTermination(300)
    return sorted(tuple(r) for r in spark.read.parquet(str(folder / "out")).collect())


def test_lifecycle_is_the_same_in_any_order(spark, tmp_path):
    rows = [("a", 1, "new", None), ("a", 5, "completed", "onay"), ("a", 3, "routed", None), ("a", 9, "completed", "red"), ("b", 2, "in_progress", None), ("b", 4, "new", None)]
    events = spark.createDataFrame(rows, "document_id string, t int, status string, decision string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    batch = {r.document_id: (r.lifecycle_status, r.completed_decision) for r in streams.lifecycle_state(events).collect()}
    assert batch == {"a": ("completed", "onay"), "b": ("in_progress", None)}
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    q = streams.lifecycle_state(stream).writeStream.outputMode("complete").format("memory").queryName("life").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.document_id: (r.lifecycle_status, r.completed_decision) for r in spark.table("life").collect()} == batch


# arrivals


def state(store):
    registry = {r.filename: (r.id, r.hash, r.status, r.error) for r in store.table("registry").collect()}
    chunks = sorted((r.doc_id, r.kind, r.text) for r in store.table("chunks").collect())
    return registry, chunks


def test_a_changed_file_is_replaced(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("# Başlık\n\nilk metin")
    (folder / "b.txt").write_bytes(b"kalan \xff metin")
    (folder / "c.bin").write_bytes(b"x")
    store = streams.document_store(spark, str(tmp_path / "store"), 4)
    streams.ingest_folder(store, str(folder))
    first, first_chunks = state(store)
    assert set(first) == {"a.md", "b.txt"} and {r[2] for r in first.values()} == {"parsed"}
    assert any("kalan � metin" in t for _, _, t in first_chunks)
    created = {r.filename: r.created_at for r in store.table("registry").collect()}
    # nothing has changed: the same files, the same rows
    before = store.manifest()["tables"]
    streams.ingest_folder(store, str(folder))
    assert state(store) == (first, first_chunks) and store.manifest()["tables"] == before
    (folder / "a.md").write_text("# Başlık\n\nikinci metin\n\n# Yeni\n\nbölüm")
    version = streams.ingest_folder(store, str(folder))
    second, second_chunks = state(store)
    assert second["a.md"][0] == first["a.md"][0] and second["a.md"][1] != first["a.md"][1] and second["b.txt"] == first["b.txt"]
    assert {r.filename: r.created_at for r in store.table("registry").collect()} == created
    mine = [t for d, _, t in second_chunks if d == first["a.md"][0]]
    assert len(mine) == 4 and not any("ilk metin" in t for t in mine)
    assert [c for c in second_chunks if c[0] != first["a.md"][0]] == [c for c in first_chunks if c[0] != first["a.md"][0]]
    # the bucket of the other file was not written again, and the version before can still be read
    now = store.manifest()["tables"]
    assert sum(now["registry"]["folders"][b] != f for b, f in before["registry"]["folders"].items()) == 1
    assert {r.hash for r in store.table("registry", version - 1).collect()} == {r[1] for r in first.values()}
    assert store.vacuum(1) > 0 and state(store) == (second, second_chunks)


def test_arrivals_as_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "day1").mkdir(parents=True)
    (folder / "day1" / "a.md").write_text("# Başlık\n\nilk metin")
    (folder / "day1" / "b.bin").write_bytes(b"x")
    store = streams.document_store(spark, str(tmp_path / "store"), 4)
    document = F.regexp_replace("path", "/day[0-9]+/", "/")

    def run():
        q = streams.ingest_stream(store, str(folder), str(tmp_path / "cp"), document_path=document)
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    first, _ = state(store)
    assert set(first) == {"a.md"}
    # a new state of the same document, and two in one batch of another, of which the newer counts
    (folder / "day2").mkdir()
    (folder / "day2" / "a.md").write_text("yeni metin")
    run()
    second, chunks = state(store)
    assert len(second) == 1 and second["a.md"][0] == first["a.md"][0] and {t for _, _, t in chunks} == {"[Dosya: a.md]\nyeni metin"}
    assert store.manifest()["batches"] == {"arrivals": 1}


def arrivals(spark, *rows):
    return spark.createDataFrame([(p, t, len(c), bytearray(c.encode())) for p, t, c in rows], "path string, t int, length long, content binary").withColumn("modificationTime", F.timestamp_seconds("t")).drop("t")


def test_batches_run_again_and_crashes(spark, tmp_path, monkeypatch):
    store = streams.document_store(spark, str(tmp_path / "store"), 4)
    one = arrivals(spark, ("/x/a.md", 1, "eski"), ("/x/a.md", 2, "bir"), ("/x/b.md", 1, "iki"))
    streams.ingest_files(store, one, batch=("s", 0))
    first = state(store)
    assert any("bir" in t for _, _, t in first[1]) and not any("eski" in t for _, _, t in first[1])
    version = store.version()
    assert streams.ingest_files(store, arrivals(spark, ("/x/a.md", 3, "üç")), batch=("s", 0)) == version
    assert state(store) == first
    # a crash after the registry's files are written and before the chunks' are
    real, calls = Store._buckets, []

    def failing(self, table, keys):
        calls.append(table["key"])
        if table["key"] == "doc_id":
            raise RuntimeError("lost")
        return real(self, table, keys)

    monkeypatch.setattr(Store, "_buckets", failing)
    with pytest.raises(RuntimeError, match="lost"):
        streams.ingest_files(store, arrivals(spark, ("/x/a.md", 3, "dört")), batch=("s", 1))
    assert "path" in calls
    monkeypatch.undo()
    assert store.version() == version and state(store) == first
    streams.ingest_files(store, arrivals(spark, ("/x/a.md", 3, "dört")), batch=("s", 1))
    assert any("dört" in t for _, _, t in state(store)[1]) and store.version() == version + 1


def test_what_an_ingestion_writes_on_its_way_is_gone(spark, tmp_path, monkeypatch):
    # buckets are changed one at a time, as in a table too large for one pass
    monkeypatch.setattr(versions, "PASS_BYTES", 1)
    store = streams.document_store(spark, str(tmp_path / "store"), 4)
    texts = [(f"/x/{i}.md", 1, f"metin {i}") for i in range(20)]
    streams.ingest_files(store, arrivals(spark, *texts), batch=("s", 0))
    later = [(p, 2, t + " yeni" if i % 3 == 0 else t) for i, (p, _, t) in enumerate(texts)]
    streams.ingest_files(store, arrivals(spark, *later), batch=("s", 1))
    rows, chunks = state(store)
    assert len(rows) == 20 and {t.split("\n")[1] for _, _, t in chunks} == {t for _, _, t in later} and len(chunks) == 40
    data = tmp_path / "store" / "data"
    assert not [f for f in data.iterdir() if f.name.startswith("staged")]
    before = set(data.iterdir())
    streams.ingest_files(store, arrivals(spark, *later), batch=("s", 1))
    assert set(data.iterdir()) == before


def test_store_changes(spark, tmp_path):
    path = str(tmp_path / "store")
    store = Store(spark, path, {"t": ("k long, v string", "k", 8)})
    assert store.table("t").collect() == [] and Store(spark, path).version() == 0
    with pytest.raises(ValueError, match="no store"):
        Store(spark, str(tmp_path / "none"))
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    newer = lambda old, new: old.join(new.select("k"), "k", "left_anti").unionByName(new)
    store.commit(lambda s: [versions.upsert("t", "k", rows(*[(i, f"v{i}") for i in range(100)]), newer)])
    want = {i: f"v{i}" for i in range(100)}
    held = lambda: {r.k: r.v for r in store.table("t").collect()}
    assert held() == want
    before = store.manifest()["tables"]["t"]["folders"]
    store.commit(lambda s: [versions.upsert("t", "k", rows((5, "new")), newer)])
    want[5] = "new"
    assert held() == want
    after = store.manifest()["tables"]["t"]["folders"]
    assert sum(after[b] != before[b] for b in before) == 1
    store.commit(lambda s: [versions.delete("t", "k", rows(*[(i, "") for i in range(0, 100, 2)]).select("k"))])
    assert held() == {k: v for k, v in want.items() if k % 2}
    store.commit(lambda s: [versions.delete("t", "k", s.table("t").select("k"))])
    assert held() == {} and store.table("t", 1).count() == 100
    assert [r.v for r in store.rows_of("t", rows((1, ""))).collect()] == []


def test_a_patch_shuffles_and_writes_only_its_buckets(spark, tmp_path):
    store = stored_registry.registry_store(spark, str(tmp_path / "registry"), "id string, status string, error string, parsed_path string", "id string, doc_id string", buckets=32)
    docs = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.lit("new").alias("status"), F.lit("e").alias("error"), F.lit("p").alias("parsed_path"))
    stored_registry.load(store, documents=docs, chunks=docs.select("id", F.col("id").alias("doc_id")), points=docs.select("id", F.col("id").alias("doc_id")))
    before = store.manifest()["tables"]
    ids = [str(i) for i in range(0, 20_000, 7000)]
    patches = store.staged(spark.createDataFrame([(i, "parsed", None, None) for i in ids], "id string, status string, error string, parsed_path string"))
    change = versions.patch("documents", "id", patches, registry.apply_status)
    plan = change.how(store.table("documents"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    version = stored_registry.set_status(store, patches, batch=("s", 0))
    assert stored_registry.set_status(store, patches, batch=("s", 0)) == version
    after = store.manifest()["tables"]
    moved = [b for b in before["documents"]["folders"] if after["documents"]["folders"][b] != before["documents"]["folders"][b]]
    assert 1 <= len(moved) <= len(ids) and after["chunks"] == before["chunks"]
    rows = {r.id: (r.status, r.error, r.parsed_path) for r in store.table("documents").collect()}
    assert len(rows) == 20_000 and {i for i, r in rows.items() if r == ("parsed", None, "p")} == set(ids)


def test_two_writers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), {"t": ("k long", "k", 4)})
    asked = []

    def mine(s):
        asked.append(s.version())
        if len(asked) == 1:  # another writer is first
            s.commit(lambda o: [versions.Change("t", spark.range(1).withColumnRenamed("id", "k"), lambda old: old.unionByName(spark.range(1).withColumnRenamed("id", "k")))])
        return [versions.Change("t", spark.range(1, 3).withColumnRenamed("id", "k"), lambda old: old.unionByName(spark.range(1, 3).withColumnRenamed("id", "k")))]

    assert store.commit(mine) == 2 and asked == [0, 1]
    assert sorted(r.k for r in store.table("t").collect()) == [0, 1, 2]


# state


JOBS = "job_id string, t int, event string"
HOUR = 3600
#: Passes every watermark.
END = 10**7


def test_jobs_in_any_split(spark, tmp_path):
    rng = random.Random(4)
    rows = [("j", 1, "queued"), ("j", 2, "queued"), ("j", 60, "done"), ("j", 61, "queued"), ("j", 100, "done"), ("k", 5, "done"), ("k", 9, "queued"), ("k", 9, "done"), ("k", 20, "queued")]
    rows += [(f"n{rng.randrange(4)}", rng.randrange(300), rng.choice(["queued", "done"])) for _ in range(80)]
    rows = sorted(set(rows))
    batch = sorted((r.job_id, r.ts, r.event) for r in streams.pending_jobs(at(spark.createDataFrame(rows, JOBS))).collect())
    assert [r[0] for r in batch].count("j") == 2
    shuffled = rng.sample(rows, len(rows))
    for name, batches in (("one", [rows]), ("order", [rows[:30], rows[30:]]), ("mixed", [shuffled[:10], shuffled[10:50], shuffled[50:]])):
        got = played(spark, tmp_path, [*batches, [("end", END, "done")]], JOBS, lambda s: streams.dedupe_jobs(s, "1 hour"), name)
        assert got == batch, name


SESSIONS = "session_id string, document_id long, t int"


def test_sessions_in_any_split(spark, tmp_path):
    rng = random.Random(8)
    rows = [("s", 1, 5), ("s", 1, 11 * HOUR), ("s", 1, 12 * HOUR + 5), ("s", 1, 23 * HOUR), ("s", 2, 5)]
    rows += [(f"r{rng.randrange(3)}", rng.randrange(3), 1 + rng.randrange(60 * HOUR)) for _ in range(60)]
    events = at(spark.createDataFrame(rows, SESSIONS))
    batch = sorted(tuple(r) for r in streams.session_expiries(events).collect())
    first = {}
    for s, d, t in batch:
        first.setdefault((s, d), t)
    assert first == {(r.session_id, r.document_id): r.expires_at for r in streams.session_registry(events).collect()}
    assert len([r for r in batch if r[:2] == ("s", 1)]) == 2
    shuffled = rng.sample(rows, len(rows))
    for name, batches in (("one", [rows]), ("mixed", [shuffled[:20], shuffled[20:25], shuffled[25:]])):
        got = played(spark, tmp_path, [*batches, [("end", 0, END)]], SESSIONS, lambda s: streams.expire_sessions(s, late="100 hours"), name)
        assert got == batch, name


def test_expired_state_is_gone(spark, tmp_path):
    rows = [("s", 1, 5), ("t", 2, HOUR)]
    got = played(spark, tmp_path, [rows, [("end", 0, END)]], SESSIONS, lambda s: streams.expire_sessions(s), "gone")
    assert [r[:2] for r in got] == [("s", 1), ("t", 2)]
    left = [(r.key.session_id) for name in ("held", "until") for r in spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "gone" / "cp")).collect()]
    assert set(left) <= {"end"}
    assert json.dumps(left)
