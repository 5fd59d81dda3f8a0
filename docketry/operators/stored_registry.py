"""The registry as stored tables: documents, chunks and index points in buckets by document, changed in place.

Each job touches the buckets of the documents it is about, and writes all tables it changes as one version. The changes themselves are those of
``registry``; here they meet only the rows of touched buckets. A patch is written down first, so Spark knows its size: a small one is sent to the
tasks that read the buckets, and the tables are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import registry
from docketry.sources import versions
from docketry.sources.versions import Store


def registry_store(spark: SparkSession, path: str, documents: str, chunks: str, points: str = "id string, doc_id string", buckets: int = 256) -> Store:
    """Tables ``documents`` (by ``id``), ``chunks`` and ``points`` (by ``doc_id``) with the given columns."""
    return Store(spark, path, {"documents": (documents, "id", buckets), "chunks": (chunks, "doc_id", buckets), "points": (points, "doc_id", buckets)})


def load(store: Store, **tables: DataFrame) -> int:
    """Add whole tables, as they are."""
    return store.commit(lambda s: [versions.append(name, rows) for name, rows in tables.items()])


def set_status(store: Store, patches: DataFrame, batch: tuple[str, int] | None = None) -> int:
    """``registry.apply_status`` of ``id, status, error, parsed_path``."""
    rows = store.staged(patches)
    return store.commit(lambda s: [versions.patch("documents", "id", rows, registry.apply_status)], batch)


def tag(store: Store, tags: DataFrame, batch: tuple[str, int] | None = None) -> int:
    """``registry.tag_documents`` of ``id, corpus, session_id``."""
    rows = store.staged(tags)
    return store.commit(lambda s: [versions.patch("documents", "id", rows, registry.tag_documents)], batch)


def replace_chunks(store: Store, docs: DataFrame, fresh: DataFrame, batch: tuple[str, int] | None = None) -> int:
    """The chunks of ``docs`` (``id``) are replaced whole, and the points of chunks that are gone go with them."""
    ids, rows = store.staged(docs.select(F.col("id").alias("doc_id"))), store.staged(fresh)
    backed = lambda old: old.join(ids, "doc_id", "left_anti").unionByName(old.join(rows.select("doc_id", "id"), ["doc_id", "id"], "left_semi"))
    return store.commit(lambda s: [versions.replace("chunks", "doc_id", ids, rows), versions.Change("points", ids, backed, stays=True)], batch)


def drift(store: Store) -> DataFrame:
    """``registry.index_orphans`` of the current version."""
    return registry.index_orphans(store.table("points"), store.table("documents"), store.table("chunks"))


def repair_drift(store: Store, batch: tuple[str, int] | None = None) -> int:
    """Drop the points that nothing stands behind."""

    def changes(s: Store) -> list:
        orphans = s.staged(drift(s))
        return [versions.Change("points", orphans.select("doc_id"), lambda old: registry.drop_orphans(old, orphans), stays=True)]

    return store.commit(changes, batch)


def purge(store: Store, corpus: str | None = None, batch: tuple[str, int] | None = None) -> int:
    """Take a corpus' documents out, with their chunks and points, in one step; without a corpus, everything."""

    def changes(s: Store) -> list:
        docs = s.table("documents")
        gone = s.staged((docs if corpus is None else docs.where(F.col("corpus") == corpus)).select("id", F.col("id").alias("doc_id")))
        return [versions.delete("documents", "id", gone), versions.delete("chunks", "doc_id", gone), versions.delete("points", "doc_id", gone)]

    return store.commit(changes, batch)
