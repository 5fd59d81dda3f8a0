"""The document registry: changes, patches, queues, archives, audits, repairs.

Plain files have no MERGE, so every change is a function from an old table and a patch to a new table.
Aggregates are combined before their shuffle; a NULL service or key is a group like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as X

RANKS = {"new": 0, "routed": 1, "in_progress": 2, "completed": 3}
UNDETERMINED = "(belirlenemedi)"


def rank_of(c) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), c)


def is_official() -> Column:
    """An attachment of a chat session is no official document and enters no queue."""
    return (F.col("corpus") == "documents") & F.col("session_id").isNull()


def top(df: DataFrame, n: int, by: list, keys: list[str] | None = None) -> DataFrame:
    if keys is None:
        return df.orderBy(*by).limit(n)
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("position") <= n)


# changes and patches


def detect_changes(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``change``: unchanged where path and hash are known and parsed, new where the path is not known, else changed."""
    old = registry.select("path", F.col("hash").alias("old_hash"), F.col("status").alias("old_status"), F.lit(True).alias("known"))
    same = F.col("old_hash").eqNullSafe(F.col("hash")) & (F.col("old_status") == "parsed")
    return incoming.join(old, "path", "left").withColumn("change", F.when(F.col("known").isNull(), "new").when(same, "unchanged").otherwise("changed")).drop("old_hash", "old_status", "known")


def upsert_documents(registry: DataFrame, incoming: DataFrame, now) -> DataFrame:
    """By path: new rows come in as pending; of known ones hash and size change, status and error start anew, id and creation stay."""
    new = incoming.select("path", *[F.col(c).alias(f"n_{c}") for c in ("id", "filename", "format", "size_bytes", "hash")], F.lit(True).alias("came"))
    rows = registry.join(new, "path", "full_outer")
    came = F.coalesce("came", F.lit(False))
    return rows.select(
        F.coalesce("id", "n_id").alias("id"), "path", F.coalesce("filename", "n_filename").alias("filename"), F.coalesce("format", "n_format").alias("format"),
        F.when(came, F.col("n_size_bytes")).otherwise(F.col("size_bytes")).alias("size_bytes"), F.when(came, F.col("n_hash")).otherwise(F.col("hash")).alias("hash"),
        F.when(came, "pending").otherwise(F.col("status")).alias("status"), F.when(~came, F.col("error")).alias("error"),
        F.coalesce("created_at", now).alias("created_at"), F.when(came, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def apply_status(registry: DataFrame, patches: DataFrame) -> DataFrame:
    """Status and error are overwritten (error by NULL too); paths only by paths."""
    p = patches.select("id", F.col("status").alias("p_status"), F.col("error").alias("p_error"), F.col("parsed_path").alias("p_path"), F.lit(True).alias("hit"))
    hit = F.coalesce("hit", F.lit(False))
    return (
        registry.join(p, "id", "left")
        .withColumn("status", F.when(hit, F.col("p_status")).otherwise(F.col("status")))
        .withColumn("error", F.when(hit, F.col("p_error")).otherwise(F.col("error")))
        .withColumn("parsed_path", F.coalesce("p_path", "parsed_path"))
        .drop("p_status", "p_error", "p_path", "hit")
    )


def replace_chunks(existing: DataFrame, fresh: DataFrame, docs: DataFrame) -> DataFrame:
    """The chunks of ``docs`` (ids) are replaced whole by the fresh ones."""
    return existing.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").unionByName(fresh)


def tag_documents(registry: DataFrame, tags: DataFrame) -> DataFrame:
    t = tags.select("id", F.col("corpus").alias("t_corpus"), F.col("session_id").alias("t_session"))
    return registry.join(t, "id", "left").withColumn("corpus", F.coalesce("t_corpus", "corpus")).withColumn("session_id", F.coalesce("t_session", "session_id")).drop("t_corpus", "t_session")


def finalize_classification(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Confidence within 0..1, ten distinct entities at most, review below the threshold, summary of 500 characters."""
    return df.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence"))).withColumn("entities", F.slice(F.array_distinct("entities"), 1, 10)).withColumn("needs_review", F.col("confidence") < threshold).withColumn("summary", F.substring("summary_long", 1, 500))


def analysis_from_row(df: DataFrame) -> DataFrame:
    """A stored analysis with its gaps filled."""
    return df.select(
        "id", F.coalesce("doc_subject", "filename").alias("subject"), F.coalesce("doc_title", "doc_subject", "filename").alias("title"), F.coalesce("summary_long", F.lit("")).alias("summary"),
        F.coalesce("doc_type", F.lit("diger")).alias("doc_type"), F.when(F.col("request").isin(*X.REQUEST_PHRASES), F.col("request")).otherwise("diger").alias("request"), F.coalesce("receivable", F.lit("")).alias("receivable"),
        F.coalesce("people", X.strings()).alias("people"), F.coalesce("contains_pii", F.lit(False)).alias("contains_pii"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


# queues and boards


def service_queue_counts(docs: DataFrame) -> DataFrame:
    done = F.col("lifecycle_status") == "completed"
    return docs.where(is_official() & (F.col("routing_status") != "pending")).groupBy(F.col("routed_service").alias("service"), F.col("routed_unit").alias("unit")).agg(F.count_if(~done).alias("pending"), F.count_if(done).alias("completed"))


def service_queue(docs: DataFrame, n: int = 100) -> DataFrame:
    """Every service's queue, the undetermined under a NULL service: unfinished first, then newest."""
    rows = docs.where(is_official() & (F.col("routed_service").isNotNull() | (F.col("routing_status") == "belirlenemedi")))
    return top(rows, n, [(F.col("lifecycle_status") == "completed").asc(), F.desc("created_at"), F.col("id")], ["routed_service"])


def service_board(catalog: DataFrame, counts: DataFrame, org: str) -> DataFrame:
    """Valid targets of the catalogue with their counts; the undetermined come last, under a NULL service."""
    by_service = counts.groupBy("service").agg(F.sum("pending").alias("pending"), F.sum("completed").alias("completed"))
    valid = catalog.where(~X.is_entry_point(F.col("service")) & X.is_for_org(F.col("article_no"), org))
    filled = valid.join(by_service, "service", "left").select("service", "unit", "article_no", F.coalesce("pending", F.lit(0)).alias("pending"), F.coalesce("completed", F.lit(0)).alias("completed"))
    none = by_service.where("service IS NULL").agg(F.coalesce(F.sum("pending"), F.lit(0)).alias("pending"))
    empty = F.lit(None).cast("string")
    return filled.unionByName(none.select(empty.alias("service"), empty.alias("unit"), empty.alias("article_no"), "pending", F.lit(0).cast("bigint").alias("completed")))


def unit_rollup(board: DataFrame) -> DataFrame:
    """Counts by unit and in total (``unit`` NULL, ``level`` total). The undetermined count in the total alone."""
    unit = F.when(F.col("service").isNull(), F.lit(None)).otherwise(F.regexp_replace(F.coalesce("unit", F.lit("Diğer")), r"^[A-Z]\)\s*", ""))
    rows = board.withColumn("unit_name", unit).groupBy("unit_name").agg(F.count("service").alias("services"), F.sum("pending").alias("pending"), F.sum("completed").alias("completed"))
    units = rows.where("unit_name IS NOT NULL").select(F.lit("unit").alias("level"), F.col("unit_name").alias("unit"), F.when(F.startswith("unit_name", F.lit("Ana")), 0).otherwise(1).alias("place"), "services", "pending", "completed")
    return units.unionByName(rows.agg(F.sum("services").alias("services"), F.sum("pending").alias("pending"), F.sum("completed").alias("completed")).select(F.lit("total").alias("level"), F.lit(None).cast("string").alias("unit"), F.lit(2).alias("place"), "services", "pending", "completed"))


# audits


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where("corpus = 'documents' AND routing_key IS NOT NULL AND routing_status <> 'pending'").withColumn("named", F.coalesce("routed_service", F.lit(UNDETERMINED)))


def routing_inconsistencies(docs: DataFrame) -> DataFrame:
    """``routing_key, services, n_files`` of the keys with several services; their files are those of ``inconsistent_files``.

    Both columns are combined before the shuffle: a key has no more services than the catalogue, however many files it has.
    """
    rows = _keyed(docs).groupBy("routing_key").agg(F.sort_array(F.collect_set("named")).alias("services"), F.count("*").alias("n_files"))
    return rows.where("size(services) > 1")


def inconsistent_files(docs: DataFrame) -> DataFrame:
    """``routing_key, filename, service`` (none where none was found): a row for each file of the keys with several services."""
    rows = _keyed(docs)
    # the least and the greatest name tell whether there are several
    bad = rows.groupBy("routing_key").agg(F.min("named").alias("low"), F.max("named").alias("high")).where("low <> high").select("routing_key")
    return rows.join(bad, "routing_key", "left_semi").select("routing_key", "filename", F.col("routed_service").alias("service"))


def routing_key_report(docs: DataFrame) -> DataFrame:
    """Size and services of every key; routed rows without a key under a NULL key."""
    rows = docs.where("corpus = 'documents' AND routing_status <> 'pending'").withColumn("named", F.coalesce("routed_service", F.lit(UNDETERMINED)))
    return rows.groupBy("routing_key").agg(F.count("*").alias("n_docs"), F.sort_array(F.collect_set(F.when(F.col("routing_key").isNotNull(), F.col("named")))).alias("services"))


def latest_letters(letters: DataFrame) -> DataFrame:
    return letters.groupBy("document_id").agg(F.max_by("decision", F.struct("created_at", "id", "decision")).alias("letter_decision"))


def archive_list(docs: DataFrame, letters: DataFrame, done: bool, n: int = 200) -> DataFrame:
    """Documents with their last decision: that of the completion, else of the latest letter; newest first, unknown dates last."""
    at = F.col("completed_at") if done else F.col("created_at")
    state = (F.col("lifecycle_status") == "completed") if done else (F.col("lifecycle_status") != "completed")
    rows = docs.where(is_official() & state).orderBy(at.desc_nulls_last(), "id").limit(n)
    return rows.join(latest_letters(letters), rows["id"] == F.col("document_id"), "left").withColumn("last_decision", F.coalesce("completed_decision", "letter_decision")).drop("document_id", "letter_decision")


def archive_counts(docs: DataFrame) -> DataFrame:
    done = F.col("lifecycle_status") == "completed"
    return docs.where(is_official()).agg(F.count_if(done).alias("completed"), F.count_if(~done).alias("pending"))


def document_buckets(docs: DataFrame) -> DataFrame:
    bucket = F.when(F.col("lifecycle_status") == "completed", "answered").when(F.col("lifecycle_status") == "in_progress", "in_progress").otherwise("suggestions")
    return docs.where(is_official()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def status_counts(docs: DataFrame) -> DataFrame:
    """Documents by parse status, and all of them under a NULL status."""
    return docs.rollup("status").agg(F.count("*").alias("n"))


def recent_failures(docs: DataFrame, n: int = 10) -> DataFrame:
    return top(docs.where("status = 'failed'"), n, [F.desc("updated_at"), F.col("id")]).select("id", "filename", "error", "updated_at")


def child_counts(chunks: DataFrame) -> DataFrame:
    return chunks.where("kind = 'child'").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("chunk_count"), F.count_if(F.col("embedded_at").isNull()).alias("waiting"))


def document_list(docs: DataFrame, chunks: DataFrame, like: str | None = None) -> DataFrame:
    rows = docs.where(F.col("filename").ilike(f"%{like}%")) if like else docs
    return rows.join(child_counts(chunks), "id", "left").select("id", "filename", "status", "format", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


def readiness(paths: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """How far each asked path is: queued, failed, ready (all its child chunks have vectors) or processing."""
    rows = paths.select("path").join(docs.select("id", "path", "filename", "status", "routed_service"), "path", "left").join(child_counts(chunks), "id", "left")
    stage = F.when(F.col("id").isNull(), "queued").when(F.col("status") == "failed", "failed").when((F.col("chunk_count") > 0) & (F.col("waiting") == 0), "ready").otherwise("processing")
    return rows.select("path", "id", "filename", "routed_service", stage.alias("stage"))


def classification_samples(docs: DataFrame, chunks: DataFrame, force: bool = False) -> DataFrame:
    """The first three child chunks of each parsed document that has no class yet, joined by blank lines."""
    rows = docs.where("status = 'parsed' AND corpus = 'documents'")
    rows = rows if force else rows.where("classified_at IS NULL")
    first = top(chunks.where("kind = 'child'"), 3, [F.col("ordinal"), F.col("text")], ["doc_id"])
    texts = first.groupBy(F.col("doc_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n\n").alias("sample"))
    return rows.join(texts, "id", "left").select("id", "filename", F.coalesce("sample", F.lit("")).alias("sample"))


def gap_scan_backlog(docs: DataFrame, force: bool = False) -> DataFrame:
    rows = docs.where(is_official() & F.col("parsed_path").isNotNull())
    return rows if force else rows.where("gaps_scanned_at IS NULL")


def pipeline_backlog(docs: DataFrame, force: bool = False) -> DataFrame:
    rows = docs.where(is_official() & (F.col("status") == "parsed"))
    return rows if force else rows.where("routing_status = 'pending'")


def classification_summary(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.coalesce("contains_pii", F.lit(False))).alias("pii"), F.count_if(F.coalesce(F.col("confidence") < 0.6, F.lit(False))).alias("low_confidence"))


def gap_summary(docs: DataFrame) -> DataFrame:
    """Findings of each scanned document (``findings array<struct<severity>>``), and how many are critical."""
    return docs.where("findings IS NOT NULL").select("id", F.size("findings").alias("n_findings"), F.size(F.filter("findings", lambda f: f["severity"] == "kritik")).alias("n_critical"))


def chunk_preview(chunks: DataFrame, docs: DataFrame, like: str, cut: int = 600) -> DataFrame:
    """Chunks of the documents whose name is like it: parents first, then in order, unsectioned first."""
    hit = docs.where(F.col("filename").ilike(f"%{like}%")).select(F.col("id").alias("doc_id"), "filename")
    rows = chunks.join(hit, "doc_id")
    order = Window.partitionBy("doc_id").orderBy(F.desc("kind"), "ordinal", F.asc_nulls_first("section"), "text", "token_count")
    return rows.select("doc_id", "filename", F.row_number().over(order).alias("line"), "kind", "section", "token_count", F.substring("text", 1, cut).alias("text"))


# drift, inventory, purge, back-fill


def index_orphans(points: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Points ``id, doc_id`` without a document, and points of documents without their chunk."""
    gone = points.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    loose = points.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").join(chunks.select("id"), "id", "left_anti")
    return gone.select("id", "doc_id", F.lit("no document").alias("reason")).unionByName(loose.select("id", "doc_id", F.lit("no chunk").alias("reason")))


def drop_orphans(points: DataFrame, orphans: DataFrame) -> DataFrame:
    return points.join(orphans.select("id"), "id", "left_anti")


def corpus_inventory(tables: dict[str, tuple[DataFrame, str]], docs: DataFrame, corpus: str | None = None) -> DataFrame:
    """Rows of each table (name: table, column of the document's id) that belong to a corpus, or to any document."""
    own = docs if corpus is None else docs.where(F.col("corpus") == corpus)
    out = own.agg(F.count("*").alias("n")).select(F.lit("documents").alias("table_name"), "n")
    for name, (table, column) in tables.items():
        kept = table.join(own.select(F.col("id").alias(column)), column, "left_semi")
        out = out.unionByName(kept.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n"))
    return out


def purge_corpus(tables: dict[str, tuple[DataFrame, str]], docs: DataFrame, corpus: str | None = None) -> dict[str, DataFrame]:
    """All tables without a corpus' documents and what hangs on them."""
    gone = (docs if corpus is None else docs.where(F.col("corpus") == corpus)).select("id")
    out = {"documents": docs.join(gone, "id", "left_anti")}
    for name, (table, column) in tables.items():
        out[name] = table.join(gone.withColumnRenamed("id", column), column, "left_anti")
    return out


def backfill_lifecycle(docs: DataFrame) -> DataFrame:
    return docs.withColumn("lifecycle_status", F.when((F.col("lifecycle_status") == "new") & (F.col("routing_status") == "routed"), "routed").otherwise(F.col("lifecycle_status")))


ROUTING_COLUMNS = ("routed_service", "routed_unit", "routing_confidence", "routing_reasoning", "routing_key")


def backfill_sessions(docs: DataFrame, uploads: DataFrame) -> DataFrame:
    """Binds attachments to their (first) session and takes their routing away."""
    bound = uploads.groupBy(F.col("document_id").alias("id")).agg(F.min("session_id").alias("bound"))
    rows = docs.join(bound, "id", "left").withColumn("session_id", F.coalesce("session_id", "bound")).drop("bound")
    wrong = F.col("session_id").isNotNull() & (F.col("routing_status") != "pending")
    rows = rows.withColumn("wrong", wrong)
    for c in ROUTING_COLUMNS:
        if c in docs.columns:
            rows = rows.withColumn(c, F.when(~F.col("wrong"), F.col(c)))
    return rows.withColumn("routing_status", F.when(F.col("wrong"), "pending").otherwise(F.col("routing_status"))).withColumn("lifecycle_status", F.when(F.col("wrong"), "new").otherwise(F.col("lifecycle_status"))).drop("wrong")


def session_documents(docs: DataFrame, session: str, without=None) -> DataFrame:
    rows = docs.where(F.col("session_id") == session)
    return (rows if without is None else rows.where(F.col("id") != without)).select("id")


def split_official(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return docs.where("session_id IS NULL"), docs.where("session_id IS NOT NULL")
