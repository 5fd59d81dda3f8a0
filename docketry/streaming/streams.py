"""Arrivals and events as streams, with the batch forms that they must agree with."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docketry.operators import chunking
from docketry.operators.registry import RANKS, apply_status, detect_changes, rank_of, upsert_documents
from docketry.sources import versions
from docketry.sources.files import scan_files, with_file_identity
from docketry.sources.versions import Change, Store


def lifecycle_state(events: DataFrame) -> DataFrame:
    """``document_id, lifecycle_status, completed_at, completed_decision`` from ``document_id, ts, status, decision``.

    The status only moves up, so it is the highest one seen; time and decision are those of the first completion.
    Order does not matter, so the same aggregation serves a batch and a stream in update mode.
    """
    done = F.col("status") == "completed"
    state = events.groupBy("document_id").agg(F.max(rank_of(F.col("status"))).alias("rank"), F.min(F.when(done, F.col("ts"))).alias("completed_at"), F.min_by("decision", F.when(done, F.col("ts"))).alias("decision"))
    names = F.array(*map(F.lit, RANKS))
    return state.select("document_id", F.element_at(names, F.col("rank") + 1).alias("lifecycle_status"), "completed_at", F.when(F.col("completed_at").isNotNull(), F.col("decision")).alias("completed_decision"))


def session_registry(events: DataFrame, ttl_hours: int = 12) -> DataFrame:
    """``session_id, document_id, expires_at``: the first upload of a pair counts, later ones change nothing."""
    return events.groupBy("session_id", "document_id").agg((F.min("ts") + F.expr(f"INTERVAL {ttl_hours} HOURS")).alias("expires_at"))


def active_sessions(registry: DataFrame, as_of) -> DataFrame:
    return registry.where(F.col("expires_at") > as_of)


def pending_jobs(events: DataFrame) -> DataFrame:
    """Of ``job_id, ts, event`` (queued, done): jobs to run, one for each request that found no pending one."""
    order = Window.partitionBy("job_id").orderBy("ts", "event")
    before = F.lag("event").over(order)
    return events.withColumn("runs", (F.col("event") == "queued") & (before.isNull() | (before == "done"))).where("runs").drop("runs")


class _InOrder(StatefulProcessor):
    """Events of a key, handed on in the order of their times once the watermark has passed them.

    What the order of arrival or the cut into micro-batches is makes no difference to the result. Held are events that the
    watermark has not reached; a subclass keeps what it must know of the earlier ones, and says so in ``settled``.
    """

    event = "string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "us bigint, event string", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for us, event in zip(_micros(pdf["ts"]), self.named(pdf)):
                self.held.updateValue((us, event), (1,))
                # a timer is in whole milliseconds: the first that is not before the event
                self.handle.registerTimer(-(-us // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed, whichever timer is the first to say so
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted((us, event) for us, event in self.held.keys() if -(-us // 1000) <= now)
        for k in due:
            self.held.removeKey(k)
        yield from self.settled(key, due, now)

    def named(self, pdf: pd.DataFrame) -> list[str]:
        return pdf["event"].tolist()

    def close(self) -> None:
        pass


def _micros(ts: pd.Series) -> list[int]:
    return ts.astype("datetime64[us]").astype("int64").tolist()


class _Jobs(_InOrder):
    """A request runs where no earlier one is pending; ``done`` ends what is pending. Kept is one row for each pending job."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pending = handle.getValueState("pending", "since bigint")

    def settled(self, key, due: list[tuple[int, str]], now: int) -> Iterator[pd.DataFrame]:
        runs, pending = [], self.pending.exists()
        before = pending
        since = self.pending.get()[0] if pending else None
        for us, event in due:
            if event == "queued" and not pending:
                runs.append(us)
                pending, since = True, us
            elif event == "done":
                pending = False
        if pending:
            self.pending.update((since,))
        elif before:
            self.pending.clear()
        if runs:
            yield pd.DataFrame({"job_id": [key[0]] * len(runs), "ts": pd.to_datetime(runs, unit="us"), "event": ["queued"] * len(runs)})


class _Sessions(_InOrder):
    """The first upload of a pair attaches it for a time; uploads meanwhile change nothing, one after it attaches it anew."""

    hours = 12

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.until = handle.getValueState("until", "us bigint")

    def named(self, pdf: pd.DataFrame) -> list[str]:
        return [""] * len(pdf)

    def settled(self, key, due: list[tuple[int, str]], now: int) -> Iterator[pd.DataFrame]:
        until, ended = (self.until.get()[0] if self.until.exists() else None), []
        before = until
        for us, _ in due:
            if until is not None and us >= until:
                ended.append(until)
                until = None
            if until is None:
                until = us + self.hours * 3_600_000_000
                self.handle.registerTimer(-(-until // 1000))
        if until is not None and -(-until // 1000) <= now:
            ended.append(until)
            until = None
        if until is not None:
            self.until.update((until,))
        elif before is not None:
            self.until.clear()
        if ended:
            yield pd.DataFrame({"session_id": [key[0]] * len(ended), "document_id": [key[1]] * len(ended), "expires_at": pd.to_datetime(ended, unit="us")})


#: The state store that keyed state with timers needs; set for the session before a stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def dedupe_jobs(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    """``pending_jobs`` on a stream of ``job_id, ts, event``: the requests to run, whatever the micro-batches.

    A request is answered when the watermark (``late`` behind the newest event) has passed it. Nulls and other events are left out.
    """
    stream.sparkSession.conf.set(*STATE_STORE)
    rows = stream.select("job_id", "ts", "event").where("job_id IS NOT NULL AND ts IS NOT NULL AND event IN ('queued', 'done')").withWatermark("ts", late)
    return rows.groupBy("job_id").transformWithStateInPandas(_Jobs(), f"job_id {_kind(stream, 'job_id')}, ts timestamp, event string", "Append", "EventTime")


def session_expiries(events: DataFrame, ttl_hours: int = 12) -> DataFrame:
    """``session_id, document_id, expires_at``: each attachment of a pair when it ends. An upload while one lasts changes nothing,
    one after its end begins the next. A pair's own uploads are sorted in one row."""
    times = F.sort_array(F.collect_set(F.unix_micros("ts")))
    span = ttl_hours * 3_600_000_000
    begun = F.aggregate(times, F.array().cast("array<bigint>"), lambda a, t: F.when((F.size(a) > 0) & (t < F.try_element_at(a, F.lit(-1))), a).otherwise(F.concat(a, F.array(t + span))))
    rows = events.where("session_id IS NOT NULL AND document_id IS NOT NULL AND ts IS NOT NULL").groupBy("session_id", "document_id").agg(begun.alias("ends"))
    return rows.select("session_id", "document_id", F.explode("ends").alias("us")).select("session_id", "document_id", F.timestamp_micros("us").alias("expires_at"))


def expire_sessions(stream: DataFrame, ttl_hours: int = 12, late: str = "1 minute") -> DataFrame:
    """``session_expiries`` on a stream: a row when an attachment ends, after which nothing of it is kept."""
    stream.sparkSession.conf.set(*STATE_STORE)
    processor = _Sessions()
    processor.hours = ttl_hours
    rows = stream.select("session_id", "document_id", "ts").where("session_id IS NOT NULL AND document_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    kinds = f"session_id {_kind(stream, 'session_id')}, document_id {_kind(stream, 'document_id')}, expires_at timestamp"
    return rows.groupBy("session_id", "document_id").transformWithStateInPandas(processor, kinds, "Append", "EventTime")


# arrivals


REGISTRY = "id string, path string, filename string, format string, size_bytes bigint, hash string, status string, error string, created_at timestamp, updated_at timestamp"
FILES = "path string, modificationTime timestamp, length long, content binary"


def document_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    """The registry (by path) and the chunks (by document) of ingested files, under one manifest."""
    return Store(spark, path, {"registry": (REGISTRY, "path", buckets), "chunks": (chunking.CHUNKS, "doc_id", buckets)})


def ingest_files(store: Store, arrivals: DataFrame, now: Column | None = None, batch: tuple[str, int] | None = None, document_path: Column | None = None) -> int:
    """Text files (``path, modificationTime, length, content``) into registry and chunks, as one version; returns its number.

    Of several arrivals of one document the newest counts. What is known with the same hash and parsed is left alone. New files get a row,
    changed ones keep id and creation time (S5), and the chunks of both give way to those of the new text (S7). ``document_path`` tells
    a document from the path of its arrival, where new states of a document arrive under other names. Bytes that are no UTF-8 become U+FFFD.
    """
    if batch is not None and store.manifest()["batches"].get(batch[0], -1) >= batch[1] or arrivals.isEmpty():
        return store.version()
    now = F.current_timestamp() if now is None else now
    named = arrivals.withColumn("path", document_path) if document_path is not None else arrivals
    newest = named.groupBy("path").agg(F.max_by(F.struct("length", "content"), F.struct("modificationTime", F.sha2("content", 256))).alias("f")).select("path", "f.*")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    rows = with_file_identity(newest, text.alias("text")).withColumnRenamed("job_id", "id").withColumn("now", now)
    staged = []

    def changes(store: Store) -> list[Change]:
        known = store.rows_of("registry", named.select("path"))
        work = detect_changes(rows, known).where("change <> 'unchanged'").drop("change")
        work = work.join(known.select("path", F.col("id").alias("known_id")), "path", "left").withColumn("id", F.coalesce("known_id", "id")).drop("known_id")
        # written once, without what is unchanged: what is read of a file must be the same for the registry and the chunks. Where the
        # texts lie by the bucket of their chunks, the chunks, which are larger, need not be shuffled
        folder, work = store.written(store.dealt("chunks", work, "id"), compression="zstd")
        staged.append(folder)
        stamp = work.agg(F.max("now")).first()[0]
        if stamp is None:
            return []
        parsed = work.select("id", F.lit("parsed").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("parsed_path"))

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            return apply_status(upsert_documents(old, new, F.lit(stamp)).withColumn("parsed_path", F.lit(None).cast("string")), parsed)

        fresh = chunking.chunk_documents(work.select("id", "filename", "text"))
        docs = work.select(F.col("id").alias("doc_id"))
        return [versions.upsert("registry", "path", work.drop("text", "now"), merged), *versions.exchange("chunks", "doc_id", docs, fresh)]

    try:
        return store.commit(changes, batch)
    finally:
        for folder in staged:
            store.dropped(folder)


def ingest_folder(store: Store, folder: str, batch: tuple[str, int] | None = None) -> int:
    """One pass over a folder: files that are new or have changed since the last one."""
    return ingest_files(store, scan_files(store.spark, folder, (".txt", ".md")), batch=batch)


def ingest_stream(store: Store, folder: str, checkpoint: str, name: str = "arrivals", max_files: int = 1000, document_path: Column | None = None):
    """Text files that arrive in ``folder`` become registry rows and chunks; returns the query.

    Each micro-batch is one version of the store and carries its number under ``name``: one that is run again changes nothing, one
    that fails leaves the last version. A file source takes a path once; files rewritten in place are the work of ``ingest_folder``, and
    new states that arrive under new paths are told by ``document_path``.
    """
    files = store.spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        ingest_files(store, batch, batch=(name, number), document_path=document_path)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
