"""A stored sparse index: term weights written once, with block maxima, and searched any number of times for an exact top k.

Chunks are indexed where they lie, in shards of about ``SHARD_CHUNKS``. A shard has a posting list for each of its terms, cut at every
``RANGE`` chunks, and the largest weight of each such block. Statistics of terms are kept as deltas beside the shards
(``term_id, df``; the number of chunks under ``ALL``), so adding or removing chunks reads no other shard. Shards, deltas and what was removed
change together, as one version of a ``Store``.

A search sends blocks of queries to all shards. Of a query and a shard the block maxima give each range of chunks a bound; ranges are
scored from the best bound on, and once a bound is below the k-th score so far, that range and all after it are skipped. Within the others only the
lists of terms without which no chunk can reach that score are read; the rest are looked up for the chunks found in these, while they can
still reach it. Nothing that could win is left out, so the result is that of scoring everything. A task carries its best k from shard to shard and hands on no more
than k rows a query: no row is made for a pair of query and chunk that cannot win.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import text as X
from docketry.operators.search import AVERAGE, CANDIDATES, K1, B, ranked, slices, sparse_postings, term_counter
from docketry.sources.scratch import small_batches
from docketry.sources.versions import Store, adopt, append, replace

#: Chunks of a shard, and of one range of it; postings that close a shard before it has so many chunks.
SHARD_CHUNKS, RANGE, SHARD_POSTINGS = 4096, 64, 1 << 18
#: The term id under which the number of chunks is counted.
ALL = -1
#: Scores are rounded to so many places, as everywhere; a bound may fall short of a score by half a unit of the last one.
PLACES, SLACK = 6, 1e-6
#: Rows (query, term) that are sent to all tasks at once.
BLOCK_TERMS = 1 << 17
ARRAYS = {
    "terms": np.uint32, "first_block": np.int32,  # terms of the shard, sorted, and where the blocks of each begin
    "block_range": np.uint16, "block_begin": np.int32, "block_most": np.float32,  # by block: its range, its first posting, its largest weight, rounded up
    "docs": np.int32, "weights": np.float64,  # by posting
}
#: Bytes of a row group of shards: a task that reads or writes them holds a few of these.
SHARD_GROUP_BYTES = 4 << 20


def _schema(kind: str, payload: str) -> str:
    return f"shard string, ids array<{kind}>, payload array<{payload}>, " + ", ".join(f"{a} binary" for a in ARRAYS)


def _unpacked(batch: pa.RecordBatch, i: int) -> dict:
    # wide numbers again, once a shard and not for each query
    wide = {"terms": np.int64, "block_most": np.float64}
    return {a: np.frombuffer(batch.column(a)[i].as_buffer(), kind).astype(wide.get(a, kind), copy=False) for a, kind in ARRAYS.items()}


def _places(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    size = last - first
    return np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())


def _arrays(docs: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> dict:
    """Posting lists and block maxima of a shard's ``(place of the chunk, term id, weight)``."""
    by = np.lexsort((docs, ids))
    docs, ids, weights = docs[by], ids[by], weights[by]
    where = docs // RANGE
    head = np.append(True, (np.diff(ids) != 0) | (np.diff(where) != 0)) if len(ids) else np.zeros(0, bool)
    begin = np.flatnonzero(head)
    terms, first_block = np.unique(ids[begin], return_index=True)
    most = np.maximum.reduceat(weights, begin) if len(begin) else weights
    # the next larger number where the nearest one is smaller, so that a bound stays a bound
    near = most.astype(np.float32)
    near = np.where(near < most, np.nextafter(near, np.float32(np.inf)), near)
    return {"terms": terms, "first_block": np.append(first_block, len(begin)), "block_range": where[begin], "block_begin": np.append(begin, len(ids)), "block_most": near, "docs": docs, "weights": weights}


def _sharded(chunks: DataFrame, payload: list[str], k1: float, b: float, average: float) -> DataFrame:
    kept = F.struct(*payload) if payload else F.struct(F.lit(True).alias("any"))
    rows = chunks.select(F.col("id").alias("chunk_id"), X.term_text("text").alias("words"), kept.alias("payload"))
    count = term_counter(k1, b, average)
    schema = _schema(rows.schema["chunk_id"].dataType.simpleString(), rows.schema["payload"].dataType.simpleString())

    def shard(held: list) -> pa.RecordBatch:
        size = np.cumsum([0, *(len(h[0]) for h in held)])
        arrays = _arrays(*(np.concatenate(x) for x in ([h[2] + np.int32(n) for h, n in zip(held, size)], [h[3] for h in held], [h[4] for h in held])))
        lists = [pa.ListArray.from_arrays(pa.array([0, size[-1]], pa.int32()), pa.concat_arrays([h[c] for h in held])) for c in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *lists, *[pa.array([np.ascontiguousarray(arrays[a], kind).tobytes()], pa.binary()) for a, kind in ARRAYS.items()]], names=["shard", "ids", "payload", *ARRAYS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, postings = [], 0, 0
        for batch in batches:
            for part in slices(batch, "words", rows=SHARD_CHUNKS):
                at, _, ids, weights = count(part.column("words"))
                if held and (size + part.num_rows > SHARD_CHUNKS or postings + len(ids) > SHARD_POSTINGS):
                    yield shard(held)
                    held, size, postings = [], 0, 0
                # copies, as a slice keeps the whole batch
                own = [part.column(c).take(pa.array(range(part.num_rows))) for c in ("chunk_id", "payload")]
                held.append((*own, np.asarray(at, np.int32), np.asarray(ids, np.int64), np.asarray(weights, np.float64)))
                size, postings = size + part.num_rows, postings + len(ids)
        if held:
            yield shard(held)

    return rows.mapInArrow(run, schema)


class _Best:
    """The k best chunks so far of each query of a block."""

    def __init__(self, queries: list[tuple], k: int):
        self.queries, self.k = queries, k
        self.top: list[list[tuple]] = [[] for _ in queries]
        self.postings = self.read = 0

    def add(self, ids: pa.Array, shard: dict, allowed: np.ndarray | None, scope_of: np.ndarray | None) -> None:
        terms, n = shard["terms"], len(ids)
        if not len(terms):
            return
        ranges = -(-n // RANGE)
        masks: dict = {}
        for q, (asked, weights, scope) in enumerate(self.queries):
            at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
            known = terms[at] == asked
            at, own = at[known], weights[known]
            if not len(at):
                continue
            if scope is None or scope_of is None:
                may = allowed
            else:
                if scope not in masks:
                    own_scope = scope_of == scope
                    masks[scope] = own_scope if allowed is None else own_scope & allowed
                may = masks[scope]
                if not may.any():
                    continue
            first, last = shard["first_block"][at], shard["first_block"][at + 1]
            blocks = _places(first, last)
            most = own * np.maximum.reduceat(shard["block_most"][blocks], np.append(0, np.cumsum(last - first)[:-1]))
            # the terms that can give most come first; what those from each on can give together
            by = np.argsort(-most, kind="stable")
            own, first, last = own[by], first[by], last[by]
            left = np.append(np.cumsum(most[by][::-1])[::-1], 0.0)
            blocks, nth = _places(first, last), np.repeat(np.arange(len(by)), last - first)
            where = shard["block_range"][blocks]
            bounds = np.bincount(where, own[nth] * shard["block_most"][blocks], ranges)
            if may is not None:
                bounds[np.add.reduceat(may, np.arange(0, n, RANGE)) == 0] = 0
            begin, end = shard["block_begin"][blocks], shard["block_begin"][blocks + 1]
            self.postings += int((end - begin).sum())
            order = np.argsort(-bounds, kind="stable")
            done = 0
            while done < ranges:
                # twice as many ranges each time, as the k-th score rises
                floor = self._floor(q) - SLACK
                turn = order[done : 2 * done + 1]
                turn = turn[(bounds[turn] > 0) & (bounds[turn] >= floor)]
                if not len(turn):
                    break
                # a chunk with none of the first terms cannot reach the k-th score with all the others
                needed = int((left[:-1] >= floor).sum())
                open_ = np.isin(where, turn) & (nth < needed)
                places = _places(begin[open_], end[open_])
                self.read += len(places)
                scores = np.bincount(shard["docs"][places], np.repeat(own[nth[open_]], (end - begin)[open_]) * shard["weights"][places], n)
                if may is not None:
                    scores[~may] = 0
                found = np.flatnonzero(scores)
                self._take(q, ids, *self._completed(shard, found, scores[found], own, first, last, left, needed, floor))
                done = 2 * done + 1

    def _completed(self, shard: dict, found: np.ndarray, scores: np.ndarray, own: np.ndarray, first: np.ndarray, last: np.ndarray, left: np.ndarray, needed: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Chunks with what the other terms give them, looked up one term at a time for those that can still reach the k-th score."""
        for j in range(needed, len(own)):
            keep = scores + left[j] >= floor
            found, scores = found[keep], scores[keep]
            if not len(found):
                break
            lo, hi = shard["block_begin"][first[j]], shard["block_begin"][last[j]]
            at = np.searchsorted(shard["docs"][lo:hi], found)
            at[at == hi - lo] = 0
            hit = shard["docs"][lo + at] == found
            scores[hit] += own[j] * shard["weights"][lo + at[hit]]
            self.read += len(found)
        return found, np.round(scores, PLACES)

    def _floor(self, q: int) -> float:
        return self.top[q][-1][0] if len(self.top[q]) == self.k else 0.0

    def _take(self, q: int, ids: pa.Array, places: np.ndarray, scores: np.ndarray) -> None:
        keep = (scores >= self._floor(q)) & (scores > 0)
        places, scores = places[keep], scores[keep]
        if len(places) > self.k:
            # of equal scores any can have the smaller id, so all of them are kept for now
            least = np.partition(scores, len(places) - self.k)[len(places) - self.k]
            places, scores = places[scores >= least], scores[scores >= least]
        new = [(float(s), ids[int(i)].as_py()) for i, s in zip(places, scores)]
        self.top[q] = sorted(self.top[q] + new, key=lambda x: (-x[0], x[1]))[: self.k]


class SparseIndex:
    """The index at ``path``; it is made where there is none, from chunks with the id type ``kind`` and the columns ``payload`` (a struct's DDL)."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "string", payload: str | None = None):
        tables = {"shards": (_schema(kind, payload or "struct<any:boolean>"), "shard", 1), "terms": ("term_id bigint, df bigint", "term_id", 16), "gone": ("shard string, place int", "shard", 1)}
        self.spark, self.store = spark, Store(spark, path, tables)
        self.kind = self.store.schema("shards")["ids"].dataType.elementType.simpleString()
        self.payload = self.store.schema("shards")["payload"].dataType.elementType.names

    def add(self, chunks: DataFrame, k1: float = K1, b: float = B, average: float = AVERAGE, batch: tuple[str, int] | None = None) -> None:
        """Index ``id, text`` and the payload's columns. Chunks whose id is there already take its place."""
        payload = [c for c in self.payload if c != "any"]
        with small_batches(self.spark):
            # written once: the table takes the files as they are
            rows = _sharded(chunks, payload, k1, b, average)
            folder, fresh = self.store.written(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.store.schema("shards")]), SHARD_GROUP_BYTES)

        def changes(store: Store):
            ids = fresh.select(F.explode("ids").alias("chunk_id"))
            return [*self._removal(ids), adopt("shards", folder), append("terms", _deltas(fresh))]

        with small_batches(self.spark):
            self.store.commit(changes, batch)

    def remove(self, ids: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Take chunks (``chunk_id``) out of the index."""
        with small_batches(self.spark):
            self.store.commit(lambda store: self._removal(ids), batch)

    def _removal(self, ids: DataFrame) -> list:
        if not self.store.filled("shards"):
            return []
        # a chunk's place stands once in gone, so that it is not counted off twice
        places = self._live().select("shard", F.posexplode("ids").alias("place", "chunk_id"), "out").where(~F.coalesce(F.array_contains("out", F.col("place")), F.lit(False)))
        hit = self.store.staged(places.join(ids.select(F.col("chunk_id").cast(self.kind)).distinct(), "chunk_id", "left_semi").select("shard", "place"))
        if hit.isEmpty():
            return []
        touched = self.store.table("shards").join(hit.groupBy("shard").agg(F.collect_list("place").alias("places")), "shard")
        return [append("gone", hit), append("terms", _deltas(touched))]

    def _live(self) -> DataFrame:
        """Shards with ``out``: the places in them that were removed (no more than a shard has)."""
        shards = self.store.table("shards")
        if not self.store.filled("gone"):
            return shards.withColumn("out", F.lit(None).cast("array<int>"))
        return shards.join(self.store.table("gone").groupBy("shard").agg(F.collect_set("place").alias("out")), "shard", "left")

    def compact(self) -> None:
        """Sum up the deltas of terms, which otherwise grow with each change."""
        ids = self.store.table("terms").select("term_id")
        self.store.commit(lambda store: [replace("terms", "term_id", ids, self.idf_counts())])

    def idf_counts(self) -> DataFrame:
        return self.store.table("terms").groupBy("term_id").agg(F.sum("df").alias("df")).where("df > 0")

    def size(self) -> int:
        return int(self.store.table("terms").where(F.col("term_id") == ALL).agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0])

    def idf(self) -> DataFrame:
        """``term_id, df, idf`` over all indexed chunks, those without terms included."""
        n = self.size()
        return self.idf_counts().where(F.col("term_id") != ALL).select("term_id", "df", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))

    def search(self, queries: DataFrame, k: int = CANDIDATES, allowed: Callable[[Callable[[str], Column]], Column] | None = None, scopes: DataFrame | None = None, scope: str = "doc_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
        """``query_id, chunk_id, score, rank``: the k best chunks of ``id, text`` queries.

        ``allowed`` chooses the candidates: it is given a function from payload columns to columns (as ``search.passes`` makes). With ``scopes``
        (``query_id, <scope>``) there is a top k for each pair, among the chunks with that value, and the value in the result.
        """
        hits, asked = self._searched(queries, k, allowed, scopes, scope, block_terms)
        keys = ["query_id"] if scopes is None else ["query_id", scope]
        if hits is None:
            kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id {self.kind}, score double, rank int"
            empty = self.spark.createDataFrame([], kinds)
            return empty if scopes is None else empty.withColumn(scope, F.lit(None).cast(scopes.schema[scope].dataType)).select("query_id", scope, "chunk_id", "score", "rank")
        best = hits.where("chunk_id IS NOT NULL").select(*keys, "chunk_id", "score")
        # written down, so that Spark knows how few they are: what they are joined to is not shuffled for them
        return self.store.staged(ranked(best, [F.desc("score"), F.col("chunk_id")], keys).where(F.col("rank") <= k))

    def skipped(self, queries: DataFrame, k: int = CANDIDATES) -> float:
        """The share of the queries' postings that a search does not read."""
        hits, _ = self._searched(queries, k, None, None, "", BLOCK_TERMS)
        n = hits.where("chunk_id IS NULL").agg(F.sum("postings").alias("postings"), F.sum("read").alias("read")).first()
        return 1 - n.read / n.postings

    def _searched(self, queries: DataFrame, k: int, allowed, scopes: DataFrame | None, scope: str, block_terms: int) -> tuple[DataFrame | None, DataFrame]:
        terms = sparse_postings(queries).select(F.col("chunk_id").alias("query_id"), "term_id", F.col("weight").alias("q"))
        weighed = terms.join(self.idf().select("term_id", "idf"), "term_id").select("query_id", "term_id", (F.col("q") * F.col("idf")).alias("w"))
        if scopes is not None:
            weighed = weighed.join(scopes.select("query_id", F.col(scope).alias("scope")).where("scope IS NOT NULL").distinct(), "query_id")
        else:
            weighed = weighed.withColumn("scope", F.lit(None).cast("string"))
        weighed = self.store.staged(weighed)
        rounds = -(-weighed.count() // block_terms)
        if not rounds or not self.store.filled("shards"):
            return None, weighed
        shards = self._live()
        kept = (lambda p: allowed(lambda c: p[c])) if allowed is not None else (lambda p: F.lit(True))
        shards = shards.withColumn("may", F.transform("payload", lambda p, i: F.coalesce(kept(p), F.lit(False)) & ~F.coalesce(F.array_contains("out", i), F.lit(False))))
        of = F.transform("payload", lambda p: p[scope].cast("string")) if scopes is not None else F.lit(None).cast("array<string>")
        shards = shards.select("ids", "may", of.alias("scope_of"), *ARRAYS)
        id_kind, scope_kind = weighed.schema["query_id"].dataType.simpleString(), weighed.schema["scope"].dataType.simpleString()
        out = None
        for n in range(rounds):
            own = weighed.where(F.pmod(F.xxhash64("query_id", F.lit(17)), F.lit(rounds)) == n).groupBy("query_id", "scope").agg(F.sort_array(F.collect_list(F.struct("term_id", "w"))).alias("t"))
            names = own.select("query_id", "scope", F.transform("t", lambda t: t["term_id"]).alias("terms"), F.transform("t", lambda t: t["w"]).alias("weights")).toArrow()
            if not names.num_rows:
                continue
            asked = [(np.asarray(t, np.int64), np.asarray(w, np.float64), None if s is None else str(s)) for t, w, s in zip(names.column("terms").to_pylist(), names.column("weights").to_pylist(), names.column("scope").to_pylist())]
            sent = self.spark.sparkContext.broadcast((asked, names.select(["query_id", "scope"])))

            def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                asked, names = sent.value
                best = _Best(asked, k)
                chunk_kind = None
                for batch in batches:
                    chunk_kind = batch.column("ids").type.value_type
                    for i in range(batch.num_rows):
                        may = batch.column("may")[i].values.to_numpy(zero_copy_only=False)
                        scope_of = batch.column("scope_of")[i].values
                        best.add(batch.column("ids")[i].values, _unpacked(batch, i), None if may.all() else may, None if scope_of is None else np.array(scope_of.to_pylist(), object))
                if chunk_kind is None:
                    return
                many = [len(t) for t in best.top]
                at = pa.array(np.repeat(np.arange(len(many)), many))
                rows = [x for t in best.top for x in t]
                own = [names.column(c).combine_chunks().take(at) for c in ("query_id", "scope")]
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([*own, pa.array([x[1] for x in rows], chunk_kind), pa.array([x[0] for x in rows], pa.float64()), none, none], names=["query_id", "scope", "chunk_id", "score", "postings", "read"])
                one = [pa.nulls(1, x.type) for x in own]
                yield pa.RecordBatch.from_arrays([*one, pa.nulls(1, chunk_kind), pa.nulls(1, pa.float64()), pa.array([best.postings]), pa.array([best.read])], names=["query_id", "scope", "chunk_id", "score", "postings", "read"])

            hits = shards.mapInArrow(run, f"query_id {id_kind}, scope {scope_kind}, chunk_id {self.kind}, score double, postings bigint, read bigint")
            out = hits if out is None else out.unionByName(hits)
        # written within, so that a task gets a shard or two at a time whoever reads the hits
        with small_batches(self.spark):
            out = self.store.staged(out)
        return out.withColumnRenamed("scope", scope or "scope"), weighed


def _deltas(shards: DataFrame) -> DataFrame:
    """``term_id, df`` of whole shards, or with ``places`` what these take away; chunks are counted under ``ALL``."""
    removed = "places" in shards.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms, first_block, begin = (np.frombuffer(batch.column(a)[i].as_buffer(), ARRAYS[a]) for a in ("terms", "first_block", "block_begin"))
                first = begin[first_block]
                if not removed:
                    df, n = np.diff(first), batch.column("many")[i].as_py()
                else:
                    places = batch.column("places")[i].values
                    out = np.isin(np.frombuffer(batch.column("docs")[i].as_buffer(), ARRAYS["docs"]), places.to_numpy())
                    df, n = -np.diff(np.append(0, np.cumsum(out))[first]), -len(places)
                some = np.flatnonzero(df)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(terms[some].astype(np.int64), ALL)), pa.array(np.append(df[some], n))], names=["term_id", "df"])

    rows = shards.select("terms", "first_block", "block_begin", *(["docs", "places"] if removed else []), F.size("ids").cast("bigint").alias("many"))
    return rows.mapInArrow(run, "term_id bigint, df bigint").groupBy("term_id").agg(F.sum("df").alias("df"))
