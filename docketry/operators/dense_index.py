"""A stored dense index: vectors by coarse centres, with exact bounds from centre and radius, searched for an exact top k by cosine.

Centres are fitted once, by a few rounds of k-means over a bounded sample; they decide only where a vector lies, never whether it is
found. Vectors are dealt to the nearest centre and packed into shards of one centre each; a shard keeps the direction of its mean and
the largest angle between that and one of its vectors. No vector of a shard is nearer to a query than the angle to the mean less
that radius, which bounds the cosine.

A search sends blocks of queries to all tasks, twice. The first round scores each query against the shards of its own centre alone, which gives a
first k-th score; the second passes by every shard whose bound is below it. A task keeps one list of k a query over all its shards, and no
more than that leaves it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.search import CANDIDATES, QUERY_BLOCK, ranked
from docketry.sources.versions import Store, append, replace

#: Vectors from which the centres are fitted, rounds of fitting, and centres at most.
SAMPLE, ROUNDS, CENTRES = 8192, 6, 256
#: Vectors of a shard.
SHARD_VECTORS = 1024
PLACES, SLACK = 6, 2e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays, and has the cosine 0 with everything."""
    vectors = vectors.astype(np.float64)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def fitted(vectors: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """``n`` directions by spherical k-means, from evenly spaced vectors on."""
    centres = vectors[np.linspace(0, len(vectors) - 1, n).astype(np.int64)]
    for _ in range(rounds):
        near = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, vectors)
        moved = np.linalg.norm(sums, axis=1) > 1e-9
        centres[moved] = unit(sums[moved])
    return centres


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class _Best:
    """The k best vectors so far of each query, and how many shards were met and passed by."""

    def __init__(self, queries: np.ndarray, k: int, least: np.ndarray):
        self.queries, self.k, self.least = queries, k, least
        self.top: list[list[tuple]] = [[] for _ in queries]
        self.met = self.passed = 0

    def add(self, shard: dict, ids: pa.Array, may: np.ndarray | None, live: np.ndarray) -> None:
        cosine = np.clip(self.queries[live] @ shard["centre"], -1, 1)
        bound = np.cos(np.maximum(0, np.arccos(cosine) - shard["radius"])) + SLACK
        open_ = bound >= self.least[live]
        self.met, self.passed = self.met + len(live), self.passed + int((~open_).sum())
        live = live[open_]
        if not len(live):
            return
        scores = np.round(self.queries[live] @ shard["vectors"].T, PLACES)
        if may is not None:
            scores[:, ~may] = -np.inf
        # vectors stand in the order of their ids, so of equal scores the first are the ones to keep
        best = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        for q, order, own in zip(live.tolist(), best, scores):
            new = [(float(own[i]), ids[int(i)].as_py()) for i in order if own[i] >= self.least[q] and own[i] > -np.inf]
            if new:
                self.top[q] = sorted(self.top[q] + new, key=lambda x: (-x[0], x[1]))[: self.k]
                if len(self.top[q]) == self.k:
                    self.least[q] = max(self.least[q], self.top[q][-1][0])


class DenseIndex:
    """The index at ``path``; it is made where there is none, from vectors with the id type ``kind`` and the columns ``payload`` (a struct's DDL)."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "string", payload: str | None = None):
        shards = f"centre_no int, ids array<{kind}>, payload array<{payload or 'struct<any:boolean>'}>, vectors binary, centre binary, radius double"
        self.spark, self.store = spark, Store(spark, path, {"shards": (shards, "centre_no", 1), "centres": ("no int, centre array<double>", "no", 1)})
        own = self.store.schema("shards")
        self.kind, self.payload = own["ids"].dataType.elementType.simpleString(), own["payload"].dataType.elementType

    def centres(self) -> np.ndarray:
        rows = self.store.table("centres").orderBy("no").toArrow()
        return _matrix(rows.column("centre").combine_chunks()) if rows.num_rows else np.zeros((0, 0))

    def _fit(self, vectors: DataFrame) -> np.ndarray:
        """Centres from the vectors with the lowest hashes: all of them, or about ``SAMPLE``."""
        n = vectors.count()
        rows = vectors if n <= SAMPLE else vectors.where(F.shiftrightunsigned(F.xxhash64("id", F.lit(43)), 1) < int(SAMPLE / n * (1 << 63))).limit(2 * SAMPLE)
        found = rows.orderBy("id").select("embedding").toArrow().column("embedding").combine_chunks()
        if not len(found):
            return np.zeros((0, 0))
        return fitted(unit(_matrix(found)), max(1, min(CENTRES, round(len(found) ** 0.5))))

    def add(self, vectors: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Index ``id, embedding`` and the payload's columns; vectors that are null are left out. Ids are new to the index."""
        payload = [c for c in self.payload.names if c != "any"]
        rows = vectors.where("embedding IS NOT NULL").select(F.col("id").cast(self.kind).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), (F.struct(*payload) if payload else F.struct(F.lit(True).alias("any"))).alias("payload"))
        rows = self.store.staged(rows)
        centres = self.centres()
        new = not len(centres)
        if new:
            centres = self._fit(rows)
        if not len(centres):
            return
        sent = self.spark.sparkContext.broadcast(centres)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    near = (unit(_matrix(b.column("embedding"))) @ sent.value.T).argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=[*b.schema.names, "centre_no"])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list = []

            def shard() -> pa.RecordBatch:
                v = unit(np.concatenate([_matrix(h.column("embedding")) for h in held]))
                centre = unit(v.sum(axis=0)[None])[0]
                radius = float(np.arccos(np.clip(v @ centre, -1, 1)).max())
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.concat_arrays([h.column(c) for h in held])) for c in ("id", "payload")]
                no = held[0].column("centre_no").slice(0, 1)
                held.clear()
                return pa.RecordBatch.from_arrays([no, *lists, pa.array([v.tobytes()], pa.binary()), pa.array([centre.tobytes()], pa.binary()), pa.array([radius])], names=["centre_no", "ids", "payload", "vectors", "centre", "radius"])

            for b in batches:
                no = b.column("centre_no").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(no)) + 1), len(no)]
                for first, last in zip(cuts, cuts[1:]):
                    for a in range(first, last, SHARD_VECTORS):
                        part = b.slice(a, min(SHARD_VECTORS, last - a))
                        if held and (held[0].column("centre_no")[0] != part.column("centre_no")[0] or sum(h.num_rows for h in held) + part.num_rows > SHARD_VECTORS):
                            yield shard()
                        held.append(part)
            if held:
                yield shard()

        assigned = rows.mapInArrow(nearest, f"id {self.kind}, embedding array<double>, payload {rows.schema['payload'].dataType.simpleString()}, centre_no int")
        parts = max(1, -(-rows.count() // (8 * SHARD_VECTORS)))
        shards = self.store.staged(assigned.repartitionByRange(parts, "centre_no", "id").sortWithinPartitions("centre_no", "id").mapInArrow(packed, self.store.schema("shards")))
        own = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "no int, centre array<double>")
        self.store.commit(lambda store: [append("shards", shards), *([replace("centres", "no", own.select("no"), own)] if new else [])], batch)

    def search(self, queries: DataFrame, k: int = CANDIDATES, allowed: Callable[[Callable[[str], Column]], Column] | None = None, block: int = QUERY_BLOCK) -> DataFrame:
        """``query_id, chunk_id, score, rank``: the k best vectors of ``id, embedding`` queries; ``allowed`` as for the sparse index."""
        out = [found for found, _ in self._searched(queries, k, allowed, block)]
        if not out:
            kind = queries.schema["id"].dataType.simpleString()
            return self.spark.createDataFrame([], f"query_id {kind}, chunk_id {self.kind}, score double, rank int")
        every = out[0]
        for more in out[1:]:
            every = every.unionByName(more)
        hits = every.where("query_id IS NOT NULL").select("query_id", "chunk_id", "score")
        return ranked(hits, [F.desc("score"), F.col("chunk_id")]).where(F.col("rank") <= k)

    def skipped(self, queries: DataFrame, k: int = CANDIDATES) -> float:
        """The share of pairs of query and shard that a search passes by."""
        n = [found.where("query_id IS NULL").agg(F.sum("met").alias("met"), F.sum("passed").alias("passed")).first() for found, _ in self._searched(queries, k, None, QUERY_BLOCK)]
        return sum(r.passed for r in n) / sum(r.met for r in n)

    def _searched(self, queries: DataFrame, k: int, allowed, block: int) -> Iterator[tuple[DataFrame, np.ndarray]]:
        if not self.store.filled("shards"):
            return
        centres = self.centres()
        may = F.transform("payload", lambda p: F.coalesce(allowed(lambda c: p[c]), F.lit(False))) if allowed is not None else F.lit(None).cast("array<boolean>")
        shards = self.store.table("shards").withColumn("may", may).drop("payload")
        rows = queries.where("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("embedding"))
        rounds = max(1, -(-rows.count() // block))
        kind = queries.schema["id"].dataType.simpleString()
        for n in range(rounds):
            asked = rows.where(F.pmod(F.xxhash64("id", F.lit(19)), F.lit(rounds)) == n).orderBy("id").toArrow()
            if not asked.num_rows:
                continue
            names, matrix = asked.column("id").combine_chunks(), unit(_matrix(asked.column("embedding").combine_chunks()))
            home = (matrix @ centres.T).argmax(axis=1)
            first = self._scored(shards.where(F.col("centre_no").isin(*sorted(set(home.tolist())))), names, matrix, home, np.full(len(matrix), -np.inf), k, kind)
            kth = ranked(first.where("query_id IS NOT NULL"), [F.desc("score"), F.col("chunk_id")]).where(F.col("rank") == k).select("place", "score").toArrow()
            least = np.full(len(matrix), -np.inf)
            least[kth.column("place").to_numpy()] = kth.column("score").to_numpy()
            yield self._scored(shards, names, matrix, None, least, k, kind), least

    def _scored(self, shards: DataFrame, names: pa.Array, matrix: np.ndarray, home: np.ndarray | None, least: np.ndarray, k: int, kind: str) -> DataFrame:
        sent = self.spark.sparkContext.broadcast((names, matrix, home, least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix, home, least = sent.value
            best, id_kind = _Best(matrix, k, least.copy()), None
            every = np.arange(len(matrix))
            for b in batches:
                id_kind = b.column("ids").type.value_type
                for i in range(b.num_rows):
                    own = {c: np.frombuffer(b.column(c)[i].as_buffer(), np.float64) for c in ("vectors", "centre")}
                    own |= {"vectors": own["vectors"].reshape(-1, len(own["centre"])), "radius": b.column("radius")[i].as_py()}
                    flags = b.column("may")[i].values
                    live = every if home is None else every[home == b.column("centre_no")[i].as_py()]
                    best.add(own, b.column("ids")[i].values, None if flags is None else flags.to_numpy(zero_copy_only=False), live)
            if id_kind is None:
                return
            at = np.repeat(every, [len(t) for t in best.top])
            rows = [x for t in best.top for x in t]
            none = pa.nulls(len(rows), pa.int64())
            columns = ["place", "query_id", "chunk_id", "score", "met", "passed"]
            yield pa.RecordBatch.from_arrays([pa.array(at), names.take(pa.array(at)), pa.array([x[1] for x in rows], id_kind), pa.array([x[0] for x in rows], pa.float64()), none, none], names=columns)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, names.type), pa.nulls(1, id_kind), pa.nulls(1, pa.float64()), pa.array([best.met]), pa.array([best.passed])], names=columns)

        return shards.mapInArrow(run, f"place bigint, query_id {kind}, chunk_id {self.kind}, score double, met bigint, passed bigint")
