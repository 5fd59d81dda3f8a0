"""Exact top-k search by inner product, with block-at-a-time pruning.

Vectors are rounded down to integers, ordered so that vectors with the same leading components lie together,
and cut into chunks of document ranges; a chunk is a row that holds ids and a matrix, and is written once. Within a chunk,
blocks keep the largest and smallest value of every component. For each query their products with the query,
summed up, bound every score in the block from above; the blocks are taken in the order of these bounds and scored
through their rows until the bound falls below the query's kth score.

The queries are a stated set that meets all rows in blocks of bounded size: a block of queries is sent to the tasks, and
each task reads its chunks one after the other and carries the kth scores from chunk to chunk. A first round scores only
the ``FIRST`` best blocks of every chunk. The kth best of what it finds is a score that the final kth cannot fall
below, so the second round starts from it everywhere. What leaves a task is at most k rows a query; no vector is shuffled
after it was written.

Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own. Rows that
repeat an id are queries and candidates each on their own. Ties go to the smaller id. Rows with a null id, a
null vector, or a null, NaN or infinite component take no part. Only vectors of the same length meet. With fewer than k
candidates all are returned; an empty table gives an empty result. Components and scores beyond ``LARGEST`` in size
count as that. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm._shared import stored

CHUNK = 2048
BLOCK = 64
#: Blocks of a chunk that the first round scores for each query.
FIRST = 1
#: Bytes of the query vectors that are sent to the tasks at once.
QUERY_BYTES = 4 << 20
LARGEST = (1 << 63) - 2
NONE = -(1 << 63) + 1


def integers(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``row, vec_id, v`` (longs) of the rows that take part; ``row`` tells rows apart and is fixed once this is written."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bound = lambda c: F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), c))
    rounded = F.transform(x, lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(bound(c.cast("double") * scale)))))
    kept = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(fine)
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), rounded.alias("v"))


PACKED = "dims int, ids binary, rows binary, matrix binary"


def packed(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows of about ``size`` vectors of one length: ``dims, ids, rows, matrix`` (int64, vector by vector)."""
    parts = max(1, -(-rows.count() // size))
    strength = F.transform("v", F.abs)
    lead = F.array_position(strength, F.array_max(strength))
    order = ["dims", "lead", "rest", "row"]
    ordered = rows.withColumns({"dims": F.size("v"), "lead": lead, "rest": F.try_element_at("v", lead.cast("int"))})
    ordered = ordered.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("row", "vec_id", "v", "dims")

    def run(batches):
        held: list = []

        def flush():
            ids, names, v = (np.concatenate(x) for x in zip(*[h[1:] for h in held]))
            out = [pa.array([held[0][0]], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (ids, names, v)]]
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=["dims", "ids", "rows", "matrix"])

        for batch in batches:
            dims = batch.column("dims").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1), len(dims)]
            for a, b in zip(cuts, cuts[1:]):
                for c in range(a, b, size):
                    if held and (held[0][0] != dims[c] or sum(len(h[1]) for h in held) >= size):
                        yield flush()
                    part = batch.slice(c, min(size, b - c))
                    held.append((int(dims[c]), part.column("vec_id").to_numpy(), part.column("row").to_numpy(), part.column("v").flatten().to_numpy()))
        if held:
            yield flush()

    return ordered.mapInArrow(run, PACKED)


def unpacked(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, rows = (np.frombuffer(chunk[c], np.int64) for c in ("ids", "rows"))
    return ids, rows, np.frombuffer(chunk["matrix"], np.int64).reshape(len(ids), chunk["dims"])


def product(*pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Exact integer sum of ``a @ b.T``, cut off at ``LARGEST``; in floating point where every sum is below 2**53."""
    largest = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    most = sum(largest(a) * largest(b) * max(1, a.shape[1]) for a, b in pairs)
    if most < 1 << 53:
        return sum(a.astype(np.float64) @ b.astype(np.float64).T for a, b in pairs).astype(np.int64)
    if most < LARGEST:
        return sum(a @ b.T for a, b in pairs)
    exact = sum(np.dot(a.astype(object), b.astype(object).T) for a, b in pairs)
    return np.clip(exact, -LARGEST, LARGEST).astype(np.int64)


class Best:
    """The k best candidates so far of each of a block of queries."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray | None = None):
        n = len(queries)
        self.queries, self.own, self.k = queries, own, k
        self.high, self.low = np.maximum(queries, 0), np.minimum(queries, 0)
        self.least = np.full(n, NONE) if least is None else least
        self.top, self.who, self.row = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)
        self.seen = self.scored = 0

    def add(self, ids: np.ndarray, rows: np.ndarray, matrix: np.ndarray, block: int = BLOCK, most: int | None = None) -> None:
        """Score the vectors of a chunk, or only those of each query's ``most`` best blocks."""
        parts = [slice(a, min(a + block, len(ids))) for a in range(0, len(ids), block)]
        high, low = np.stack([matrix[p].max(axis=0) for p in parts]), np.stack([matrix[p].min(axis=0) for p in parts])
        bound = product((self.high, high), (self.low, low))
        order = np.argsort(-bound, axis=1, kind="stable")
        live = np.arange(len(self.queries))
        self.seen += len(live) * len(ids)
        for turn in range(len(parts) if most is None else min(most, len(parts))):
            at = order[live, turn]
            # bounds only fall from here on; equal ones can still win a tie
            open_ = bound[live, at] >= np.maximum(self.least[live], self.top[live, -1])
            live, at = live[open_], at[open_]
            if not len(live):
                break
            by = np.argsort(at, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
                self._merge(live[group], ids, rows, matrix, parts[at[group[0]]])

    def _merge(self, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, matrix: np.ndarray, part: slice) -> None:
        score = product((self.queries[queries], matrix[part]))
        self.scored += score.size
        score[self.own[queries, None] == rows[None, part]] = NONE
        useful = score.max(axis=1) >= np.maximum(np.maximum(self.least[queries], self.top[queries, -1]), NONE + 1)
        queries, score = queries[useful], score[useful]
        if not len(queries):
            return
        shape = score.shape
        beside = lambda x: np.broadcast_to(x[None, part], shape)
        score = np.concatenate([self.top[queries], score], axis=1)
        who, row = np.concatenate([self.who[queries], beside(ids)], axis=1), np.concatenate([self.row[queries], beside(rows)], axis=1)
        by = np.lexsort((row, who, -score))[:, : self.k]
        self.top[queries], self.who[queries], self.row[queries] = (np.take_along_axis(x, by, 1) for x in (score, who, row))

    def found(self, names: np.ndarray) -> pa.RecordBatch:
        real = self.top > NONE
        many = real.sum(axis=1)
        columns = (np.repeat(self.own, many), np.repeat(names, many), self.who[real], self.row[real], self.top[real])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_row", "query_id", "vec_id", "row", "score"])


def search(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, chunk: int = CHUNK, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """``query_id, rank`` (from 1) ``, vec_id, score, query_row`` (which tells queries of one id apart)."""
    rows = stored(integers(vectors, scale), "vectors")
    chunks = stored(packed(rows, chunk), "chunks")
    asked = rows.where(F.col("vec_id") % every == 0)
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))

    def scored(dims: int, names: np.ndarray, own: np.ndarray, queries: np.ndarray, least: np.ndarray | None, most: int | None) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast((names, own, queries, least))

        def run(batches):
            names, own, queries, least = sent.value
            best = Best(queries, own, k, least)
            for batch in batches:
                for one in batch.to_pylist():
                    best.add(*unpacked(one), most=most)
            yield best.found(names)

        hits = chunks.where(F.col("dims") == dims).mapInArrow(run, "query_row bigint, query_id bigint, vec_id bigint, row bigint, score bigint")
        return hits.withColumn("rank", place).where(F.col("rank") <= k)

    out = []
    for dims, n in sorted(tuple(r) for r in asked.groupBy(F.size("v")).count().collect()):
        blocks = -(-n * 8 * max(1, dims) // block_bytes)
        for b in range(blocks):
            own = asked.where(F.size("v") == dims).where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "vec_id", "v").orderBy("row").toArrow()
            if not len(own):
                continue
            at, names = own.column("row").to_numpy(), own.column("vec_id").to_numpy()
            queries = own.column("v").combine_chunks().flatten().to_numpy().reshape(len(own), dims)
            kth = scored(dims, names, at, queries, None, FIRST).where(F.col("rank") == k).select("query_row", "score").toArrow()
            least = np.full(len(at), NONE)
            least[np.searchsorted(at, kth.column("query_row").to_numpy())] = kth.column("score").to_numpy()
            out.append(scored(dims, names, at, queries, least, None))
    if not out:
        out.append(rows.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), "vec_id", "row", F.col("row").alias("score"), F.lit(1).alias("rank")).limit(0))
    every_block = out[0]
    for more in out[1:]:
        every_block = every_block.unionByName(more)
    return every_block.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "query_row")
