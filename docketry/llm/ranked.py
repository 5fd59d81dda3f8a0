"""Ranked lexical search over an index with per-term geometric blocking; exact top k.

``indexed`` writes the index where the documents lie, in shards of about ``SHARD_BYTES`` of text; nothing is shuffled but
three sums. A shard holds, for its own documents,

- a posting list for each term. A list of more than ``BLOCK`` documents is clustered by document similarity: some of its documents
  are centres, each document goes to the centre whose terms are most like its own, and the list is cut into blocks in that order;
- for each such block its summary: the coordinatewise maximum of its documents' impacts, over the terms with long lists, rounded
  up to units of ``UNIT``. A shorter list is one block;
- the documents' own terms and impacts, and each term's largest impact.

``search`` sends queries to all shards, in blocks of a fixed number of terms. A shard is searched term by term, in the order of what a term can give at
most. Documents that hold a term visited earlier have been scored, or left out for good, so what
can still win holds none of them: a block's bound is the product of its summary and the query over the terms not yet visited. Blocks
whose bound is below the k-th score so far are skipped, the documents of the others are scored from their own terms; once all the
terms left cannot reach that score together, the shard is done. Bounds and scores are whole numbers, and equal scores are
never skipped, so the result is exact. Each task carries its best k from shard to shard, and hands on at most k rows a query.

An impact is ``(1000000000 * tf) div (1000 * tf + 8 * m)``, with ``m = 100 - 90 + ((90 * n * N) div L)``; a term's weight
``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``. N, L and df are those of all documents.

Terms are runs of 0-9, A-Z, a-z and non-ASCII characters, with A-Z in lower case, and are told apart by 64-bit hashes. Texts of
any length are read whole; null and empty texts have no terms and count nowhere. Rows with a null ``doc_id`` take no part, in the
statistics neither. Rows that repeat a ``doc_id`` are documents of their own; so are rows of ``items`` that repeat an ``item_id``, and
each gets its ranks. Items with a null id, or with no term that a document holds, have no rows. Empty tables give an empty result;
other columns are left behind, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm._shared import discarded, small_batches, stored, texts
from docketry.llm._words import ALNUM, Words, sliced

TOP = 10
#: Text and documents of one shard; a longer text is a shard of its own.
SHARD_BYTES, SHARD_DOCS = 3 << 19, 8192
#: Documents of a block of a posting list.
BLOCK = 32
#: Unit of the summaries: an impact is below a million, so a summary fits a byte.
UNIT = 4096
#: Terms of the queries that are sent to all tasks at once.
QUERY_TERMS = 1 << 16
SHARD = {
    "ids": np.int64, "n": np.int64,  # documents and their lengths
    "terms": np.uint64,  # all terms of the shard, sorted
    "own_first": np.int32, "own_term": np.int32, "own_tf": np.int32,  # by document: its terms (their places) and how often
}
LISTS = {
    "most": np.int32,  # by term: largest impact
    "first": np.int32, "docs": np.uint16, "impacts": np.int32,  # by term: its documents, in blocks; by document: impacts
    "long": np.int32, "block_first": np.int32, "summaries": np.uint8,  # terms with long lists, where their blocks begin, a row a block
}


class Index(NamedTuple):
    """``shards`` (one row each) and what all documents count together."""

    shards: DataFrame
    documents: int
    words: int


def schema(kinds: dict) -> str:
    return ", ".join(f"{k} binary" for k in kinds)


def packed(arrays: dict, kinds: dict) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(arrays[k], kind).tobytes()], pa.binary()) for k, kind in kinds.items()]


def unpacked(batch: pa.RecordBatch, i: int, kinds: dict) -> dict:
    return {k: np.frombuffer(batch.column(k)[i].as_buffer(), kind) for k, kind in kinds.items()}


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places of the ranges ``first : last``, one after the other."""
    size = last - first
    return np.repeat(first - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())


def forward(docs: DataFrame) -> DataFrame:
    """Shards without lists: documents with at least one term, and their terms."""

    def shard(ids: list, lengths: list, hashes: list) -> pa.RecordBatch:
        n, words = np.concatenate(lengths), np.concatenate(hashes)
        terms, place = np.unique(words, return_inverse=True)
        own, tf = np.unique(np.repeat(np.arange(len(n)), n) * len(terms) + place, return_counts=True)
        arrays = {"ids": np.concatenate(ids), "n": n, "terms": terms, "own_first": np.searchsorted(own // len(terms), np.arange(len(n) + 1)), "own_term": own % len(terms), "own_tf": tf}
        return pa.RecordBatch.from_arrays([pa.array([len(n)]), pa.array([int(n.sum())]), *packed(arrays, SHARD)], names=["documents", "words", *SHARD])

    def run(batches):
        cache: dict = {}
        held: list = []
        size = many = 0
        for part in sliced(batches):
            w = Words(part.column("text"), ALNUM, cache)
            n = np.diff(w.first)
            some = n > 0
            if not some.any():
                continue
            if held and (size + len(w.bytes) > SHARD_BYTES or many + some.sum() > SHARD_DOCS):
                yield shard(*zip(*held))
                held, size, many = [], 0, 0
            size, many = size + len(w.bytes), many + int(some.sum())
            held.append((part.column("doc_id").to_numpy()[some], n[some], w.hashes))
        if held:
            yield shard(*zip(*held))

    return texts(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, f"documents bigint, words bigint, {schema(SHARD)}")


def length_terms(n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """``m`` of documents with n terms."""
    if 90 * int(n.max(initial=0)) * documents < 1 << 63:
        return 10 + 90 * n * documents // words
    return 10 + np.array([90 * x * documents // words for x in n.tolist()], np.int64)


def blocked(shard: dict, documents: int, words: int) -> dict:
    """The posting lists of a shard, cut into blocks of like documents, and the blocks' summaries."""
    n, own_first, own_term = shard["n"], shard["own_first"], shard["own_term"]
    of = np.repeat(np.arange(len(n), dtype=np.int32), np.diff(own_first))
    tf = shard["own_tf"].astype(np.int64)
    impacts = (10**9 * tf // (1000 * tf + 8 * length_terms(n, documents, words)[of])).astype(np.int32)
    by = np.argsort(own_term, kind="stable")
    size = np.bincount(own_term, minlength=len(shard["terms"]))
    first = np.append(0, np.cumsum(size))
    docs = of[by]
    most = np.maximum.reduceat(impacts[by], first[:-1])
    long = np.flatnonzero(size > BLOCK)
    # the documents over the terms with long lists, and the same to unit length, to tell which are alike
    column = np.full(len(size), -1)
    column[long] = np.arange(len(long))
    here = column[own_term] >= 0
    matrix = np.zeros((len(n), len(long)), np.uint8)
    matrix[of[here], column[own_term[here]]] = -(-impacts[here] // UNIT)
    alike = matrix.astype(np.float32)
    alike /= np.maximum(np.linalg.norm(alike, axis=1, keepdims=True), 1e-9)
    begins, summaries = [0], []
    for t in long.tolist():
        own = docs[first[t] : first[t + 1]]
        centres = own[:: 2 * BLOCK]
        near = (alike[own] @ alike[centres].T).argmax(axis=1)
        own = own[np.argsort(near, kind="stable")]
        docs[first[t] : first[t + 1]] = own
        cuts = np.arange(0, len(own), BLOCK)
        summaries.append(np.maximum.reduceat(matrix[own], cuts, axis=0))
        begins.append(begins[-1] + len(cuts))
    return {"most": most, "first": first, "docs": docs, "impacts": impacts, "long": long, "block_first": begins, "summaries": np.concatenate(summaries) if summaries else np.zeros(0, np.uint8)}


def indexed(docs: DataFrame) -> Index:
    """The stored index of ``doc_id, text``; it can be searched any number of times."""
    spark = docs.sparkSession
    plain = stored(forward(docs), "shards")
    total = plain.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    documents, words = int(total.documents), int(total.words)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard = unpacked(batch, i, SHARD)
                kept = [batch.column(k).slice(i, 1) for k in SHARD if k not in ("n", "own_tf")]
                yield pa.RecordBatch.from_arrays([*kept, *packed(blocked(shard, documents, words), LISTS)], names=[*(k for k in SHARD if k not in ("n", "own_tf")), *LISTS])

    with small_batches(spark):
        shards = stored(plain.mapInArrow(run, schema({k: v for k, v in SHARD.items() if k not in ("n", "own_tf")} | LISTS)), "lists")
    discarded(plain)
    return Index(shards, documents, words)


def query_terms(items: DataFrame) -> DataFrame:
    """``row, item_id, terms``: the distinct terms of every item."""
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), F.col("item_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        cache: dict = {}
        for part in sliced(batches):
            w = Words(part.column("text"), ALNUM, cache)
            found = [np.unique(w.hashes[a:b]).view(np.int64) for a, b in zip(w.first.tolist(), w.first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("item_id"), pa.array(found, pa.list_(pa.int64()))], names=["row", "item_id", "terms"])

    return rows.mapInArrow(run, f"row bigint, item_id {rows.schema['item_id'].dataType.simpleString()}, terms array<bigint>")


def document_frequencies(index: Index, wanted: np.ndarray) -> np.ndarray:
    """In how many documents each of the terms stands: partial sums from the shards' lists."""
    sent = index.shards.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        terms = sent.value
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                shard = unpacked(batch, i, {"terms": np.uint64, "first": np.int32})
                at = np.minimum(np.searchsorted(shard["terms"], terms), len(shard["terms"]) - 1)
                df += np.where(shard["terms"][at] == terms, np.diff(shard["first"])[at], 0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["at", "df"])

    sums = index.shards.select("terms", "first").mapInArrow(run, "at bigint, df bigint").groupBy("at").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(wanted), np.int64)
    out[sums.column("at").to_numpy()] = sums.column("df").to_numpy()
    return out


class Best:
    """The k best documents so far of each query of a block, and how many blocks were met and skipped."""

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int):
        self.queries, self.k = queries, k
        self.scores = [np.zeros(0, np.int64)] * len(queries)
        self.ids = [np.zeros(0, np.int64)] * len(queries)
        self.blocks = self.skipped = 0

    def add(self, shard: dict) -> None:
        terms, long, first = shard["terms"], shard["long"], shard["first"]
        begins = shard["block_first"].astype(np.int64)
        summaries = shard["summaries"].reshape(-1, max(1, len(long)))
        weight_of = np.zeros(len(terms), np.int64)
        for q, (asked, weights) in enumerate(self.queries):
            at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
            known = (terms[at] == asked) & (weights > 0)
            at, weights = at[known], weights[known]
            if not len(at):
                continue
            gives = weights * shard["most"][at]
            # what the terms from here on can give together
            order = np.argsort(-gives, kind="stable")
            at, weights = at[order], weights[order]
            left = np.cumsum(gives[order][::-1])[::-1]
            column = np.searchsorted(long, at)
            column[column == len(long)] = 0
            is_long = (long[column] == at) if len(long) else np.zeros(len(at), bool)
            weight_of[at] = weights
            seen = np.zeros(len(shard["ids"]), bool)
            for i in range(len(at)):
                floor = self.scores[q][-1] if len(self.scores[q]) == self.k else 1
                if left[i] < floor:
                    break
                docs = shard["docs"][first[at[i]] : first[at[i] + 1]]
                scored = 0
                if is_long[i]:
                    blocks = slice(begins[column[i]], begins[column[i] + 1])
                    # terms with short lists count in full; of those with long ones, what the summary says
                    rest = is_long[i:]
                    short = int((weights[i:] * shard["most"][at[i:]])[~rest].sum())
                    bounds = summaries[blocks, column[i:][rest]].astype(np.int64) @ weights[i:][rest] * UNIT + short
                    order = np.argsort(-bounds, kind="stable")
                    done = 0
                    while done < len(order):
                        # the best blocks first, twice as many each time; the floor rises on the way
                        floor = self.scores[q][-1] if len(self.scores[q]) == self.k else 1
                        turn = order[done : 2 * done + 1]
                        turn = turn[bounds[turn] >= floor]
                        if not len(turn):
                            break
                        mine = docs[ranges(turn * BLOCK, np.minimum((turn + 1) * BLOCK, len(docs)))]
                        self._score(q, shard, mine[~seen[mine]], weight_of)
                        scored += len(turn)
                        done = 2 * done + 1
                    self.blocks, self.skipped = self.blocks + len(bounds), self.skipped + len(bounds) - scored
                else:
                    self._score(q, shard, docs[~seen[docs]], weight_of)
                seen[docs] = True
            weight_of[at] = 0

    def _score(self, q: int, shard: dict, docs: np.ndarray, weight_of: np.ndarray) -> None:
        if not len(docs):
            return
        begin, end = shard["own_first"][docs], shard["own_first"][docs + 1]
        places = ranges(begin, end)
        given = weight_of[shard["own_term"][places]] * shard["impacts"][places]
        scores = np.add.reduceat(given, np.append(0, np.cumsum(end - begin)[:-1]))
        keep = scores >= (self.scores[q][-1] if len(self.scores[q]) == self.k else 1)
        scores, docs = scores[keep], docs[keep]
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], shard["ids"][docs]])
        by = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.ids[q] = scores[by], ids[by]

    def found(self) -> pa.RecordBatch:
        many = [len(x) for x in self.scores]
        columns = [np.repeat(np.arange(len(many)), many), np.concatenate([*self.ids, np.zeros(0, np.int64)]), np.concatenate([*self.scores, np.zeros(0, np.int64)])]
        columns = [np.append(columns[0], -1), np.append(columns[1], self.blocks), np.append(columns[2], self.skipped)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["query", "doc_id", "score"])


def search(index: Index, items: DataFrame, k: int = TOP, block_terms: int = QUERY_TERMS, pruning: bool = False) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item. With ``pruning``: ``blocks, skipped`` of all long lists met."""
    asked = stored(query_terms(items).where("size(terms) > 0"), "items")
    item_id = asked.schema["item_id"].dataType.simpleString()
    spark = asked.sparkSession
    rounds = -(-int(asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]) // block_terms) if index.documents else 0
    out = []
    for n in range(rounds):
        block = asked.where(F.pmod(F.xxhash64("row", F.lit(37)), F.lit(rounds)) == n).orderBy("row").toArrow()
        if not block.num_rows:
            continue
        own = [np.asarray(t, np.int64).view(np.uint64) for t in block.column("terms").to_pylist()]
        wanted = np.unique(np.concatenate(own))
        df = document_frequencies(index, wanted)
        weights = np.floor(1000 * np.log((2 * index.documents + 2) / (2 * df + 1))).astype(np.int64)
        queries = [(t, weights[np.searchsorted(wanted, t)]) for t in own]
        sent = spark.sparkContext.broadcast(queries)

        def run(batches, sent=sent):
            best = Best(sent.value, k)
            for batch in batches:
                for i in range(batch.num_rows):
                    best.add(unpacked(batch, i, {key: kind for key, kind in (SHARD | LISTS).items() if key not in ("n", "own_tf")}))
            yield best.found()

        hits = index.shards.mapInArrow(run, "query bigint, doc_id bigint, score bigint")
        names = spark.createDataFrame([(i, item, row) for i, (item, row) in enumerate(zip(block.column("item_id").to_pylist(), block.column("row").to_pylist()))], f"query bigint, item_id {item_id}, row bigint")
        out.append(hits.where("query < 0").select(F.col("doc_id").alias("blocks"), F.col("score").alias("skipped")) if pruning else hits.where("query >= 0").join(F.broadcast(names), "query"))
    if not out:
        none = "blocks bigint, skipped bigint" if pruning else f"item_id {item_id}, rank int, doc_id bigint, score bigint"
        return spark.createDataFrame([], none)
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    if pruning:
        return every.agg(F.sum("blocks").alias("blocks"), F.sum("skipped").alias("skipped"))
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "doc_id"))
    return every.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
