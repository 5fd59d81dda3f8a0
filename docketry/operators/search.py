"""Sparse and dense index, hybrid retrieval, and what is done with the hits. All searches are batches of queries.

Hits are rows ``query_id, chunk_id, rank, score`` plus what they are joined to; ranks start at 1 and ties go to the
smaller chunk id, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as X

K1, B, AVERAGE = 1.2, 0.75, 350
CANDIDATES, TOP = 30, 8
RRF_K = 60
#: Query vectors sent to every task at once; more queries go in more rounds.
QUERY_BLOCK = 4096


def ranked(df: DataFrame, by: list, keys: list[str] = ["query_id"], name: str = "rank") -> DataFrame:  # noqa: B006
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))


#: Bytes of texts whose terms a task counts at once.
TEXT_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: str, size: int = TEXT_BYTES, rows: int = 1 << 12) -> Iterator[pa.RecordBatch]:
    """The batch in parts of no more than so many rows and bytes of a text column, or of one row."""
    first, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > first and (held + n > size or i - first >= rows):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if batch.num_rows > first:
        yield batch.slice(first)


def term_counter(k1: float = K1, b: float = B, average: float = AVERAGE) -> Callable[[pa.Array], tuple[list, list, list, list]]:
    """A function from folded texts to ``(place, term, term id, weight)`` of their terms, in which a term is hashed once."""
    stop, most = frozenset(X.STOPWORDS), 1 << 17
    names: dict[str, int] = {}

    def name(term: str) -> int:
        h = names.get(term)
        if h is None:
            if len(names) >= most:
                names.clear()
            h = 2166136261
            for c in term.encode():
                h = ((h ^ c) * 16777619) & 4294967295
            names[term] = h
        return h

    def counted(texts: pa.Array) -> tuple[list, list, list, list]:
        at, terms, ids, weights = [], [], [], []
        for i, text in enumerate(texts.to_pylist()):
            words = [w for w in (text or "").split(" ") if len(w) >= 2 and w not in stop]
            norm = k1 * (1 - b + b * len(words) / average)
            for term, tf in Counter(words).items():
                at.append(i)
                terms.append(term)
                ids.append(name(term))
                weights.append(tf * (k1 + 1) / (tf + norm))
        return at, terms, ids, weights

    return counted


def sparse_postings(chunks: DataFrame, k1: float = K1, b: float = B, average: float = AVERAGE) -> DataFrame:
    """``chunk_id, term, term_id, weight``: term weights within a text, counted within the row (nothing is shuffled).

    Texts are folded by Spark; their terms are counted in one pass over Arrow batches, ``TEXT_BYTES`` of texts at a time.
    """
    count = term_counter(k1, b, average)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "words")):
            at, terms, ids, weights = count(part.column("words"))
            yield pa.RecordBatch.from_arrays([part.column("chunk_id").take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(ids, pa.int64()), pa.array(weights, pa.float64())], names=["chunk_id", "term", "term_id", "weight"])

    rows = chunks.select(F.col("id").alias("chunk_id"), X.term_text("text").alias("words"))
    return rows.mapInArrow(run, f"chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, term string, term_id bigint, weight double")


def term_idf(postings: DataFrame, points: DataFrame) -> DataFrame:
    """``term_id, df, idf`` over all indexed points, those without terms included."""
    n = points.select(F.col("id").alias("chunk_id")).distinct().agg(F.count("*").alias("n"))
    seen = postings.groupBy("term_id").agg(F.countDistinct("chunk_id").alias("df"))
    return seen.crossJoin(F.broadcast(n)).select("term_id", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def sparse_scores(queries: DataFrame, postings: DataFrame, idf: DataFrame) -> DataFrame:
    """``query_id, chunk_id, score`` of all that share a term: the dot product of query weight, idf and text weight."""
    asked = sparse_postings(queries).select(F.col("chunk_id").alias("query_id"), "term_id", F.col("weight").alias("q")).join(idf, "term_id")
    met = asked.join(postings.select("term_id", "chunk_id", "weight"), "term_id")
    return met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("q") * F.col("idf") * F.col("weight")), 6).alias("score"))


def sparse_search(queries: DataFrame, postings: DataFrame, idf: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """Top k of ``sparse_scores`` for ``id, text`` queries."""
    return ranked(sparse_scores(queries, postings, idf), [F.desc("score"), F.col("chunk_id")]).where(F.col("rank") <= k)


def passes(doc_type: str | None = None, entity: str | None = None, doc_id=None, include_pii: bool = False) -> Callable[[Callable[[str], Column]], Column]:
    """What a search may find, as a condition over columns that a function names; texts marked as personal are left out unless asked for, unmarked ones pass."""

    def allowed(c: Callable[[str], Column]) -> Column:
        out = F.lit(True)
        if doc_type is not None:
            out &= c("doc_type") == doc_type
        if entity is not None:
            out &= F.array_contains(c("entities"), entity)
        if doc_id is not None:
            out &= c("doc_id") == doc_id
        return out if include_pii else out & ~F.coalesce(c("contains_pii"), F.lit(False))

    return allowed


def apply_filters(points: DataFrame, **filters) -> DataFrame:
    """The points that a search with these filters (``passes``) may find."""
    return points.where(passes(**filters)(F.col))


def rrf_fuse(legs: list[DataFrame], k: int = RRF_K, limit: int = CANDIDATES) -> DataFrame:
    """Sum of ``1 / (k + rank)`` over the legs."""
    rows = legs[0].select("query_id", "chunk_id", "rank")
    for leg in legs[1:]:
        rows = rows.unionByName(leg.select("query_id", "chunk_id", "rank"))
    fused = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"))
    return ranked(fused, [F.desc("score"), F.col("chunk_id")]).where(F.col("rank") <= limit)


def hybrid_search(queries: DataFrame, sparse, dense, top: int = TOP, candidates: int = CANDIDATES, k: int = RRF_K, **filters) -> DataFrame:
    """Both legs, fused; queries have ``id, text, embedding``, and ``sparse`` and ``dense`` are stored indexes with the filters' columns as
    payload. Filters choose the candidates; the statistics of terms are those of the whole index."""
    legs = [sparse.search(queries, candidates, passes(**filters)), dense.search(queries, candidates, passes(**filters))]
    return rrf_fuse(legs, k, candidates).where(F.col("rank") <= top)


def rerank(hits: DataFrame, scores: DataFrame, top: int = TOP) -> DataFrame:
    """Order by an outside score (``query_id, chunk_id, rerank_score``); a query with none keeps its order."""
    rows = hits.join(scores, ["query_id", "chunk_id"], "left")
    return ranked(rows.withColumnRenamed("rank", "before"), [F.desc_nulls_last("rerank_score"), F.col("before")]).where(F.col("rank") <= top)


def rerank_text(c) -> Column:
    return F.substring(c, 1, 2000)


def entity_search(first: DataFrame, general: DataFrame, least: int = 3, limit: int = 10) -> DataFrame:
    """Hits with the entity; where they are fewer than ``least``, general hits not among them follow."""
    first = first.where(F.col("rank") <= limit)
    few = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    more = general.join(few, "query_id", "left_anti").join(first, ["query_id", "chunk_id"], "left_anti")
    rows = first.select("query_id", "chunk_id", "score", F.lit(0).alias("stage"), F.col("rank").alias("before")).unionByName(more.select("query_id", "chunk_id", "score", F.lit(1).alias("stage"), F.col("rank").alias("before")))
    return ranked(rows, [F.col("stage"), F.col("before"), F.col("chunk_id")]).where(F.col("rank") <= limit).drop("before")


def depth_by_intent(hits: DataFrame) -> DataFrame:
    """Hits as deep as the query's ``intent`` asks for."""
    return hits.where(F.col("rank") <= F.when(F.col("intent") == "doc_find", 12).when(F.col("intent") == "entity", 10).otherwise(8))


def search_in_documents(index, queries: DataFrame, pairs: DataFrame, k: int = 6, scope: str = "doc_id") -> DataFrame:
    """Top k of each asked document (``query_id, doc_id``; or another column of the index's payload), then one list a query by score."""
    own = index.search(queries, k, scopes=pairs, scope=scope).withColumnRenamed("rank", "in_doc")
    return ranked(own, [F.desc("score"), F.col("chunk_id")])


def prioritize_cited(hits: DataFrame, refs: DataFrame) -> DataFrame:
    """Hits of the cited articles (``query_id, article_no``) first, else as ranked."""
    cited = refs.select("query_id", X.article_number(F.col("article_no")).alias("article")).distinct().withColumn("cited", F.lit(True))
    rows = hits.withColumn("article", X.article_number(F.col("article_no"))).join(cited, ["query_id", "article"], "left").withColumnRenamed("rank", "before")
    return ranked(rows, [F.coalesce("cited", F.lit(False)).desc(), F.col("before")])


def diversify(hits: DataFrame, per_key: int = 2, limit: int = 14) -> DataFrame:
    """At most ``per_key`` hits a service (an article, where there is none) first, the rest behind them."""
    key = F.when(F.col("service") != "", F.concat(F.lit("servis:"), "service")).otherwise(F.concat(F.lit("madde:"), F.coalesce("article_no", F.lit("?"))))
    rows = ranked(hits.withColumn("key", key), [F.col("rank")], ["query_id", "key"], "in_key").withColumnRenamed("rank", "before")
    return ranked(rows, [(F.col("in_key") > per_key).asc(), F.col("before")]).where(F.col("rank") <= limit).drop("key", "in_key")


def filter_org_type(hits: DataFrame, org: str) -> DataFrame:
    """Hits of services that an office of this kind has, and those of no service."""
    return hits.where((F.coalesce("service", F.lit("")) == "") | F.coalesce(X.is_for_org(F.coalesce("article_no", F.lit("")), org), F.lit(False)))


def routing_candidates(hits: DataFrame, org: str, raw: int = 28) -> DataFrame:
    """Of a fused list of 60: the first 28, those of this kind of office, diversified to 14."""
    kept = filter_org_type(hits.where(F.col("rank") <= raw), org).withColumnRenamed("rank", "before")
    return diversify(ranked(kept, [F.col("before")]).drop("before"))


def group_by_document(hits: DataFrame) -> DataFrame:
    """Hits by file: best score and the first hit's sample, best files first."""
    return hits.groupBy("query_id", "filename").agg(F.max("score").alias("score"), F.count("*").alias("n_hits"), F.min_by(X.snippet("text"), "rank").alias("sample"))


def build_context(hits: DataFrame) -> DataFrame:
    """Numbered texts with file and page, and the files in order of first sight."""
    rows = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "filename", "page", "text"))).alias("h"))
    page = lambda h: F.when(h["page"].isNotNull(), F.concat(F.lit(", s."), h["page"].cast("string"))).otherwise("")
    part = F.transform("h", lambda h, i: F.concat(F.lit("--- Parca "), (i + 1).cast("string"), F.lit(" ("), h["filename"], page(h), F.lit(") ---\n"), h["text"]))
    return rows.select("query_id", F.array_join(part, "\n\n").alias("context"), F.array_distinct(F.transform("h", lambda h: h["filename"])).alias("sources"))


def expand_to_parent(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each hit's parent in its place, the best-ranked hit of a parent standing for it."""
    own = chunks.select(F.col("id").alias("chunk_id"), "parent_id", F.col("text").alias("own_text"))
    parents = chunks.where("kind = 'parent'").select(F.col("id").alias("parent_id"), F.col("text").alias("parent_text"))
    rows = hits.join(own, "chunk_id").join(parents, "parent_id", "left").withColumn("unit_id", F.coalesce("parent_id", "chunk_id"))
    return ranked(rows, [F.col("rank")], ["query_id", "unit_id"], "in_unit").where("in_unit = 1").select("query_id", "unit_id", "chunk_id", "rank", F.coalesce("parent_text", "own_text").alias("text"))


def embedding_backlog(chunks: DataFrame, docs: DataFrame, corpus: str) -> DataFrame:
    """Child chunks of a corpus without a vector."""
    return chunks.where("kind = 'child' AND embedded_at IS NULL").join(docs.where(F.col("corpus") == corpus).select(F.col("id").alias("doc_id")), "doc_id", "left_semi")


def mark_embedded(chunks: DataFrame, ids: DataFrame, at) -> DataFrame:
    done = ids.select("id").distinct().withColumn("done", F.lit(True))
    return chunks.join(done, "id", "left").withColumn("embedded_at", F.when(F.col("done"), at).otherwise(F.col("embedded_at"))).drop("done")


def reset_embeddings(chunks: DataFrame, docs: DataFrame, corpus: str) -> DataFrame:
    own = docs.where(F.col("corpus") == corpus).select(F.col("id").alias("doc_id")).distinct().withColumn("own", F.lit(True))
    return chunks.join(own, "doc_id", "left").withColumn("embedded_at", F.when(F.col("own").isNull(), F.col("embedded_at"))).drop("own")


def embed(chunks: DataFrame, fn: Callable[[list[str]], list[list[float]]], batch: int = 16) -> DataFrame:
    """``id, embedding`` by a callable over lists of at most ``batch`` texts; a task holds ``TEXT_BYTES`` of texts, or one text, beside its Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for whole in batches for p in slices(whole, "text", rows=batch)):
            vectors = pa.array([list(map(float, v)) for v in fn(part.column("text").to_pylist())], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column("id"), vectors], names=["id", "embedding"])

    return chunks.select("id", "text").mapInArrow(run, f"id {chunks.schema['id'].dataType.simpleString()}, embedding array<float>")


def index_payload(chunks: DataFrame, docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Child chunks flattened with their document's columns: what a search index is given."""
    own = docs.select(F.col("id").alias("doc_id"), "filename", "path", "doc_type", "entities", "contains_pii")
    return chunks.where("kind = 'child'").join(own, "doc_id").join(vectors.select("id", "embedding"), "id").select(
        "id", "doc_id", "embedding", "text", "section", "page", "parent_id", "filename", "path", "doc_type",
        F.coalesce("entities", X.strings()).alias("entities"), "contains_pii",
        F.coalesce(F.col("metadata.article_no"), F.lit("")).alias("article_no"), F.coalesce(F.col("metadata.title"), F.lit("")).alias("article_title"),
    )
