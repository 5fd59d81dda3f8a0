"""The library's jobs put together to whole workloads."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import text as X
from docketry.operators import chunking, routing, search
from docketry.operators.sparse_index import SparseIndex


class Index(NamedTuple):
    chunks: DataFrame
    sparse: SparseIndex


def index_corpus(docs: DataFrame, path: str, regulations: bool = False) -> Index:
    """Documents ``id, filename, text`` to chunks, and the child chunks into a stored index at ``path``."""
    index = SparseIndex(docs.sparkSession, path)
    chunks = index.store.staged(chunking.chunk_regulations(docs) if regulations else chunking.chunk_documents(docs))
    index.add(chunks.where("kind = 'child'"))
    return Index(chunks, index)


def search_files(queries: DataFrame, docs: DataFrame, index: Index, candidates: int = search.CANDIDATES) -> DataFrame:
    """Files that answer ``id, text`` queries: the best child chunks, grouped by file."""
    hits = index.sparse.search(queries, candidates)
    text = index.chunks.select(F.col("id").alias("chunk_id"), "doc_id", "text")
    files = docs.select(F.col("id").alias("doc_id"), "filename")
    return search.group_by_document(hits.join(text, "chunk_id").join(files, "doc_id"))


def routing_queries(analyses: DataFrame) -> DataFrame:
    """One query a routing key (``doc_type, request, receivable``): documents of one kind share their retrieval."""
    key = X.routing_key(F.col("doc_type"), F.col("request"), F.col("receivable"))
    return analyses.groupBy(key.alias("id")).agg(F.min(X.routing_query(F.col("request"), F.col("receivable"))).alias("text"))


def checked_decisions(decisions: DataFrame, hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """Model decisions after all checks: citations, owners and units, catalogue."""
    cited = routing.verify_citations(decisions, hits).drop("invented")
    return routing.enforce_catalog(routing.reconcile_units(cited, hits), catalog)
