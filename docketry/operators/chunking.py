"""Documents to parent and child chunks, their pages, and the bookkeeping around them.

A Markdown document is one row and is cut in one narrow pass; nothing is shuffled. Regulations are cut by windows over their lines. Chunk
ids are digests of document id, kind and ordinal, so a rerun writes the same chunks.
"""

from __future__ import annotations

from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.text import tr_lower
from docketry.operators import _markdown, _pages, regulation
from docketry.operators.search import slices

METADATA = "struct<part:string,chapter:string,unit:string,sub_unit:string,service:string,service_no:string,article_no:string,title:string,certain:boolean>"
CHUNKS = f"id string, doc_id string, kind string, ordinal int, text string, section string, parent_id string, token_count int, probe string, metadata {METADATA}"
BLOCKS = "doc_id string, pos int, type string, text string, level int, path array<string>"


def _rows(fields: list[str], rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=fields)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("id").cast("string").alias("id"), "filename", F.coalesce("text", F.lit("")).alias("text"))


def parse_blocks(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, type, text, level, path`` of ``id, filename, text`` documents."""

    def run(batches):
        for part in (p for batch in batches for p in slices(batch, "text")):
            texts = zip(part.column("id").to_pylist(), part.column("text"))
            rows = ({"doc_id": doc_id, "pos": i, "type": b.kind, "text": b.text, "level": b.level, "path": list(b.path)} for doc_id, text in texts for i, b in enumerate(_markdown.pieces(_markdown.cleaned(text.as_py()))))
            while some := list(islice(rows, 2000)):
                yield pa.RecordBatch.from_pylist(some, schema)

    schema = pa.schema([("doc_id", pa.string()), ("pos", pa.int32()), ("type", pa.string()), ("text", pa.string()), ("level", pa.int32()), ("path", pa.list_(pa.string()))])
    return _input(docs).mapInArrow(run, BLOCKS)


def assign_sections(blocks: DataFrame) -> DataFrame:
    """Adds ``section_no`` to blocks without headings: a change of the first two headings begins a section."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = blocks.where("type <> 'heading'").withColumn("section_path", F.slice("path", 1, 2))
    change = F.coalesce(F.col("section_path") != F.lag("section_path").over(order), F.lit(True))
    return rows.withColumn("section_no", F.sum(change.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)


def parent_chunks(sections: DataFrame, filenames: DataFrame, longest: int = _markdown.LONGEST_PARENT) -> DataFrame:
    """One chunk a section, from sectioned blocks and ``doc_id, filename``."""
    grouped = sections.groupBy("doc_id", "section_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda b: b["text"]), "\n\n").alias("whole"), F.min_by("section_path", "pos").alias("path"))
    label = F.when(F.size("path") > 0, F.array_join("path", " > "))
    body = F.when(F.ceil(F.length("whole") / 3.5) > longest, F.substring("whole", 1, longest * 4)).otherwise(F.col("whole"))
    return grouped.join(filenames, "doc_id").select("doc_id", "section_no", label.alias("section"), F.concat(F.lit("[Dosya: "), "filename", F.coalesce(F.concat(F.lit(" > "), label), F.lit("")), F.lit("]\n"), body).alias("text"), F.ceil(F.length(body) / 3.5).cast("int").alias("token_count"))


def split_long_text(column: str | Column, target: int = _markdown.TARGET, overlap: float = _markdown.OVERLAP) -> Column:
    """Sentence-wise pieces of long texts, as an array."""
    sizes = _markdown.Sizes(target=target, overlap=overlap)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else _markdown.split_long(t, sizes))

    return pieces(column)


def split_texts(docs: DataFrame, target: int = _markdown.TARGET, overlap: float = _markdown.OVERLAP) -> DataFrame:
    """``id, pos, piece``: the pieces of ``split_long_text``, a row each, of ``slices`` of texts at a time."""
    sizes = _markdown.Sizes(target=target, overlap=overlap)

    def run(batches):
        for part in (p for batch in batches for p in slices(batch, "text")):
            found = [[] if t is None else _markdown.split_long(t, sizes) for t in part.column("text").to_pylist()]
            at = pa.array([i for i, own in enumerate(found) for _ in own], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id").take(at), pa.array([n for own in found for n in range(len(own))], pa.int32()), pa.array([p for own in found for p in own], pa.string())], names=["id", "pos", "piece"])

    rows = docs.select("id", "text")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, pos int, piece string")


#: Bytes of a text up to which it is cut where it lies, as one row.
LARGE = 4 << 20


def chunk_documents(docs: DataFrame, target: int = _markdown.TARGET, largest: int = _markdown.LARGEST, parent: int = _markdown.LONGEST_PARENT, overlap: float = _markdown.OVERLAP, large: int = LARGE) -> DataFrame:
    """Parent and child chunks of ``id, filename, text`` documents.

    A text of more than ``large`` bytes is cut into lines first, which go through one task in order: that task holds a block at a time,
    not the text. Chunks are the same either way (of equal rows with such a text one counts).
    """
    sizes = _markdown.Sizes(target, largest, parent, overlap)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    small = _chunked(docs.where(size <= large), lambda r: _markdown.chunks(r.id, r.filename, r.text, sizes))
    return small.unionByName(_chunked_by_line(docs.where(size > large), sizes))


def _chunked_by_line(docs: DataFrame, sizes: _markdown.Sizes) -> DataFrame:
    fields = _fields()
    clean = F.regexp_replace(F.regexp_replace("text", r"<!--\s*image\s*-->", ""), "\n{3,}", "\n\n")
    rows = docs.select(F.col("id").cast("string").alias("id"), "filename", F.xxhash64("filename", "text").alias("row"), clean.alias("text")).dropDuplicates(["id", "row"])
    lines = rows.select("id", "filename", "row", F.posexplode(F.split("text", "\n")).alias("line", "text"))

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("id", "row", "filename", "text")))

        held: list = []
        for (doc_id, _, filename), own in groupby(rows(), key=lambda r: r[:3]):
            for chunk in _markdown.chunks(doc_id, filename, (r[3] for r in own), sizes):
                held.append(chunk)
                if len(held) >= 500:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    meta = pa.struct([(f.split(":")[0], pa.bool_() if f.endswith("boolean") else pa.string()) for f in METADATA[7:-1].split(",")])
    kinds = {"ordinal": pa.int32(), "token_count": pa.int32(), "metadata": meta}
    schema = pa.schema([(f, kinds.get(f, pa.string())) for f in fields])
    return lines.repartition("id").sortWithinPartitions("id", "row", "line").select("id", "row", "filename", "text").mapInArrow(run, CHUNKS)


def chunk_regulations(docs: DataFrame) -> DataFrame:
    """Article and service chunks of ``id, filename, text`` regulations."""
    return regulation.chunks(docs, infer_article_numbers(parse_articles(docs)))


def _fields() -> list[str]:
    return [f.split()[0] for f in CHUNKS.split(", metadata")[0].split(", ")] + ["metadata"]


def _chunked(docs: DataFrame, cut) -> DataFrame:
    fields = _fields()

    def run(frames):
        for pdf in frames:
            held: list = []
            for r in pdf.itertuples():
                for chunk in cut(r):
                    held.append(chunk)
                    if len(held) > 500:
                        yield _rows(fields, held)
                        held = []
            yield _rows(fields, held)

    return _input(docs).mapInPandas(run, CHUNKS)


def parse_articles(docs: DataFrame) -> DataFrame:
    """Articles as they stand, before numbers are inferred: ``doc_id, pos, title, part, chapter, number, body``."""
    return regulation.articles(docs)


def infer_article_numbers(articles: DataFrame) -> DataFrame:
    """``doc_id, pos, title, part, chapter, article_no, certain, body``: open numbers filled where the neighbours
    leave one, other unnumbered articles joined to the one before (dropped where there is none)."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    low = F.last("number", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    high = F.first("number", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    rows = articles.withColumn("article_no", F.coalesce("number", F.when(high - low == 2, low + 1)))
    rows = rows.withColumn("head", F.last(F.when(F.col("article_no").isNotNull(), F.col("pos")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    text = F.when(F.col("pos") == F.col("head"), F.col("body")).otherwise(F.concat(F.array(F.lit(""), "title"), "body"))
    heads = rows.where("head IS NOT NULL").groupBy("doc_id", "head").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", text.alias("body")))), lambda x: x["body"])).alias("body"),
        *[F.min_by(c, "pos").alias(c) for c in ("title", "part", "chapter")],
        F.min_by("article_no", "pos").cast("string").alias("article_no"),
        F.min_by(F.col("number").isNotNull(), "pos").alias("certain"),
    )
    return heads.withColumnRenamed("head", "pos")


def split_segments(articles: DataFrame) -> DataFrame:
    """Segments of ``doc_id, pos, body`` articles."""
    return regulation.segments(articles)


def normal_text(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


#: Bytes of probes and entries that are compared at a time.
BLOCK_BYTES = 4 << 20


def first_entries(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """``id, first_at, first, second_at, second``: of chunks ``id, doc_id, probe`` and entries ``doc_id, pos, norm_text, entry_page`` the page and position of the
    first entry that contains the probe or lies within it, and of the first that holds the probe's first 40 characters.

    The rows of a document go through one task in order, a block at a time (a chunk has a row for each block with such an entry): that task
    holds a block and the document's probes, not its entries.
    """
    kind = lambda rows, c: rows.schema[c].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    # a row with a half is a probe. Rows without a document are left out by the tasks: a filter here would go down to the tables, and what a plan
    # reads for its probes, its entries and its chunks would not be read and shuffled once
    probes = asked.select("doc_id", "id", none("bigint").alias("pos"), none(kind(entries, "entry_page")).alias("page"), F.octet_length(F.substring("probe", 1, 40)).alias("half"), F.col("probe").alias("text"))
    lines = entries.select("doc_id", none(kind(asked, "id")).alias("id"), F.col("pos").cast("bigint").alias("pos"), F.col("entry_page").alias("page"), none("int").alias("half"), F.col("norm_text").alias("text"))

    def compared(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        text = pa.concat_arrays(rows.column("text").chunks)
        is_probe = np.asarray(rows.column("half").is_valid())
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
        raw = text.buffers()[2].to_pybytes()[ends[0] : ends[-1]] if text.buffers()[2] else b""
        doc = rows.column("doc_id").combine_chunks().dictionary_encode()
        doc = (doc.combine_chunks() if isinstance(doc, pa.ChunkedArray) else doc).indices.to_numpy(zero_copy_only=False)
        found = _pages.first_entries(doc, is_probe, rows.column("half").fill_null(0).to_numpy(), raw, ends - ends[0])
        hit = np.flatnonzero((found[0] < _pages.NONE) | (found[1] < _pages.NONE))
        at = [pa.array(np.where(f[hit] < _pages.NONE, f[hit], -1), pa.int64(), mask=f[hit] == _pages.NONE) for f in found]
        take = lambda c, i: pa.concat_arrays(c.take(i).chunks) if len(i) else pa.nulls(0, c.type)
        return pa.RecordBatch.from_arrays([take(rows.column("id"), pa.array(hit)), *(take(rows.column(c), i) for i in at for c in ("pos", "page"))], names=["id", "first_at", "first", "second_at", "second"])

    def run(batches):
        held, size = [], 0
        for batch in (p for b in batches for p in slices(b.filter(b.column("doc_id").is_valid()), "text")):
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= BLOCK_BYTES:
                rows = pa.Table.from_batches(held)
                yield compared(rows)
                # the document that may go on: its probes, which stand before its entries
                rows = rows.filter(pc.and_(pc.equal(rows.column("doc_id"), rows.column("doc_id")[-1]), rows.column("half").is_valid()))
                held, size = rows.to_batches(), 0
        if held:
            yield compared(pa.Table.from_batches(held))

    page = kind(entries, "entry_page")
    return probes.unionByName(lines).repartition("doc_id").sortWithinPartitions("doc_id", F.col("half").isNull(), "pos").mapInArrow(run, f"id {kind(asked, 'id')}, first_at bigint, first {page}, second_at bigint, second {page}")


def assign_pages(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds ``page``: of the document's entries ``doc_id, pos, norm_text, page`` the first, by position, that holds the
    chunk's first 80 characters or lies within them; else the first that holds its first 40."""
    probe = F.substring(normal_text(F.regexp_replace(F.coalesce("probe", "text"), r"^\[.*?\]\n", "")), 1, 80)
    # exploded, so that it is worked out once, not anew in each expression that it goes into
    asked = chunks.select("id", "doc_id", F.explode(F.array(probe)).alias("probe")).where(F.length("probe") >= 15)
    rows = entries.select("doc_id", "pos", F.explode(F.array("norm_text")).alias("norm_text"), F.col("page").alias("entry_page")).where("norm_text IS NOT NULL")
    found = first_entries(asked, rows).groupBy("id").agg(F.min_by("first", "first_at").alias("first"), F.min_by("second", "second_at").alias("second"))
    return chunks.join(found.select("id", F.coalesce("first", "second").alias("page")), "id", "left")


def pending_chunking(docs: DataFrame, chunks: DataFrame, force: bool = False) -> DataFrame:
    parsed = docs.where("status = 'parsed'")
    return parsed if force else parsed.join(chunks.select(F.col("doc_id").alias("id")), "id", "left_anti")


def regulation_candidates(docs: DataFrame, match: str | None = None) -> DataFrame:
    """Documents whose name or path looks like a regulation's, or contains ``match``."""
    name = tr_lower(F.concat_ws(" ", "filename", "path"))
    return docs.where(F.contains(name, tr_lower(F.lit(match))) if match else name.rlike("yonetmel|yönetmel|regulation|mevzuat"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    child = F.col("kind") == "child"
    return chunks.agg(
        F.countDistinct("doc_id").alias("docs"),
        F.count_if(child).alias("children"),
        F.count_if(F.col("kind") == "parent").alias("parents"),
        F.coalesce(F.round(F.avg(F.when(child, F.col("token_count")))), F.lit(0)).cast("long").alias("avg_child_tokens"),
    )
