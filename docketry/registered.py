"""Registered queries: the library's jobs bound to the given tables.

The workflow registry is made of ``orders`` and ``customer``, letters and relational chunks of ``lineitem``, chat of
``conversations``, events of ``events``, texts of ``documents``; the service catalogue of ``nation``. Every job reads
whole tables.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import letters as L
from docketry.functions import text as X
from docketry.operators import chunking, correspondence, names, registry, routing, search, stored_registry
from docketry.operators.dense_index import DenseIndex
from docketry.operators.sparse_index import SparseIndex
from docketry.plans import workloads
from docketry.sources import files
from docketry.sources.scratch import shared_folder
from docketry.sources.versions import Store
from docketry.streaming import streams

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# adapters


def documents(spark, d, join=None):
    """The documents with what their labels say; ``join`` is a hint for how the labels come to them."""
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("contains_pii"), F.col("quality").cast("double").alias("confidence"))
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.join(labels.hint(join) if join else labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), name.alias("filename"), name.alias("path"), "text", F.col("lang").alias("doc_type"), "source",
        F.when(F.col("source").isin("src0", "src1"), "regulations").otherwise("documents").alias("corpus"), "contains_pii", "confidence", F.col("doc_id").alias("n"),
    )


def structured(spark, d):
    """The same documents as Markdown with two headings and a table."""
    md = F.concat(F.lit("# "), "source", F.lit("\n\n## "), "doc_type", F.lit("\n\n"), "text", F.lit("\n\n| id | n |\n|---|---|\n| "), "id", F.lit(" | 1 |\n"))
    return documents(spark, d).withColumn("text", md)


def regulations(spark, d):
    """Documents as regulations: articles 1 and 3 with a number, one between them without, two services in the last."""
    third = F.concat(F.lit("A) Ana Hizmet Birimleri\n\nI- Vergilendirme Bölümü\n\n1) Sicil Servisi\n\n"), "text", F.lit("\n\n2) Tecil Servisi\n\n- takip\n"))
    md = F.concat(F.lit("## BİRİNCİ KISIM Genel\n\n## Amaç - Madde 1\n\n"), "text", F.lit("\n\n## Kapsam ve Dayanak Esasları :\n\nara metin\n\n## Görev Dağılımı : Madde 3\n\n"), third)
    return documents(spark, d).where("corpus = 'regulations'").withColumn("text", md)


def workflow(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey", "left")
    k = F.col("o_orderkey")
    routed = ~(k % 11).isin(0, 1)
    status = F.when(k % 10 == 0, "failed").when(k % 10 == 1, "pending").otherwise("parsed")
    done = F.col("o_orderstatus") == "F"
    lifecycle = F.when(done, "completed").when(F.col("o_orderstatus") == "P", "in_progress").when(k % 3 == 0, "new").when(k % 3 == 1, "routed").otherwise("in_progress")
    return o.select(
        k.cast("string").alias("id"), F.concat(F.lit("/in/evrak-"), k.cast("string"), F.lit(".pdf")).alias("path"), F.concat(F.lit("evrak-"), k.cast("string"), F.lit(".pdf")).alias("filename"), F.lit("pdf").alias("format"), (k * 10).alias("size_bytes"),
        F.sha2(k.cast("string"), 256).alias("hash"), status.alias("status"), F.when(k % 10 == 0, "bozuk dosya").alias("error"), F.when((k % 10) > 1, F.concat(k.cast("string"), F.lit(".md"))).alias("parsed_path"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"),
        F.when(k % 50 == 0, "regulations").otherwise("documents").alias("corpus"), F.when(k % 23 == 0, F.concat(F.lit("s"), (k % 7).cast("string"))).alias("session_id"), lifecycle.alias("lifecycle_status"),
        F.when(k % 11 == 0, "pending").when(k % 11 == 1, "belirlenemedi").otherwise("routed").alias("routing_status"), F.when(routed, F.col("o_orderpriority")).alias("routed_service"), F.when(routed, F.col("c_mktsegment")).alias("routed_unit"),
        F.when(routed, (k % 100) / 100).alias("routing_confidence"), F.when(routed, "auto").alias("routing_reasoning"), F.when(k % 13 != 0, F.concat("o_orderstatus", F.lit("|"), (F.col("o_custkey") % 400).cast("string"))).alias("routing_key"),
        F.when(done, F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")).alias("completed_at"), F.when(done & (k % 4 == 0), "onay").alias("completed_decision"), F.when(k % 3 == 0, F.col("o_orderdate")).alias("classified_at"), F.when(k % 5 == 0, F.col("o_orderdate")).alias("gaps_scanned_at"), k.alias("n"), "o_custkey",
    )


def letters(spark, d):
    return table(spark, d, "lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_orderkey").cast("string").alias("document_id"), F.col("l_returnflag").alias("decision"), F.col("l_shipdate").alias("created_at"), (F.col("l_linestatus") == "F").alias("saved"))


def line_chunks(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), n.cast("string")).alias("id"), F.col("l_orderkey").cast("string").alias("doc_id"), F.when(n == 1, "parent").otherwise("child").alias("kind"), n.alias("ordinal"),
        F.concat(F.lit("["), "l_returnflag", F.lit("]\nparca "), F.col("l_partkey").cast("string")).alias("text"), F.when(n % 2 == 0, F.col("l_linestatus")).alias("section"), F.when(n > 1, F.concat(F.col("l_orderkey").cast("string"), F.lit("-1"))).alias("parent_id"),
        F.col("l_quantity").cast("int").alias("token_count"), F.when(n % 3 != 0, F.col("l_shipdate")).alias("embedded_at"),
    )


def messages(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def services(spark, d):
    """The service catalogue of the nations: article, unit, sub-unit and number of each."""
    r = F.col("n_regionkey")
    return table(spark, d, "nation").select(
        F.concat("n_name", F.lit(" Servisi")).alias("service"), (r + 10).cast("string").alias("article_no"), F.when(r % 2 == 0, "A) Ana Hizmet Birimleri").otherwise("B) Diğer Hizmet Birimleri").alias("unit"),
        F.when(r % 4 == 0, "I- Vergilendirme Bölümü").when(r % 4 == 1, "II- Muhasebe Bölümü").when(r % 4 == 2, "III- Kovuşturma Bölümü").otherwise("IV- Tarama ve Kontrol").alias("sub_unit"), (F.col("n_nationkey") % 5 + 1).cast("string").alias("service_no"), (F.col("n_nationkey") % 7 != 0).alias("certain"), F.col("n_nationkey").cast("bigint").alias("nk"),
    )


def decision_hits(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("decision_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"), "o_custkey")
    return o.select("decision_id", (F.col("i") + 1).alias("rank"), ((F.col("o_custkey") + F.col("i") * 3) % 25).alias("nk")).join(services(spark, d), "nk").drop("nk")


def decisions(spark, d):
    k = F.col("o_orderkey")
    s = services(spark, d)
    o = table(spark, d, "orders").withColumn("nk", (F.col("o_custkey") + F.when(k % 4 == 2, 1).otherwise(3)) % 25).join(s, "nk")
    name = F.when(k % 4 == 1, F.lower("service")).when(k % 4 == 3, F.lit(None)).otherwise(F.col("service"))
    path = F.concat("article_no", F.lit("-"), F.substring("unit", 1, 1), F.lit("-"), F.element_at(F.split("sub_unit", "-"), 1), F.lit("-"), "service_no")
    cited = F.when(k % 6 == 0, F.array(F.struct(F.lit("99").alias("article_no"), F.lit("Yok").alias("title")))).otherwise(F.array(F.struct(path.alias("article_no"), F.col("sub_unit").alias("title")), F.struct(F.lit("99").alias("article_no"), F.lit("Yok").alias("title"))))
    return o.select(
        k.cast("string").alias("decision_id"), F.when(k % 5 == 0, "Muhasebe").alias("main_unit"), F.when(k % 5 == 1, "Takdir").alias("other_unit"), name.alias("service"), F.lit(None).cast("string").alias("sub_service"), cited.alias("citations"),
        ((k % 100) / 100).alias("confidence"), (k % 17 == 0).alias("undetermined"), F.when(k % 3 == 0, "gerekce").otherwise("").alias("reasoning"), F.when(k % 2 == 0, F.concat(F.lit("k"), (k % 100).cast("string"))).alias("routing_key"),
    )


def identifiers(spark, d):
    k = F.col("o_orderkey")
    tax, person = F.lpad((k * 104729 + F.col("o_custkey") * 7).cast("string"), 10, "0"), F.lpad((k * 1299709 + F.col("o_custkey") * 31 + 10000000000).cast("string"), 11, "0")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("n"), tax.alias("tax"), person.alias("person"), F.concat(F.lit("Vergi no "), tax, F.lit(", kimlik "), person, F.lit(" ve 2026-01-15.")).alias("text"))


INSTITUTION = {"kurum_adi": "Vergi Dairesi", "detsis_no": "12345678", "dosya_plani": "045.01", "telefon": "0312"}


def joined(c):
    return F.array_join(c, "|")


# sources


def folder_of_files(spark, d):
    """The documents as text files of their own, beside files of a kind that no scan takes; written once a session.

    The tasks write them, into folders of one for each 64th of the ids: Spark's own writer makes a folder a file, and moves it twice.
    """

    def make(path):
        rows = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("doc"), "text")

        def write(batches):
            store, root = fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))
            made = set()
            for batch in batches:
                for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
                    folder = f"{root}/texts/{doc % 64}"
                    if folder not in made:
                        store.create_dir(folder)
                        made.add(folder)
                    with store.open_output_stream(f"{folder}/doc={doc}.txt") as out:
                        out.write(text.as_py().encode() + b"\n")
                yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

        rows.repartition("doc").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
        rows.select("doc").write.parquet(f"{path}/other")

    return once(spark, d, "files", make)


def document_of(path):
    return F.regexp_extract(path, r"/doc=([0-9]+)\.", 1).cast("bigint").alias("doc_id")


@query
def s1_scan_files(spark, d):
    return files.scan_files(spark, folder_of_files(spark, d), content=False).select(document_of("path"), files.extension("path").alias("format"), F.col("length").alias("size_bytes"))


@query
def s3_read_text_documents(spark, d):
    return files.read_text_documents(spark, folder_of_files(spark, d)).select(document_of("path"), F.element_at(F.split("filename", r"\."), -1).alias("kind"), F.md5("text").alias("text_md5"))


@query
def s11_read_golden(spark, d):
    def make(path):
        n = F.col("item_id")
        some = lambda when, c: F.when(when, F.array(c)).otherwise(X.strings())
        q = F.struct(
            F.concat(F.lit("g"), n.cast("string")).alias("id"), F.when(n % 5 == 0, "trap").otherwise("fact").alias("scenario"), F.col("text").alias("question"),
            some(n % 2 == 0, F.concat(n.cast("string"), F.lit(".txt"))).alias("expectedDocs"), some(n % 3 == 0, F.col("text")).alias("expectedAnswerContains"), F.when(n % 7 == 0, F.array(F.lit("yasak"))).alias("expectedAnswerNotContains"),
        )
        # a set is a file with a list of a hundred questions or so
        sets = table(spark, d, "benchmark").groupBy(F.floor(n / 100).alias("set")).agg(F.to_json(F.struct(F.collect_list(q).alias("questions"))).alias("value"))
        sets.write.partitionBy("set").text(path)

    out = files.read_golden(spark, once(spark, d, "golden", make))
    return out.select("id", "scenario", F.md5("question").alias("question"), *[joined(c).alias(c) for c in ("expected_docs", "expected", "forbidden")])


@query
def s2_file_identity(spark, d):
    raw = table(spark, d, "pages").select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"), F.octet_length("html").cast("bigint").alias("length"))
    return files.with_file_identity(raw)


def incoming(spark, d):
    k = F.col("n")
    return workflow(spark, d).where(k % 3 == 0).select("id", F.when(k % 2 == 0, F.col("path")).otherwise(F.concat("path", F.lit(".new"))).alias("path"), "filename", "format", (F.col("size_bytes") + 1).alias("size_bytes"), F.when(k % 4 == 0, F.col("hash")).otherwise(F.sha2(F.concat("id", F.lit("x")), 256)).alias("hash"))


@query
def s4_detect_changes(spark, d):
    return registry.detect_changes(incoming(spark, d), workflow(spark, d)).select("id", "path", "change")


def now():
    return F.lit("2030-01-01 00:00:00").cast("timestamp")


@query
def s5_upsert_documents(spark, d):
    base = workflow(spark, d).select("id", "path", "filename", "format", "size_bytes", "hash", "status", "error", "created_at", "updated_at")
    return registry.upsert_documents(base, incoming(spark, d), now())


@query
def s6_apply_status(spark, d):
    w = workflow(spark, d)
    patches = w.where(F.col("n") % 4 == 0).select("id", F.lit("parsed").alias("status"), F.lit(None).cast("string").alias("error"), F.when(F.col("n") % 8 == 0, F.concat("id", F.lit(".v2.md"))).alias("parsed_path"))
    return registry.apply_status(w, patches).select("id", "status", "error", "parsed_path")


@query
def s7_replace_chunks(spark, d):
    old = line_chunks(spark, d).select("id", "doc_id", "kind", "ordinal")
    fresh = old.where(F.col("doc_id").cast("bigint") % 5 == 0).where("ordinal = 1").withColumn("id", F.concat("id", F.lit("n")))
    docs = workflow(spark, d).where(F.col("n") % 5 == 0).select("id")
    return registry.replace_chunks(old, fresh, docs)


def embedded_docs(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", F.col("label").alias("vec_label"))


DOCUMENTS = "id string, path string, status string, error string, parsed_path string, corpus string, session_id string"
LINES = "id string, doc_id string, kind string, ordinal int"


@query
def s6_stored_registry(spark, d):
    """The changes of S6, S7, S12, A18 and A20 on stored tables, one after the other; what is left of each document."""

    def make(path):
        w, n = workflow(spark, d), F.col("n")
        chunks = line_chunks(spark, d).select("id", "doc_id", "kind", "ordinal")
        points = chunks.where("kind = 'child'").select(F.when(F.col("ordinal") == 7, F.concat("id", F.lit("-old"))).otherwise(F.col("id")).alias("id"), "doc_id")
        store = stored_registry.registry_store(spark, path, DOCUMENTS, LINES, buckets=16)
        stored_registry.load(store, documents=w, chunks=chunks, points=points)
        stored_registry.set_status(store, w.where(n % 4 == 0).select("id", F.lit("parsed").alias("status"), F.lit(None).cast("string").alias("error"), F.when(n % 8 == 0, F.concat("id", F.lit(".v2.md"))).alias("parsed_path")))
        stored_registry.tag(store, w.where(n % 9 == 0).select("id", F.when(n % 2 == 0, "regulations").alias("corpus"), F.when(n % 27 == 0, "s99").alias("session_id")))
        stored_registry.replace_chunks(store, w.where(n % 5 == 0).select("id"), chunks.where(F.col("doc_id").cast("bigint") % 5 == 0).where("ordinal <= 2"))
        stored_registry.repair_drift(store)
        stored_registry.purge(store, "regulations")

    store = Store(spark, once(spark, d, "registry", make))
    count = lambda name: store.table(name).groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias(f"n_{name}"))
    docs = store.table("documents").join(count("chunks"), "id", "left").join(count("points"), "id", "left")
    return docs.select("id", "status", "error", "parsed_path", "corpus", "session_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_chunks", "n_points")])


@query
def s8_index_payload(spark, d):
    docs = documents(spark, d).withColumn("entities", F.when(F.col("n") % 2 == 0, F.array("source")))
    chunks = docs.select("id", F.col("id").alias("doc_id"), F.lit("child").alias("kind"), "text", F.lit(None).cast("string").alias("section"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast(chunking.METADATA).alias("metadata"))
    out = search.index_payload(chunks, docs, embedded_docs(spark, d))
    return out.select("id", "doc_id", F.md5("text").alias("text_md5"), "filename", "doc_type", joined("entities").alias("entities"), "contains_pii", "article_no", "article_title", F.size("embedding").cast("bigint").alias("dims"))


@query
def s9_page_entries(spark, d):
    # the parser's JSON of a document: its lines as texts, two to a page, the fourth without a page
    line = lambda x, i: F.struct(x.alias("text"), F.when(i == 3, F.lit(None)).otherwise(F.array(F.struct((F.floor(i / 2) + 1).cast("int").alias("page_no")))).alias("prov"))
    docs = documents(spark, d).select("id", F.to_json(F.struct(F.transform(F.split("text", "\n"), line).alias("texts"))).alias("parser_json"))
    return files.page_entries(docs).select("doc_id", "pos", F.md5("norm_text").alias("text_md5"), "page")


@query
def s10_parse_model_output(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("attempt"), F.when(F.col("event_id") % 3 == 0, F.concat("props", F.lit("x{"))).when(F.col("event_id") % 5 == 0, F.lit("{")).otherwise(F.regexp_replace("props", r"\}", F.concat(F.lit(', "kind": "'), "event_type", F.lit('"}')))).alias("raw"))
    out = files.parse_model_output(e, "struct<k:bigint,kind:string>", ("k", "kind"), {"kind": ("view", "click", "purchase")}, {"k": (10, 60)})
    return out.select("id", "ok", "attempt", F.col("value.k").alias("k"), F.col("value.kind").alias("kind"))


@query
def s12_tag_documents(spark, d):
    w = workflow(spark, d)
    tags = w.where(F.col("n") % 9 == 0).select("id", F.when(F.col("n") % 2 == 0, "regulations").alias("corpus"), F.when(F.col("n") % 27 == 0, "s99").alias("session_id"))
    return registry.tag_documents(w, tags).select("id", "corpus", "session_id")


# chunking


@query
def c1_clean_markdown(spark, d):
    return documents(spark, d).select("id", F.md5(X.clean_markdown(F.concat(F.lit("<!-- image -->\n\n\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n\n\n"))))).alias("cleaned"))


@query
def c2_estimate_tokens(spark, d):
    return documents(spark, d).select("id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query
def c3_parse_blocks(spark, d):
    return chunking.parse_blocks(structured(spark, d)).select("doc_id", "pos", "type", F.md5("text").alias("text_md5"), "level", joined("path").alias("path"))


@query
def c4_assign_sections(spark, d):
    return chunking.assign_sections(chunking.parse_blocks(structured(spark, d))).select("doc_id", "pos", "section_no", joined("section_path").alias("path"), F.md5("text").alias("text_md5"))


@query
def c5_parent_chunks(spark, d):
    docs = structured(spark, d)
    sections = chunking.assign_sections(chunking.parse_blocks(docs))
    return chunking.parent_chunks(sections, docs.select(F.col("id").alias("doc_id"), "filename")).select("doc_id", "section_no", "section", F.md5("text").alias("text_md5"), "token_count")


@query
def c6_child_chunks(spark, d):
    chunks = chunking.chunk_documents(structured(spark, d)).where("kind = 'child'")
    return chunks.select("doc_id", "ordinal", F.md5("probe").alias("body_md5"), F.ceil(F.length("probe") / 3.5).cast("int").alias("body_tokens"))


@query
def c7_split_long_text(spark, d):
    return chunking.split_texts(documents(spark, d)).select("id", "pos", F.md5("piece").alias("piece_md5"))


def pages_of(spark, d):
    # labels by hash here and in c8, so that texts are dealt out once, alike whatever the size of either table
    docs = documents(spark, d, "shuffle_hash")
    line = lambda x, i: F.struct(x.alias("text"), F.array(F.struct((i + 1).cast("int").alias("page_no"))).alias("prov"))
    return files.page_entries(docs.select("id", F.to_json(F.struct(F.transform(F.split("text", "\n"), line).alias("texts"))).alias("parser_json")))


@query
def c8_assign_pages(spark, d):
    # a document's text in pieces of 400 characters, cut in one pass; after a whole last piece comes an empty one
    cut = F.concat(F.regexp_extract_all("text", F.lit("(?s).{1,400}"), F.lit(0)), F.when(F.length("text") % 400 == 0, F.array(F.lit(""))).otherwise(X.strings()))
    pieces = documents(spark, d, "shuffle_hash").select(F.col("id").alias("doc_id"), F.posexplode(cut).alias("n", "piece"))
    chunks = pieces.select(F.concat_ws("-", "doc_id", "n").alias("id"), "doc_id", F.concat(F.lit("[Dosya]\n"), "piece").alias("text"), F.lit(None).cast("string").alias("probe"))
    return chunking.assign_pages(chunks, pages_of(spark, d)).select("id", "page")


@query
def c9_chunk_documents(spark, d):
    chunks = chunking.chunk_documents(structured(spark, d))
    return chunks.select("id", "doc_id", "kind", "ordinal", F.md5("text").alias("text_md5"), "section", "parent_id", "token_count")


def body_md5(column="body"):
    return F.md5(F.array_join(column, "\n")).alias("body_md5")


@query
def c10_parse_articles(spark, d):
    return chunking.parse_articles(regulations(spark, d)).select("doc_id", "pos", "title", "part", "number", body_md5())


@query
def c11_infer_article_numbers(spark, d):
    return chunking.infer_article_numbers(chunking.parse_articles(regulations(spark, d))).select("doc_id", "article_no", "title", "certain", body_md5())


@query
def c12_split_segments(spark, d):
    numbered = chunking.infer_article_numbers(chunking.parse_articles(regulations(spark, d)))
    return chunking.split_segments(numbered).select("doc_id", "pos", "segment", "unit", "sub_unit", "service", "service_no", joined("markers").alias("markers"), body_md5("lines"))


@query
def c13_chunk_regulations(spark, d):
    chunks = chunking.chunk_regulations(regulations(spark, d))
    return chunks.select("id", "doc_id", "kind", "ordinal", F.md5("text").alias("text_md5"), "section", "parent_id", "token_count", "metadata.article_no", "metadata.unit", "metadata.service", "metadata.certain")


@query
def c14_pending_chunking(spark, d):
    have = line_chunks(spark, d).where(F.col("doc_id").cast("bigint") % 2 == 0)
    return chunking.pending_chunking(workflow(spark, d), have).select("id")


@query
def c15_regulation_candidates(spark, d):
    docs = documents(spark, d).withColumn("filename", F.concat(F.when(F.col("n") % 4 == 0, "VERGİ YÖNETMELİĞİ ").otherwise(""), "filename"))
    return chunking.regulation_candidates(docs).select("id", "filename")


@query
def c16_chunk_stats(spark, d):
    return chunking.chunk_stats(line_chunks(spark, d))


# text functions


def words(c, a, b):
    return F.array_join(F.slice(F.split(c, " "), a, b), " ")


@query
def t1_tr_lower(spark, d):
    return documents(spark, d).select("id", F.md5(X.tr_lower(F.concat("text", F.lit("Iİ")))).alias("value"))


@query
def t2_tr_fold(spark, d):
    return documents(spark, d).select("id", F.md5(X.tr_fold("text")).alias("value"))


@query
def t3_tr_normalize(spark, d):
    return documents(spark, d).select("id", F.md5(X.tr_normalize("text")).alias("value"))


@query
def t4_tokenize(spark, d):
    return documents(spark, d).select("id", F.md5(joined(X.tokenize("text"))).alias("value"), F.size(X.tokenize("text")).cast("bigint").alias("n"))


@query
def t5_only_digits(spark, d):
    return documents(spark, d).select("id", X.only_digits("text").alias("value"))


@query
def t6_is_valid_tckn(spark, d):
    return identifiers(spark, d).select("n", X.is_valid_tckn(F.col("person")).alias("value"))


@query
def t7_is_valid_vkn(spark, d):
    return identifiers(spark, d).select("n", X.is_valid_vkn(F.col("tax")).alias("value"))


@query
def t8_extract_identifiers(spark, d):
    found = X.extract_identifiers(F.col("text"))
    return identifiers(spark, d).select("n", joined(found["tckn"]).alias("tckn"), joined(found["vkn"]).alias("vkn"))


@query
def t9_validate(spark, d):
    return identifiers(spark, d).select("n", X.validate_tckn(F.col("person")).alias("tckn"), X.validate_vkn(F.when(F.col("n") % 2 == 0, F.col("person")).otherwise(F.col("tax"))).alias("vkn"))


@query
def t10_reconcile_identifiers(spark, d):
    r = X.reconcile_identifiers(F.when(F.col("n") % 3 == 0, F.col("tax")), F.lit(None).cast("string"), F.col("text"))
    people = X.clean_list(F.array(F.lit(" A "), F.lit("A"), F.lit(""), F.col("tax")), 10)
    return identifiers(spark, d).select("n", r["vkn"].alias("vkn"), r["tckn"].alias("tckn"), joined(people).alias("people"))


@query
def t11_ground_phrase(spark, d):
    n = F.col("n") % 4
    phrase = F.when(n == 0, words("text", 2, 3)).when(n == 1, F.concat(words("text", 2, 2), F.lit(" zzzz "), words("text", 5, 3))).when(n == 2, F.concat(F.lit("uydurma ("), words("text", 3, 1), F.lit(")"))).otherwise("olmayan deyim")
    return documents(spark, d).select("id", X.ground_phrase(phrase, F.col("text")).alias("value"))


@query
def t12_verify_findings(spark, d):
    n = F.col("n")
    docs = documents(spark, d)
    rank = lambda s: F.when(s == "kritik", 0).when(s == "orta", 1).otherwise(2)
    one = lambda pos, s, q: F.struct(F.lit(pos).alias("pos"), F.lit(s).alias("severity"), q.alias("quote"))
    found = docs.select("id", "text", F.explode(F.array(one(0, "dusuk", words("text", 2, 3)), one(1, "kritik", F.concat(words("text", 1, 2), F.lit(" … "), words("text", 4, 2))), one(2, "orta", F.when(n % 2 == 0, "").otherwise("yok boyle")))).alias("f"))
    good = found.where(X.quote_holds(F.col("f.quote"), F.col("text")))
    return good.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct(rank(F.col("f.severity")).alias("rank"), "f.pos"))), 1, 8).alias("kept")).select("id", F.array_join(F.transform("kept", lambda k: k["pos"].cast("string")), ",").alias("kept"))


@query
def t13_routing_key(spark, d):
    return documents(spark, d).select("id", X.routing_key(F.col("doc_type"), F.col("corpus"), F.col("text")).alias("value"))


REQUESTS = list(X.REQUEST_PHRASES)


def request_of(n):
    return F.element_at(F.array(*map(F.lit, REQUESTS)), (n % len(REQUESTS) + 1).cast("int"))


@query
def t14_routing_query(spark, d):
    rec = F.when(F.col("n") % 2 == 0, words("text", 1, 2)).otherwise("")
    return documents(spark, d).select("id", X.routing_query(request_of(F.col("n")), rec).alias("query"), X.routing_text(F.col("doc_type"), request_of(F.col("n")), rec, words("text", 1, 3)).alias("text"))


@query
def t15_parse_citation(spark, d):
    c = decisions(spark, d).select("decision_id", F.col("citations")[0]["article_no"].alias("a"))
    return c.select("decision_id", X.parse_citation(F.col("a")).alias("p")).select("decision_id", "p.article", "p.unit", "p.part", "p.service")


@query
def t16_same_service(spark, d):
    s = services(spark, d).select(F.col("service").alias("name"))
    other = s.select(F.concat(F.lower(F.substring("name", 1, 8)), F.lit(" servis")).alias("name"))
    asked = table(spark, d, "customer").select(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"), F.lit(" Servisi")).alias("name"))
    alike = names.like_pairs(s, other).select(F.col("name").alias("service"), "other", "strict")
    return alike.join(other.withColumnRenamed("name", "other"), "other").join(asked.withColumnRenamed("name", "service"), "service").groupBy("service", "other", "strict").agg(F.count("*").alias("n"))


@query
def t16_best_service(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey") % 25
    # as they may be written: other case, without the last word, with one more, or of no service
    written = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("nation_"), k.cast("string"), F.lit(" servısı"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Nation "), k.cast("string"))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("NATION_"), k.cast("string"), F.lit(" Servisi Şefliği"))).otherwise(F.concat(F.lit("Gelir "), k.cast("string")))
    asked = o.select(written.alias("name"))
    return asked.groupBy("name").agg(F.count("*").alias("n")).join(names.best_service(asked, services(spark, d)), "name")


@query
def t17_service_predicates(spark, d):
    w = workflow(spark, d).select("id", F.concat("routed_service", F.when(F.col("n") % 3 == 0, " Arşiv Servisi").when(F.col("n") % 3 == 1, " İhtilaflı  İşler").otherwise("")).alias("s"), (F.col("n") % 14).cast("string").alias("a"))
    return w.select("id", X.is_entry_point(F.col("s")).alias("entry_point"), X.is_dispute(F.col("s")).alias("dispute"), X.is_for_org(F.concat(F.lit("Madde "), "a"), "bagli").alias("dependent"))


@query
def t18_is_not_found(spark, d):
    n = F.col("n")
    return documents(spark, d).select("id", X.is_not_found(F.concat("text", F.when(n % 3 == 0, " Bu BİLGİ dokümanlarda BULUNAMADI.").otherwise(""))).alias("value"))


@query
def t19_unsupported_numbers(spark, d):
    reply = F.concat(F.lit("Tutar "), (F.col("n") * 37).cast("string"), F.lit(",00 TL, 2,5 ve "), "text")
    return documents(spark, d).select("id", joined(X.unsupported_numbers(reply, F.concat("text", F.lit(" "), (F.col("n") * 37).cast("string")))).alias("value"))


@query
def t20_normalize_body(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("  - **"), x, F.lit("**  ")))
    return documents(spark, d).select("id", F.md5(joined(X.normalize_lines(lines))).alias("value"))


@query
def t21_snippet(spark, d):
    return documents(spark, d).select("id", X.snippet(F.concat(F.lit("[Dosya: a > b]\n"), "text")).alias("value"))


@query
def t22_finalize_classification(spark, d):
    raw = documents(spark, d).select("id", (F.col("n") % 15 / 10.0).alias("confidence"), F.split("text", " ").alias("entities"), F.col("text").alias("summary_long"))
    return registry.finalize_classification(raw).select("id", "confidence", joined("entities").alias("entities"), "needs_review", "summary")


@query
def t23_analysis_from_row(spark, d):
    n = F.col("n")
    rows = documents(spark, d).select("id", "filename", F.when(n % 2 == 0, words("text", 1, 2)).alias("doc_subject"), F.when(n % 3 == 0, words("text", 2, 2)).alias("doc_title"), F.when(n % 4 == 0, words("text", 1, 9)).alias("summary_long"), F.when(n % 5 > 0, F.col("doc_type")).alias("doc_type"), F.when(n % 3 == 1, "baska").otherwise(request_of(n)).alias("request"), F.lit(None).cast("string").alias("receivable"), F.when(n % 2 == 0, F.array("source")).alias("people"), "contains_pii", "confidence")
    return registry.analysis_from_row(rows).withColumn("people", joined("people"))


@query
def t24_tag_messages(spark, d):
    m = messages(spark, d).withColumn("content", F.concat("content", F.when(F.col("document_id") % 3 == 0, " Yazıyı ONAYLA").when(F.col("document_id") % 3 == 1, " hangi SERVİS?").otherwise("")))
    return correspondence.tag_messages(m).select("document_id", "seq", "may_ask_letter", "asks_routing")


def letter_input(spark, d):
    n = F.col("n")
    return documents(spark, d).select(
        F.col("id").alias("document_id"), F.when(n % 3 == 0, "").otherwise(words("text", 1, 25)).alias("title"), words("text", 3, 4).alias("subject"), F.when(n % 4 == 0, F.array(F.lit("Ali Veli"), F.lit("İzmir Vergi Mahkemesine"))).otherwise(X.strings()).alias("people"),
        F.when(n % 5 == 0, "4840847211").alias("vkn"), F.lit("10000000146").alias("tckn"), F.when(n % 3 == 0, "eksik_belge").otherwise("onay").alias("decision"), F.when(n % 2 == 0, "İhtilaflı İşler Servisi").otherwise("Tecil").alias("service"),
        F.when(n % 7 == 0, " Form Adı ").alias("form_name"), F.when(n % 11 == 0, "kurum").alias("form_kind"), F.lit(None).cast("string").alias("form_number"), F.when(n % 2 == 0, n).alias("letter_no"), F.expr("date_add(DATE '2026-01-05', cast(n % 300 as int))").alias("letter_date"),
    )


@query
def t25_build_letters(spark, d):
    return correspondence.build_letters(letter_input(spark, d), INSTITUTION).withColumn("missing", joined("missing"))


@query
def t26_letter_blocks(spark, d):
    docs = documents(spark, d)
    lines = F.slice(F.split("text", " "), 1, 3)
    return docs.select("id", L.address_line(F.replace(words("text", 1, 2), F.lit("ß"), F.lit("ss")), F.when(F.col("n") % 2 == 0, "kurum").otherwise("kisi")).alias("address"), joined(L.reference_lines(lines)).alias("refs"), joined(L.attachment_lines(F.slice(F.split("text", " "), 1, (F.col("n") % 3).cast("int")))).alias("attachments"), joined(L.contact_lines(INSTITUTION)).alias("contact"))


@query
def t27_document_record(spark, d):
    n = F.col("n")
    f = F.struct(F.lit("kritik").alias("severity"), F.when(n % 2 == 0, "eksik").otherwise("tutarsizlik").alias("kind"), F.lit("Tarih").alias("title"), words("text", 1, 2).alias("explanation"), words("text", 2, 2).alias("quote"))
    rows = documents(spark, d).select("id", "filename", "doc_type", words("text", 1, 3).alias("subject"), F.lit("").alias("summary"), F.lit(None).cast("string").alias("vkn"), F.lit("1").alias("tckn"), F.array("source", "doc_type").alias("people"), F.element_at(F.array(F.lit("new"), F.lit("completed"), F.lit("baska")), (n % 3 + 1).cast("int")).alias("lifecycle_status"), F.when(n % 3 == 0, F.array(f)).when(n % 3 == 1, F.slice(F.array(f), 1, 0)).alias("findings"), F.when(n % 2 == 0, "Tecil Servisi").alias("service"), F.when(n % 4 == 0, "Birim").alias("unit"), F.when(n % 2 == 0, 0.5).alias("confidence"), F.lit("neden").alias("reasoning"))
    return correspondence.document_record(rows)


@query
def t28_format_decision(spark, d):
    return routing.format_decision(decisions(spark, d), decision_hits(spark, d))


@query
def t29_escape_html(spark, d):
    return documents(spark, d).select("id", X.mark_placeholders(F.concat(F.lit('<a href="x">&[SIRA NO]'), "text")).alias("value"))


# index and retrieval


def points(spark, d):
    docs = documents(spark, d).withColumn("entities", F.array("source"))
    return docs.join(embedded_docs(spark, d), "id", "left").withColumn("doc_id", F.col("id"))


#: Indexes that were written in this session, by what they were made of.
INDEXES: dict = {}
POINT = "struct<doc_id:string,source:string,doc_type:string,entities:array<string>,contains_pii:boolean>"


def once(spark, d, name, make):
    """An index of the tables in ``d``, written once a session by ``make(path)`` and opened by every query over it."""
    key = spark.sparkContext.applicationId, d, name
    if key not in INDEXES:
        path = f"{shared_folder(spark)}/docketry/{name}-{uuid.uuid4().hex}"
        make(path)
        INDEXES[key] = path
    return INDEXES[key]


def stored_index(spark, d, corpus=None):
    """The sparse index of the documents (of one corpus)."""

    def make(path):
        # labels by hash: texts are not sorted, and are dealt out alike whatever the size of either table
        docs = documents(spark, d, "shuffle_hash").withColumn("entities", F.array("source")).withColumn("doc_id", F.col("id"))
        SparseIndex(spark, path, payload=POINT).add(docs if corpus is None else docs.where(F.col("corpus") == corpus))

    return SparseIndex(spark, once(spark, d, f"sparse-{corpus}", make))


def stored_vectors(spark, d, corpus=None):
    """The dense index of the vectors, or of those of one corpus' documents with what is known of them."""

    def make(path):
        if corpus is None:
            DenseIndex(spark, path).add(embedded_docs(spark, d))
        else:
            DenseIndex(spark, path, payload=POINT).add(points(spark, d).where(F.col("corpus") == corpus))

    return DenseIndex(spark, once(spark, d, f"dense-{corpus}", make))


def asked(spark, d):
    b = table(spark, d, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id"), "text", F.col("item_id").cast("string").alias("vec"))
    return b.join(embedded_docs(spark, d).select(F.col("id").alias("vec"), "embedding"), "vec", "left").drop("vec")


@query
def r1_term_id(spark, d):
    terms = documents(spark, d).select(F.explode(F.array_distinct(X.tokenize("text"))).alias("term")).distinct()
    return terms.select("term", X.term_id(F.col("term")).alias("term_id"))


@query
def r2_sparse_postings(spark, d):
    return search.sparse_postings(documents(spark, d)).select("chunk_id", "term_id", F.round("weight", 6).alias("weight"))


@query
def r3_term_idf(spark, d):
    docs = documents(spark, d)
    return search.term_idf(search.sparse_postings(docs), docs).select("term_id", "df", F.round("idf", 6).alias("idf"))


@query
def r4_sparse_search(spark, d):
    return stored_index(spark, d).search(asked(spark, d), 10).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query
def r5_dense_search(spark, d):
    asked = embedded_docs(spark, d).where(F.col("id").cast("bigint") % 50 == 0)
    return stored_vectors(spark, d).search(asked, 10).select("query_id", "chunk_id", "rank", F.round("score", 4).alias("score"))


@query
def r6_apply_filters(spark, d):
    return search.apply_filters(points(spark, d), doc_type="en", entity="src3").select("id")


def sparse_leg(spark, d):
    return stored_index(spark, d).search(asked(spark, d))


def legs(spark, d):
    return sparse_leg(spark, d), stored_vectors(spark, d).search(asked(spark, d))


@query
def r7_rrf_fuse(spark, d):
    return search.rrf_fuse(list(legs(spark, d))).select("query_id", "chunk_id", "rank", "score")


@query
def r8_hybrid_search(spark, d):
    return search.hybrid_search(asked(spark, d), stored_index(spark, d, "documents"), stored_vectors(spark, d, "documents")).select("query_id", "chunk_id", "rank", "score")


@query
def r9_rerank(spark, d):
    hits = sparse_leg(spark, d)
    scores = hits.where(F.col("query_id") != "q3").select("query_id", "chunk_id", F.length("chunk_id").cast("double").alias("rerank_score"))
    return search.rerank(hits, scores).select("query_id", "chunk_id", "rank")


def hits_of(spark, d):
    """Sparse hits with their document, joined by doc id as chunk id."""
    hits = sparse_leg(spark, d)
    docs = documents(spark, d).select(F.col("id").alias("chunk_id"), "filename", "text", "source", "doc_type", F.col("id").alias("doc_id"), (F.col("n") % 3).cast("int").alias("page"))
    # texts that were not found are left before anything else is done with them
    return hits.join(docs.join(hits.select("chunk_id"), "chunk_id", "left_semi"), "chunk_id")


@query
def r10_entity_search(spark, d):
    index, q = stored_index(spark, d), asked(spark, d)
    own = index.search(q, 10, search.passes(entity="src1", include_pii=True))
    return search.entity_search(own, index.search(q, 30)).select("query_id", "chunk_id", "rank", "stage")


@query
def r11_depth_by_intent(spark, d):
    intent = F.element_at(F.array(F.lit("doc_find"), F.lit("entity"), F.lit("other")), (F.length("query_id") % 3 + 1).cast("int"))
    return search.depth_by_intent(hits_of(spark, d).withColumn("intent", intent)).select("query_id", "chunk_id", "rank")


@query
def r12_search_in_documents(spark, d):
    pairs = table(spark, d, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), F.explode(F.array(F.lit("src0"), F.lit("src2"), F.lit("src5"))).alias("source"))
    return search.search_in_documents(stored_index(spark, d), asked(spark, d), pairs, 2, "source").select("query_id", "chunk_id", "rank")


def regulated(spark, d):
    k = F.col("doc_id").cast("bigint")
    return hits_of(spark, d).withColumn("article_no", F.concat(F.lit("Madde "), (k % 5 + 9).cast("string"))).withColumn("service", F.when(k % 3 > 0, F.concat(F.lit("S"), (k % 4).cast("string"))))


@query
def r13_prioritize_cited(spark, d):
    refs = table(spark, d, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), (F.col("item_id") % 5 + 9).cast("string").alias("article_no"))
    return search.prioritize_cited(regulated(spark, d), refs).select("query_id", "chunk_id", "rank")


@query
def r14_diversify(spark, d):
    return search.diversify(regulated(spark, d)).select("query_id", "chunk_id", "rank")


@query
def r15_filter_org_type(spark, d):
    return search.filter_org_type(regulated(spark, d), "bagli").select("query_id", "chunk_id", "rank")


@query
def r16_routing_candidates(spark, d):
    return search.routing_candidates(regulated(spark, d), "baskanlik").select("query_id", "chunk_id", "rank")


@query
def r17_group_by_document(spark, d):
    return search.group_by_document(hits_of(spark, d).withColumn("filename", F.col("source"))).withColumn("score", F.round("score", 4))


@query
def r18_build_context(spark, d):
    out = search.build_context(hits_of(spark, d))
    return out.select("query_id", F.md5("context").alias("context"), joined("sources").alias("sources"))


@query
def r19_expand_to_parent(spark, d):
    docs = documents(spark, d)
    child = docs.select("id", F.concat(F.lit("p"), "source").alias("parent_id"), "text", F.lit("child").alias("kind"))
    parents = docs.groupBy("source").agg(F.min("text").alias("text")).select(F.concat(F.lit("p"), "source").alias("id"), F.lit(None).cast("string").alias("parent_id"), "text", F.lit("parent").alias("kind")).where("id <> 'psrc4'")
    return search.expand_to_parent(sparse_leg(spark, d), child.unionByName(parents)).select("query_id", "unit_id", "chunk_id", "rank", F.md5("text").alias("text"))


@query
def r20_embedding_backlog(spark, d):
    docs, chunks = workflow(spark, d), line_chunks(spark, d)
    done = chunks.where("section = 'F'").select("id")
    marked = search.mark_embedded(search.reset_embeddings(chunks, docs, "regulations"), done, now())
    return search.embedding_backlog(marked, docs, "regulations").select("id", "doc_id")


@query
def r21_embed(spark, d):
    fn = lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]
    out = search.embed(documents(spark, d).where("text IS NOT NULL"), fn)
    return out.select("id", F.col("embedding")[0].cast("bigint").alias("chars"), F.col("embedding")[1].cast("bigint").alias("spaces"))


# routing


@query
def d1_service_catalog(spark, d):
    c = table(spark, d, "customer").withColumn("nk", F.col("c_nationkey").cast("bigint")).join(services(spark, d), "nk")
    article = (F.col("c_custkey") % 9 + 8).cast("string")
    meta = F.struct(F.lit("").alias("part"), F.lit("").alias("chapter"), "unit", "sub_unit", F.when(F.col("c_custkey") % 5 > 0, F.col("service")).alias("service"), "service_no", article.alias("article_no"), F.lit("").alias("title"), F.lit(True).alias("certain"))
    chunks = c.select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit("child").alias("kind"), meta.alias("metadata"))
    docs = c.select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "regulations").otherwise("documents").alias("corpus"))
    return routing.service_catalog(chunks, docs)


def flat(df, *more):
    cited = F.array_join(F.transform("citations", lambda c: c["article_no"]), ",")
    return df.select("decision_id", "main_unit", "other_unit", "service", cited.alias("cited"), "confidence", "undetermined", *more)


@query
def d2_verify_citations(spark, d):
    return flat(routing.verify_citations(decisions(spark, d), decision_hits(spark, d)), F.array_join("invented", ",").alias("invented"), "reasoning")


@query
def d3_cited_services(spark, d):
    return routing.cited_services(decisions(spark, d), decision_hits(spark, d)).select("decision_id", joined("services").alias("services"))


@query
def d4_reconcile_units(spark, d):
    return flat(routing.reconcile_units(decisions(spark, d), decision_hits(spark, d)), "corrected")


@query
def d5_flag_uncertain(spark, d):
    return routing.flag_uncertain(decisions(spark, d), decision_hits(spark, d)).select("decision_id", "uncertain")


@query
def d6_enforce_catalog(spark, d):
    return flat(routing.enforce_catalog(decisions(spark, d), services(spark, d).where("nk % 2 = 0")), "reasoning")


def priorities(spark, d):
    return table(spark, d, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_orderpriority").alias("service")).distinct()


@query
def d7_repair_routing(spark, d):
    return routing.repair_routing(workflow(spark, d), priorities(spark, d)).select("id", "routed_service", "routed_unit", "routing_confidence", "routing_status", "routing_reasoning")


@query
def d8_apply_decisions(spark, d):
    return routing.apply_decisions(workflow(spark, d), decisions(spark, d)).select("id", "routed_service", "routed_unit", "routing_confidence", "routing_status", "routing_key", "lifecycle_status")


@query
def d9_apply_manual(spark, d):
    k = F.col("l_linenumber") % 3
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.when(k == 1, "1-URGENT").when(k == 2, "9-NONE").otherwise("2-HIGH").alias("service"), F.when(F.col("l_linestatus") == "F", "neden").alias("reason"), F.col("l_linenumber").alias("at"))
    return routing.apply_manual(workflow(spark, d), o, priorities(spark, d)).select("id", "routed_service", "routing_reasoning", "routing_confidence", "routing_status")


@query
def d10_grading(spark, d):
    two = decisions(spark, d).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("service", F.when(F.col("attempt") == 2, F.concat("service", F.lit(" B"))).otherwise(F.col("service")))
    k = F.col("decision_id").cast("bigint")
    verdicts = two.select("decision_id", "attempt", ((k + F.col("attempt")) % 3 > 0).alias("grounded"), (k % 7 == 0).alias("desk_claim"))
    return flat(routing.apply_verdicts(two, verdicts), "attempt", "approved")


@query
def d10_grading_context(spark, d):
    return routing.grading_context(decisions(spark, d), decision_hits(spark, d)).select("decision_id", "rank", "service")


# queues, archives, audits


@query
def a1_service_queue_counts(spark, d):
    return registry.service_queue_counts(workflow(spark, d))


@query
def a2_service_queue(spark, d):
    return registry.service_queue(workflow(spark, d)).select("routed_service", "position", "id")


def board(spark, d):
    catalog = table(spark, d, "orders").select(F.col("o_orderpriority").alias("service")).distinct().select("service", F.concat(F.lit("A) Ana "), F.substring("service", 1, 1)).alias("unit"), F.when(F.startswith("service", F.lit("2")), "12").otherwise("11").alias("article_no"))
    return registry.service_board(catalog, registry.service_queue_counts(workflow(spark, d)), "baskanlik")


@query
def a3_service_board(spark, d):
    return board(spark, d)


@query
def a4_unit_rollup(spark, d):
    return registry.unit_rollup(board(spark, d))


@query
def a5_routing_inconsistencies(spark, d):
    w = workflow(spark, d)
    # a digest of all files of a key with their services, in the order of their names
    named = F.transform(F.sort_array(F.collect_list(F.struct("filename", "service"))), lambda f: F.concat_ws("=", f["filename"], f["service"]))
    files = registry.inconsistent_files(w).groupBy("routing_key").agg(F.md5(joined(named)).alias("files"))
    return registry.routing_inconsistencies(w).withColumn("services", joined("services")).join(files, "routing_key")


@query
def a5_inconsistent_files(spark, d):
    return registry.inconsistent_files(workflow(spark, d))


@query
def a6_routing_key_report(spark, d):
    return registry.routing_key_report(workflow(spark, d)).withColumn("services", joined("services"))


@query
def a7_archive_done(spark, d):
    return registry.archive_list(workflow(spark, d), letters(spark, d), True).select("id", "completed_at", "last_decision")


@query
def a7_archive_open(spark, d):
    return registry.archive_list(workflow(spark, d), letters(spark, d), False).select("id", "created_at", "last_decision")


@query
def a8_archive_counts(spark, d):
    return registry.archive_counts(workflow(spark, d))


@query
def a9_document_buckets(spark, d):
    return registry.document_buckets(workflow(spark, d))


@query
def a10_status_counts(spark, d):
    return registry.status_counts(workflow(spark, d))


@query
def a10_recent_failures(spark, d):
    return registry.recent_failures(workflow(spark, d))


@query
def a11_document_list(spark, d):
    return registry.document_list(workflow(spark, d), line_chunks(spark, d), "EVRAK-1")


@query
def a12_readiness(spark, d):
    paths = workflow(spark, d).select(F.when(F.col("n") % 6 == 0, F.concat("path", F.lit("?"))).otherwise(F.col("path")).alias("path"))
    return registry.readiness(paths, workflow(spark, d), line_chunks(spark, d))


@query
def a13_classification_samples(spark, d):
    return registry.classification_samples(workflow(spark, d), line_chunks(spark, d))


@query
def a14_gap_scan_backlog(spark, d):
    return registry.gap_scan_backlog(workflow(spark, d)).select("id")


@query
def a14_pipeline_backlog(spark, d):
    return registry.pipeline_backlog(workflow(spark, d)).select("id")


@query
def a15_classification_summary(spark, d):
    return registry.classification_summary(documents(spark, d).select((F.col("n") % 9 > 0).alias("ok"), "contains_pii", (F.col("n") % 10 / 10.0).alias("confidence")))


@query
def a15_gap_summary(spark, d):
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.when(F.col("l_returnflag") == "R", "kritik").otherwise("orta").alias("severity"))).alias("findings"))
    return registry.gap_summary(l)


@query
def a16_chunk_preview(spark, d):
    return registry.chunk_preview(line_chunks(spark, d), workflow(spark, d), "evrak-12")


def index_points(spark, d):
    k = F.col("doc_id").cast("bigint")
    return line_chunks(spark, d).where("kind = 'child'").select(F.when(k % 29 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id"), F.when(k % 31 == 0, F.concat("doc_id", F.lit("x"))).otherwise(F.col("doc_id")).alias("doc_id"))


@query
def a17_index_orphans(spark, d):
    return registry.index_orphans(index_points(spark, d), workflow(spark, d), line_chunks(spark, d))


@query
def a18_drop_orphans(spark, d):
    p = index_points(spark, d)
    return registry.drop_orphans(p, registry.index_orphans(p, workflow(spark, d), line_chunks(spark, d))).groupBy("doc_id").agg(F.count("*").alias("n"))


def own_tables(spark, d):
    return {"chunks": (line_chunks(spark, d), "doc_id"), "letters": (letters(spark, d), "document_id")}


@query
def a19_corpus_inventory(spark, d):
    return registry.corpus_inventory(own_tables(spark, d), workflow(spark, d), "regulations")


@query
def a20_purge_corpus(spark, d):
    out = registry.purge_corpus(own_tables(spark, d), workflow(spark, d), "regulations")
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def a21_backfill_lifecycle(spark, d):
    return registry.backfill_lifecycle(workflow(spark, d)).groupBy("lifecycle_status", "routing_status").agg(F.count("*").alias("n"))


def uploads(spark, d):
    # the lines of ten orders are uploads of one document
    document = F.col("l_orderkey") - F.col("l_orderkey") % 10 + 3
    return table(spark, d, "lineitem").select(F.concat(F.lit("u"), F.col("l_linenumber").cast("string")).alias("session_id"), document.cast("string").alias("document_id"), F.col("l_shipdate").alias("ts"))


@query
def a21_backfill_sessions(spark, d):
    return registry.backfill_sessions(workflow(spark, d), uploads(spark, d)).select("id", "session_id", "routed_service", "routing_status", "lifecycle_status", "routing_key")


@query
def a22_session_documents(spark, d):
    return registry.session_documents(workflow(spark, d), "s3", "23")


# chat, letters, evaluation


@query
def m1_chat_history(spark, d):
    return correspondence.chat_history(messages(spark, d), 3).select("document_id", "place", "seq", "role", F.md5("content").alias("content"))


@query
def m2_chat_exchanges(spark, d):
    return correspondence.chat_exchanges(messages(spark, d)).select("document_id", "seq", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query
def m2_append_exchange(spark, d):
    more = messages(spark, d).where("seq = 0").select("document_id", F.lit("soru").alias("question"), F.when(F.col("document_id") % 2 == 0, " ").otherwise("cevap").alias("answer"))
    return correspondence.append_exchange(messages(spark, d), more).select("document_id", "seq", "role", F.md5("content").alias("content"))


@query
def m3_letters_by_document(spark, d):
    return correspondence.letters_by_document(letters(spark, d)).select("document_id", "id", "place")


@query
def m4_assign_letter_numbers(spark, d):
    return correspondence.assign_letter_numbers(letters(spark, d), 48).select("id", "letter_no")


@query
def m5_draft_letters(spark, d):
    return correspondence.build_letters(letter_input(spark, d), INSTITUTION).select("document_id", "recipient", "recipient_kind", "recipient_number", "address_line", "closing")


def drafts(spark, d):
    n, k = F.col("n"), F.col("attempt")
    body = F.array(F.concat(F.lit("- **"), words("text", 1, 4), F.lit("** "), F.when((n + k) % 3 == 0, "98.765").otherwise("")), F.lit("  "))
    rows = documents(spark, d).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return rows.select(F.col("id").alias("document_id"), "attempt", F.when(n % 2 == 0, "red").otherwise("onay").alias("decision"), F.when(n % 4 == 0, " insan ").alias("human_reason"), X.strings().alias("references"), body.alias("paragraphs"), F.when(k == 1, "").otherwise("model").alias("model_reason"), F.concat_ws(" ", "text").alias("source"))


@query
def m6_select_draft(spark, d):
    return correspondence.select_draft(drafts(spark, d)).select("document_id", "attempt", "reason", joined("unsupported").alias("unsupported"), joined("paragraphs").alias("paragraphs"))


@query
def m7_number_source(spark, d):
    rows = documents(spark, d).select("id", F.col("source").alias("subject"), F.lit("ozet").alias("summary"), F.lit("").alias("receivable"), F.array("id").alias("dates"), X.strings().alias("amounts"), F.array("doc_type").alias("periods"), X.strings().alias("plates"), X.strings("A", "B").alias("people"), F.lit(None).cast("string").alias("vkn"), F.lit("1").alias("tckn"), F.array(F.struct(F.lit("11").alias("article_no"), F.lit("t").alias("title"))).alias("citations"), F.lit("").alias("reason"), "text")
    return correspondence.number_source(rows).select("id", F.md5("source").alias("source"))


def golden(spark, d):
    n = F.col("item_id")
    return table(spark, d, "benchmark").select(F.concat(F.lit("g"), n.cast("string")).alias("id"), F.when(n % 5 == 0, "trap").otherwise("entity").alias("scenario"), F.when(n % 3 > 0, F.array(F.concat(F.lit("SRC"), (n % 20).cast("string"), F.lit("/")))).otherwise(X.strings()).alias("expected_docs"), F.when(n % 4 > 0, F.array(F.upper(words("text", 1, 1)), words("text", 2, 1))).otherwise(X.strings()).alias("expected"), F.when(n % 6 == 0, F.array(words("text", 3, 1))).otherwise(X.strings()).alias("forbidden"))


def answers(spark, d):
    docs = documents(spark, d)
    n = F.col("n") % 40
    return docs.select(F.concat(F.lit("t"), F.floor(F.col("n") / 40).cast("string")).alias("target"), F.concat(F.lit("g"), n.cast("string")).alias("id"), F.when(F.col("n") % 9 > 0, F.concat(F.when(F.col("n") % 10 == 0, "Bilgi BULUNAMADI. ").otherwise(""), "text")).alias("answer"), F.array("filename").alias("sources"), F.when(F.col("n") % 9 == 0, "zaman asimi").alias("error"))


@query
def e1_grade_answers(spark, d):
    return correspondence.grade_answers(answers(spark, d), golden(spark, d)).drop("snippet")


@query
def e2_grade_failure(spark, d):
    return correspondence.grade_answers(answers(spark, d), golden(spark, d)).where("snippet LIKE 'HATA%'").select("target", "id", "source_hit", "trap_passed", "answer_hit", "forbidden_hit", "snippet")


@query
def e3_summarize(spark, d):
    return correspondence.summarize_eval(correspondence.grade_answers(answers(spark, d), golden(spark, d)))


@query
def e4_compare_targets(spark, d):
    return correspondence.compare_targets(correspondence.grade_answers(answers(spark, d), golden(spark, d)))


# streams, in their batch forms


def lifecycle_events(spark, d):
    t = F.col("event_type")
    status = F.when(t == "purchase", "completed").when(t == "click", "in_progress").when(t == "view", "routed").otherwise("new")
    return table(spark, d, "events").select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("document_id"), "ts", status.alias("status"), F.when((t == "purchase") & (F.col("event_id") % 2 == 0), "onay").alias("decision"), "event_id")


@query
def w1_ingest(spark, d):
    """All documents arrive, then a third of them changed and a third as they were; the second batch comes twice."""

    def make(path):
        store = streams.document_store(spark, path)
        docs = table(spark, d, "documents").where("text IS NOT NULL").select((F.col("doc_id") % 3).alias("r"), F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
        arrived = lambda rows, hour: rows.select("path", F.lit(f"2030-01-01 0{hour}:00:00").cast("timestamp").alias("modificationTime"), F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"))
        streams.ingest_files(store, arrived(docs, 1), batch=("arrivals", 0))
        later = docs.where("r < 2").withColumn("text", F.when(F.col("r") == 0, F.concat("text", F.lit("\n\n# Ek\n\nsonradan gelen"))).otherwise(F.col("text")))
        for _ in range(2):
            streams.ingest_files(store, arrived(later, 2), batch=("arrivals", 1))

    store = Store(spark, once(spark, d, "store", make))
    of = store.table("chunks").where("kind = 'child'").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.contains("text", F.lit("sonradan gelen"))).alias("changed"))
    rows = store.table("registry").join(of, "id", "left")
    return rows.select(F.regexp_extract("path", "([0-9]+)", 1).cast("bigint").alias("doc_id"), (F.col("id") == F.sha1("path")).alias("named"), "hash", "size_bytes", "status", (F.col("updated_at") > F.col("created_at")).alias("updated"), "changed")


@query
def w2_pending_jobs(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", F.when(F.col("event_type").isin("error", "purchase"), "done").otherwise("queued").alias("event"))
    return streams.pending_jobs(e).groupBy("job_id").agg(F.count("*").alias("runs"), F.min("ts").alias("first_at"))


@query
def w3_lifecycle_state(spark, d):
    return streams.lifecycle_state(lifecycle_events(spark, d))


@query
def w4_session_registry(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("session_id"), (F.col("event_id") % 50).alias("document_id"), "ts")
    r = streams.session_registry(e)
    return r.select("session_id", "document_id", "expires_at", (F.col("expires_at") > F.lit("2024-01-01 14:00:00").cast("timestamp")).alias("active"))


@query
def w5_split_official(spark, d):
    official, attached = registry.split_official(workflow(spark, d))
    return official.agg(F.count("*").alias("n")).select(F.lit("official").alias("part"), "n").unionByName(attached.agg(F.count("*").alias("n")).select(F.lit("attached").alias("part"), "n"))


# whole workloads


@query
def p1_search_files(spark, d):
    docs = structured(spark, d)
    index = workloads.index_corpus(docs, f"{shared_folder(spark)}/docketry/files-{uuid.uuid4().hex}")
    out = workloads.search_files(asked(spark, d), docs, index, 10)
    return out.select("query_id", "filename", F.round("score", 3).alias("score"), "n_hits")


@query
def p2_routing_queries(spark, d):
    rows = documents(spark, d).select("doc_type", request_of(F.col("n")).alias("request"), F.col("source").alias("receivable"))
    return workloads.routing_queries(rows)


@query
def p3_checked_decisions(spark, d):
    return flat(workloads.checked_decisions(decisions(spark, d), decision_hits(spark, d), services(spark, d)), "corrected")
