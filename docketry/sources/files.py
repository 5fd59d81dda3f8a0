"""Files in, model output in."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.sources.scratch import shared_folder, writer

# The kinds of files that are taken in.
FORMATS = (".pdf", ".docx", ".xlsx", ".pptx", ".html", ".txt", ".md")


def extension(path) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def _opened(path: str):
    """The file system of a path as Hadoop writes it, the path there, and a function back."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", path), lambda own: f"file:{own}"
    where, rest = re.match("([^:]+://[^/]*)(/.*)?$", path).groups()
    store, base = fs.FileSystem.from_uri(f"{where}/")
    base = base.rstrip("/")
    return store, base + (rest or ""), lambda own: where + own[len(base) :]


def _hidden(name: str) -> bool:
    """What Spark's readers leave out."""
    return (name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)) and not name.startswith(("_metadata", "_common_metadata"))


#: Paths and bytes of a batch, and files and bytes of a task that reads them.
LISTED, READ_BYTES, TASK_FILES, TASK_BYTES = 5_000, 2 << 20, 5_000, 32 << 20


def _listed(folders: DataFrame) -> DataFrame:
    """``path, ms, length, folder`` of what lies in each of the folders ``path``."""
    schema = pa.schema([("path", pa.string()), ("ms", pa.int64()), ("length", pa.int64()), ("folder", pa.bool_())])

    def run(batches):
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                store, at, named = _opened(folder)
                found = store.get_file_info(fs.FileSelector(at))
                for i in range(0, len(found), LISTED):
                    own = [f for f in found[i : i + LISTED] if f.type in (fs.FileType.File, fs.FileType.Directory) and not _hidden(f.base_name)]
                    yield pa.RecordBatch.from_arrays([pa.array([named(f.path) for f in own], pa.string()), pa.array([f.mtime_ns // 1_000_000 for f in own], pa.int64()), pa.array([f.size or 0 for f in own], pa.int64()), pa.array([f.type == fs.FileType.Directory for f in own], pa.bool_())], schema=schema)

    return folders.mapInArrow(run, "path string, ms bigint, length bigint, folder boolean")


def _read(listing: DataFrame) -> DataFrame:
    """``listing`` with the ``content`` of its files, of a batch of ``READ_BYTES`` at a time."""
    schema = pa.schema([("path", pa.string()), ("ms", pa.int64()), ("length", pa.int64()), ("content", pa.binary())])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                store, at, _ = _opened(row["path"])
                with store.open_input_stream(at) as file:
                    held.append(row | {"content": file.read()})
                size += len(held[-1]["content"])
                if size >= READ_BYTES or len(held) >= LISTED:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    n = listing.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-n["files"] // TASK_FILES), -(-n["bytes"] // TASK_BYTES))
    return listing.repartition(parts).mapInArrow(run, "path string, ms bigint, length bigint, content binary")


def scan_files(spark: SparkSession, root: str, formats: tuple[str, ...] = FORMATS, content: bool = True) -> DataFrame:
    """Files of the known kinds below ``root`` (``path, modificationTime, length``, and their ``content``); names that begin with a dot (or, as everywhere
    in Spark, an underscore) are left out.

    Folders are listed by tasks, level by level, into a table in the shared folder, and files are read by tasks: the driver holds no list of them, a
    task that of one folder. Where Arrow does not know the file system, Spark's reader lists the files, which are then all held by the driver.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    roots = [f.getPath().toString() for f in found or [] if f.isDirectory()]
    known = extension(F.col("path")).isin(*formats) & ~F.col("path").rlike(r"/\.[^/]*$")
    if not roots or len(roots) < len(found) or not all(map(_known, roots)):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(known)
        return files if content else files.drop("content")
    levels, rows = [], spark.createDataFrame([(r,) for r in roots], "path string")
    n = len(roots)
    while n:
        levels.append(f"{shared_folder(spark)}/docketry/listing-{uuid.uuid4().hex}")
        found = _listed(rows.repartition(min(n, 4 * spark.sparkContext.defaultParallelism)))
        writer(found.where(F.col("folder") | known)).parquet(levels[-1])
        rows = spark.read.schema(found.schema).parquet(levels[-1]).where("folder").select("path")
        n = rows.count()
    listing = spark.read.schema(found.schema).parquet(*levels).where("NOT folder").drop("folder")
    out = _read(listing) if content else listing
    return out.select("path", F.timestamp_millis("ms").alias("modificationTime"), "length", *(["content"] if content else []))


def _known(path: str) -> bool:
    try:
        return bool(_opened(path))
    except (pa.ArrowException, OSError):
        return False


def with_file_identity(files: DataFrame, *more: Column) -> DataFrame:
    """``job_id, path, filename, format, size_bytes, hash`` (and ``more``) of ``path, content, length`` files."""
    return files.select(F.sha1("path").alias("job_id"), "path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.substring(extension(F.col("path")), 2, 20).alias("format"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("hash"), *more)


def read_text_documents(spark: SparkSession, root: str) -> DataFrame:
    """Plain text and Markdown files as UTF-8; bytes that are none become U+FFFD."""
    return scan_files(spark, root, (".txt", ".md")).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


PAGES = "struct<texts:array<struct<text:string,prov:array<struct<page_no:int>>>>>"


def page_entries(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, norm_text, page`` of a parser's JSON (``id, parser_json``): entries with a text and a page."""
    items = docs.select(F.col("id").alias("doc_id"), F.from_json("parser_json", PAGES).alias("j")).select("doc_id", F.posexplode("j.texts").alias("pos", "t"))
    page = F.get(F.col("t.prov"), F.lit(0))["page_no"]
    return items.where(F.col("t.text").isNotNull() & page.isNotNull()).select("doc_id", "pos", F.trim(F.regexp_replace(F.lower("t.text"), r"\s+", " ")).alias("norm_text"), page.alias("page"))


def parse_model_output(df: DataFrame, schema: str, required: tuple[str, ...] = (), enums: Mapping[str, tuple[str, ...]] | None = None, ranges: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """The first valid of each ``id``'s attempts (``id, attempt, raw``): ``id, ok, attempt, value``.

    Valid is JSON of the schema with every required field there, enums within their values (NULL passes) and numbers
    within their ranges. Without a valid attempt ``ok`` is false and the value NULL.
    """
    parsed = df.withColumn("value", F.from_json("raw", schema))
    good = F.col("value").isNotNull()
    for f in required:
        good &= F.col(f"value.{f}").isNotNull()
    for f, values in (enums or {}).items():
        good &= F.col(f"value.{f}").isNull() | F.col(f"value.{f}").isin(*values)
    for f, (low, high) in (ranges or {}).items():
        good &= F.coalesce(F.col(f"value.{f}").between(low, high), F.lit(False))
    parsed = parsed.withColumn("good", F.coalesce(good, F.lit(False)))
    first = F.min_by(F.when(F.col("good"), F.struct("attempt", "value")), F.when(F.col("good"), F.col("attempt")))
    return parsed.groupBy("id").agg(F.max("good").alias("ok"), first.alias("f")).select("id", "ok", "f.attempt", "f.value")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a golden set: a JSON object with a list ``questions``, or a list of questions."""
    raw = spark.read.option("multiLine", True).json(path)
    rows = raw.select(F.explode("questions").alias("q")).select("q.*") if "questions" in raw.columns else raw
    none = F.expr("cast(array() as array<string>)")
    get = lambda c: F.coalesce(F.col(c), none) if c in rows.columns else none
    return rows.select("id", "scenario", "question", get("expectedDocs").alias("expected_docs"), get("expectedAnswerContains").alias("expected"), get("expectedAnswerNotContains").alias("forbidden"))
