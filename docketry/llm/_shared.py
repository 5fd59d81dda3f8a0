"""Small helpers the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.sources.scratch import small_batches, writer

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: ``spark.checkpoint.dir`` where the cluster names it.

    Only where driver and executors are one process (local mode, as in tests) is a temporary folder made; a cluster
    without a shared folder is an error, as its executors would write to disks of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docketry-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docketry/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        writer(df).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and that no later job reads."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long, ``text`` as string, and the further columns named; every other column is left behind."""
    return docs.select(F.col("doc_id").cast(T.LongType()).alias("doc_id"), F.col("text").cast(T.StringType()).alias("text"), *more)


def sampled(rows: DataFrame, about: int, total: int, *by: str) -> DataFrame:
    """All rows where there are no more than ``about``, else about so many: those whose hash of the columns ``by`` is low.

    Equal rows go together; ``limit`` keeps their number from passing twice ``about``.
    """
    if total <= about:
        return rows
    low = F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in by], F.lit(13)), 1)
    return rows.where(low < int(about / total * (1 << 63))).limit(2 * about)


#: Rows of a key up to which it is not hot, and keys that can be hot at once: what is broadcast about hot keys has
#: no more rows than that, whatever the table.
HOT_ROWS, MOST_HOT = 256, 10_000


def hot_keys(rows: DataFrame, key: str, total: int, least: int = HOT_ROWS) -> DataFrame:
    """``key, parts``: the keys with more than ``least`` rows (or, in large tables, more than a ``MOST_HOT``-th of all) and
    in how many parts of such a size each is to be split."""
    size = max(least, total // MOST_HOT)
    n = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > size)
    return F.broadcast(n.select(key, F.ceil(F.col("n") / size).cast("int").alias("parts")))


def salted(rows: DataFrame, key: str, by: str, total: int, least: int = HOT_ROWS) -> DataFrame:
    """``rows`` with a ``salt``: 0, but for the rows of a hot key, which ``by`` deals to as many salts as it has parts."""
    deal = F.pmod(F.xxhash64(by, F.lit(29)), F.coalesce("parts", F.lit(1))).cast("int")
    return rows.join(hot_keys(rows, key, total, least), key, "left").withColumn("salt", deal).drop("parts")


#: Bits of a membership filter: 1 MB, whatever the number of members. Few false members up to a million; a fuller
#: filter lets more rows through, which costs time and never a result.
FILTER_BITS = 1 << 23
FILTER_SEEDS = np.array([0x1B873593CC9E2D51, 0x52DCE729DA3ED3F1, 0x38495AB5C2B2AE3D], np.uint64)


def _places(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64)[None, :] ^ FILTER_SEEDS[:, None]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & np.uint64(FILTER_BITS - 1)


def members(rows: DataFrame, column: str):
    """A Bloom filter of fixed size over a column (long), sent to all tasks: a function from ids to whether they may be in it.

    The filter is built in the tasks and combined before it reaches the driver. What needs the exact members joins them afterwards.
    """

    def marked(batches):
        bits = np.zeros(FILTER_BITS // 64, np.uint64)
        for batch in batches:
            at = _places(batch.column(0).drop_null().to_numpy(zero_copy_only=False)).ravel()
            np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        word = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits[word].view(np.int64))], names=["word", "mask"])

    words = rows.select(column).mapInArrow(marked, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def may_be(ids: pa.Array) -> np.ndarray:
        at = _places(ids.fill_null(0).to_numpy(zero_copy_only=False))
        return ((sent.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(axis=0)

    return may_be


def only_members(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` (long) is among that column of ``wanted``, and a few others: gone before a shuffle is what cannot match."""
    may_be = members(wanted, column)

    def passed(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_be(batch.column(column))))

    return rows.mapInArrow(passed, rows.schema)


def _least(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """``edges (u, v)`` with ``m`` of their ``u``. The few ``u`` with very many edges have theirs broadcast, so no task gets all edges of one."""
    size = max(HOT_ROWS, total // MOST_HOT)
    hot = F.broadcast(low.where(F.col("n") > size).select("u", "m"))
    rest = edges.join(hot.select("u"), "u", "left_anti").join(low.where(F.col("n") <= size).select("u", "m"), "u")
    return edges.join(hot, "u").select("u", "v", "m").unionByName(rest.select("u", "v", "m"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``(a long, b long)`` as ``(node, component)``, component = smallest node.

    Alternates the large-star and the small-star step until the edges stand still. Both steps are an
    aggregation (combined before the shuffle) and a join in which nodes with very many edges are not shuffled by
    node (``_least``), so their edges stay dealt to all tasks. Nodes without an edge are not returned.
    """
    cur = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen, total = None, cur.count()
    while True:
        # large star: every larger neighbour of a node goes to the node's smallest neighbour
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _least(both.where("v > u"), low, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, name)
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")
        small = _least(large, low, total).select(moved).select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        before, cur = cur, stored(small, name)
        got = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        discarded(before, large)
        if tuple(got) == seen:
            break
        seen, total = tuple(got), got.n
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
