"""The folder that driver and executors share for what jobs write on their way."""

from __future__ import annotations

import contextlib
import tempfile

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster names it. In local mode, where all is one process, a temporary folder is made;
    a cluster without a shared folder is an error, as its executors would write to disks of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docketry-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


#: Bytes of an Arrow batch while a table is written: what a Python worker and its task hold at once beside one row.
BATCH_BYTES = 2 << 20
#: Bytes of a row group of such a table: what a task holds while it writes or reads one.
ROW_GROUP_BYTES = 16 << 20


#: Rows that a scan of Parquet takes up at once: of long texts the 4,096 of Spark's default are tens of MB for each task.
SCAN_ROWS = 512


def bounded(size: int = BATCH_BYTES) -> dict[str, str]:
    """What bounds the rows that a task holds at once: Arrow batches of about ``size`` bytes, and batches of a scan."""
    return {"spark.sql.execution.arrow.maxBytesPerBatch": str(size), "spark.sql.parquet.columnarReaderBatchSize": str(SCAN_ROWS)}


@contextlib.contextmanager
def configured(spark: SparkSession, own: dict[str, str]):
    """Jobs that run within have these settings."""
    before = {name: spark.conf.get(name, None) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def small_batches(spark: SparkSession, size: int = BATCH_BYTES):
    """Jobs that run within hand Arrow batches of about ``size`` bytes to Python, and scan few rows at once."""
    return configured(spark, bounded(size))


def swept(spark: SparkSession):
    """What jobs that run within have shuffled is deleted when they end, not when the driver happens to collect its garbage."""
    return configured(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def writer(rows: DataFrame, group_bytes: int = ROW_GROUP_BYTES, compression: str | None = None) -> DataFrameWriter:
    """Row groups of a bounded size, also of rows that are very large: their size is looked at after each row, not after a hundred."""
    out = rows.write.option("parquet.block.size", group_bytes).option("parquet.page.size.row.check.min", 1)
    return out if compression is None else out.option("compression", compression)
