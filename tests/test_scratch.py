import pytest

from docketry.sources.scratch import SCAN_ROWS, small_batches

ARROW, SCAN = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"


def test_scans_and_arrow_batches_are_small_within_and_as_before_after(spark):
    before = [spark.conf.get(name, None) for name in (ARROW, SCAN)]
    with pytest.raises(ValueError), small_batches(spark, 1000):
        assert (spark.conf.get(ARROW), spark.conf.get(SCAN)) == ("1000", str(SCAN_ROWS))
        raise ValueError
    assert [spark.conf.get(name, None) for name in (ARROW, SCAN)] == before
