"""Tasks are cut by rows, however few row groups a file has."""

import pytest
from pyspark.sql import functions as F

from archivemill.session import TASK_ROWS, spread

ROWS = 3 * TASK_ROWS


@pytest.fixture
def one_row_group(spark, tmp_path):
    """A file of one row group that Spark splits in more parts than there are cores."""
    path = str(tmp_path / "rows")
    spark.range(0, ROWS, 1, 1).withColumn("x", F.rand(1)).write.parquet(path)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "50000")
    yield spark.read.parquet(path)
    spark.conf.set(key, before)


def test_no_task_gets_the_whole_row_group(one_row_group):
    assert one_row_group.rdd.getNumPartitions() >= 4
    sizes = spread(one_row_group, 5_000).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) <= 6_000 and sum(r["count"] for r in sizes) == ROWS


def test_a_small_table_still_goes_to_every_core(spark):
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 4


def test_nothing_is_lost_or_doubled(one_row_group):
    assert spread(one_row_group, 7_000).select("id").distinct().count() == ROWS
