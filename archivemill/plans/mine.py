"""Archive -> mined JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from archivemill.operators.mining import mine, mine_read
from archivemill.plans.sinks import write_mined
from archivemill.sources.archive import Paths, read_archive


def run_mine(lines: DataFrame, folder: str, *, mode: str = "append") -> None:
    write_mined(mine(lines), folder, mode=mode)


def mine_archive(spark: SparkSession, root: Paths, folder: str, *, mode: str = "append") -> None:
    """Mine an archive; what is wrong with which file stands under ``kind=unusable``.

    The archive is read once, and only the mined lines are shuffled.
    """
    write_mined(mine_read(read_archive(spark, root)), folder, mode=mode)
