"""Latest row per key, and distinct rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivemill.operators.tables import SIGHTING_ORDER


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row that comes first under ``order`` for every key.

    ``row_number() = 1`` is also applied before the shuffle (group limit), so a
    key that holds a third of all rows still sends one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def sighting_order() -> list[Column]:
    """Latest ``access`` first; at equal times the line read last, outer before embedded."""
    return [*(F.col(c).desc() for c in ("access", "file", "block", "line")), F.col("depth").asc()]


def latest_sighting(df: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Latest by ``access``; at equal times the line read last, outer before embedded."""
    return latest_by_key(df, keys, sighting_order()).drop(*SIGHTING_ORDER)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()
