"""Writers for mined lines, tables and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivemill.functions.scalars import as_text, one_line
from archivemill.operators.mining import as_json


def write_mined(mined: DataFrame, folder: str, *, mode: str = "append") -> None:
    """JSON lines under ``kind=.../date=...``.

    The rebalance keeps the file count low and lets AQE split a heavy date.
    """
    rows = as_json(mined).hint("rebalance", "kind", "date")
    rows.write.mode(mode).partitionBy("kind", "date").text(folder)


def write_table(
    df: DataFrame,
    path: str,
    *,
    fmt: str = "parquet",
    mode: str = "overwrite",
    skip_empty: bool = False,
) -> bool:
    """Write one table; False when ``skip_empty`` held it back."""
    if skip_empty and df.isEmpty():
        return False
    if fmt == "csv":
        # No field holds a line end, so that one file can be read by many tasks.
        blanks = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
        text = as_text(df)
        on_lines = [one_line(F.col(f.name)).alias(f.name) if f.dataType == T.StringType() else f.name for f in text.schema]
        text.select(*on_lines).write.mode(mode).option("header", True).option("escape", '"').options(**blanks).csv(path)
    else:
        df.write.mode(mode).format(fmt).save(path)
    return True


def write_in_order(df: DataFrame, path: str, order: list[Column], *, fmt: str = "parquet", mode: str = "overwrite") -> bool:
    """Write a table so that its files, one after the other by name, are sorted.

    Tasks take ranges of the keys, cut by a sample of them, and sort inside; a key may fill
    one range, so the last of ``order`` should tell equal ones apart.
    """
    return write_table(df.repartitionByRange(*order).sortWithinPartitions(*order), path, fmt=fmt, mode=mode)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark writes to; one that is not there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def write_notices(notices: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Withholding notices as they came, one JSON object per line."""
    notices.select("value").write.mode(mode).text(path)
