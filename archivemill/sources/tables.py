"""Stored tables: Parquet by default, CSV with pinned types."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivemill.functions.scalars import from_one_line
from archivemill.schema import csv_schema


def read_table(
    spark: SparkSession,
    folder: str,
    name: str,
    columns: list[str] | None = None,
    *,
    fmt: str = "parquet",
    timeline: bool = False,
    optional: bool = False,
    one_line: bool = True,
) -> DataFrame:
    """One of the tables by name.

    CSV columns get their declared types, never inferred ones, and an empty
    quoted field stays an empty string.  A missing ``optional`` table is empty.
    ``one_line``: the CSV is as the sink here writes it, a row a line, and is split between tasks; else line
    ends stand in quoted fields as they are, and a file is read by one task.
    """
    path = f"{folder}/{name}"
    schema = csv_schema(name, timeline=timeline)
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = (
            reader.option("header", True)
            .option("escape", '"')
            .option("multiLine", not one_line)
            # Stands for the unquoted empty field; a quoted one is empty text.
            .option("nullValue", "\0")
            .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
        )
    try:
        df = reader.format(fmt).load(path)
    except AnalysisException as error:
        if not optional or "PATH_NOT_FOUND" not in str(error):
            raise
        df = spark.createDataFrame([], schema)
    if fmt == "csv" and one_line:
        df = df.select(*(from_one_line(F.col(f.name)).alias(f.name) if f.dataType == T.StringType() else f.name for f in df.schema))
    return df.select(*columns) if columns else df

