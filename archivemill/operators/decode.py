"""Tolerant JSON decoding and message routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivemill.functions.scalars import epoch_ms_to_timestamp
from archivemill.functions.variants import get

POSITION = ["file", "block", "line"]

# Routes in the order they are tried; the first key found decides.
NOTICE_KEYS = ["delete", "scrub_geo", "limit", "status_withheld"]

# VARIANT fields tell a JSON null (not NULL) from an absent key (NULL).
ROUTE_FIELDS = ", ".join(f"{key} variant" for key in [*NOTICE_KEYS, "text", "full_text"])


def decode(lines: DataFrame, fields: str) -> DataFrame:
    """Add ``v``: the wanted fields of the line, NULL unless it is one JSON object.

    The line is read as the only element of an array: read alone, text after a
    complete object would be ignored, yet two records run together are a broken
    line.  Of two equal keys the last counts; a value of another type is NULL.
    """
    wrapped = F.concat(F.lit("["), F.col("value"), F.lit("]"))
    records = F.from_json(wrapped, f"array<struct<{fields}>>")
    single = F.when(F.size("_records") == 1, F.get("_records", F.lit(0)))
    return lines.withColumn("_records", records).withColumn("v", single).drop("_records")


def route(v: str) -> Column:
    """delete, scrub_geo, limit, status_withheld, message or reject."""
    column = F.when(F.isnull(v), "reject")
    for key in NOTICE_KEYS:
        column = column.when(F.col(f"{v}.{key}").isNotNull(), key)
    has_text = F.coalesce(f"{v}.text", f"{v}.full_text").isNotNull()
    return column.when(has_text, "message").otherwise("reject")


def routed(lines: DataFrame, fields: str = "") -> DataFrame:
    """Decoded lines with their ``route``; ``fields`` are read besides the routing keys."""
    wanted = f"{ROUTE_FIELDS}, {fields}" if fields else ROUTE_FIELDS
    return decode(lines, wanted).withColumn("route", route("v"))


def on_route(lines: DataFrame, wanted: str, *columns: Column | str) -> DataFrame:
    """``columns`` of the lines on one route.

    The rows are generated, not filtered: a filter on the route would be pushed
    below the decoding and have every line parsed again for its condition.
    """
    row = F.when(F.col("route") == wanted, F.struct(*columns))
    rows = routed(lines).select(F.explode(F.array(row)).alias("row"))
    return rows.filter(F.col("row").isNotNull()).select("row.*")


def reject_reason(value: Column, v: Column) -> Column:
    other_json = F.try_parse_json(value).isNotNull() & ~F.startswith(F.ltrim(value), F.lit("{"))
    return F.when(v.isNotNull(), "no_text").when(other_json, "not_object").otherwise("bad_json")


def line_numbers(positions: DataFrame) -> DataFrame:
    """``(file, block, first, offset)``: the least ``line`` of each block, and the file's lines before the block.

    The lines of a block must have no gaps.  ``offset + line - first`` is then the line's number in its file, from
    0, however the file was split.  One row a split.
    """
    blocks = positions.groupBy("file", "block").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("last") - F.col("first") + 1
    return blocks.select("file", "block", "first", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("offset"))


def status_withheld_notices(lines: DataFrame) -> DataFrame:
    return on_route(lines, "status_withheld", *POSITION, "value")


def counts_probe(lines: DataFrame) -> DataFrame:
    """Do the messages carry reply counts?  One row.

    Messages with ``in_reply_to_status_id`` but without ``reply_count`` come
    from a source without these counts (timeline mode).
    """
    flags = routed(lines, "in_reply_to_status_id variant, reply_count variant").select(
        (F.col("route") == "message").alias("is_message"),
        F.col("v.in_reply_to_status_id").isNotNull().alias("reply_key"),
        F.col("v.reply_count").isNotNull().alias("count_key"),
    )
    full = F.col("is_message") & F.col("reply_key") & F.col("count_key")
    bare = F.col("is_message") & F.col("reply_key") & ~F.col("count_key")
    odd = F.col("is_message") & ~F.col("reply_key")
    return flags.agg(
        F.count_if(full).alias("with_counts"),
        F.count_if(bare).alias("without_counts"),
        F.count_if(odd).alias("undecidable"),
    ).withColumn("timeline", (F.col("with_counts") == 0) & (F.col("without_counts") > 0))


def deletions(lines: DataFrame) -> DataFrame:
    """Deletion notices as rows; not de-duplicated."""
    millis = get("v.delete", "timestamp_ms", "string")
    return on_route(
        lines,
        "delete",
        get("v.delete", "status.id", "bigint").alias("id"),
        get("v.delete", "status.user_id", "bigint").alias("author_id"),
        millis.try_cast("bigint").alias("timestamp_ms"),
        epoch_ms_to_timestamp(millis).alias("deletion_time"),
    )
