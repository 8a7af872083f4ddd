"""Text sources: the compressed minute archive and JSON-lines folders.

All give lines as ``(file, block, line, value)``.  ``(block, line)`` orders the
lines of a file; ``block`` also cuts it into pieces of bounded size.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivemill.sources.archive_source import ArchiveSource
from archivemill.sources.unpacking import STEPS, unpacked

Paths = str | list[str]


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column(0), batch.column(1), strict=True):
            data = content.as_buffer().to_pybytes()
            yield from unpacked(file.as_py(), lambda data=data: io.BytesIO(data))


def lines_of(steps: DataFrame) -> DataFrame:
    """``STEPS`` as ``(file, block, line, value, reason)``: a row per line that is not blank, or per broken file."""
    cut = F.posexplode_outer(F.split("text", "\n")).alias("_at", "value")
    lines = steps.select("file", "block", "first", cut, "reason")
    kept = lines.where(F.col("reason").isNotNull() | (F.length("value") > 0))
    line = F.coalesce(F.col("first") + F.col("_at"), F.lit(0)).cast("long")
    return kept.select("file", "block", line.alias("line"), "value", "reason")


def read_archive(spark: SparkSession, root: Paths, *, direct: bool | None = None) -> DataFrame:
    """Every ``.bz2`` file below ``root``: its lines, or one row with the ``reason`` why it has none.

    A task decompresses its files one after the other, and gives out a file's first line when it
    has read the file to its end without a fault; so a broken file gives no line, and memory does
    not grow with the decompressed size.  The lines of a file stand together in their
    order.  Blank lines are left out but counted.  An error of the store fails the task, which is
    tried again: nothing is dropped for it.

    ``direct`` reads with the data source of ``archive_source``: files of any size, dealt to tasks by their sizes,
    empty ones reported.  It is the default for mounted folders.  Other stores are
    read through Spark, where a compressed file of 2 GB or more is refused with an error, and an empty
    file is not listed.
    """
    roots = [root] if isinstance(root, str) else list(root)
    if direct is None:
        direct = all(is_mounted(spark, r) for r in roots)
    if direct:
        spark.dataSource.register(ArchiveSource)
        return lines_of(spark.read.format(ArchiveSource.name()).option("roots", json.dumps(roots)).load())
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.bz2").load(roots)
    )
    return lines_of(files.select(F.col("_metadata.file_path").alias("_file"), "content").mapInArrow(_unpack, STEPS))


def stream_archive(spark: SparkSession, root: Paths) -> DataFrame:
    """``read_archive`` as a stream of the files that appear below mounted folders.

    The offset is the time and path of the latest file read: a file that is written anew, say because it was still
    being uploaded, is read again, so a file should come under its name when it is whole.
    """
    roots = [root] if isinstance(root, str) else list(root)
    spark.dataSource.register(ArchiveSource)
    return lines_of(spark.readStream.format(ArchiveSource.name()).option("roots", json.dumps(roots)).load())


def is_mounted(spark: SparkSession, path: str) -> bool:
    """Whether the path, without a pattern in it, lies in a folder of this machine's file system."""
    if any(c in path for c in "*?[{"):
        return False
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def archive_lines(spark: SparkSession, root: Paths) -> DataFrame:
    """Lines of every intact ``.bz2`` file below ``root``."""
    return read_archive(spark, root).where("reason IS NULL").drop("reason")


def skipped_files(spark: SparkSession, root: Paths) -> DataFrame:
    """``(path, reason)`` of the archive files that are broken and so give no lines."""
    return read_archive(spark, root).where("reason IS NOT NULL").select(F.col("file").alias("path"), "reason")


def json_lines(spark: SparkSession, folder: str, *, blanks: bool = False, names: str = "*.json*") -> DataFrame:
    """Lines of the files in ``folder`` whose name contains ``.json``, less blank ones; files are split.

    ``line`` orders the lines of a block of a file and has no gaps there if ``blanks`` are kept; ``decode.line_numbers`` makes
    line numbers of it.
    """
    text = spark.read.option("pathGlobFilter", names).text(folder)
    lines = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    return lines if blanks else lines.where(F.length(F.trim("value")) > 0)


# What a mining run writes that is made of messages.
MINED_KINDS = ("tweets", "users", "messages")


def mined_lines(spark: SparkSession, folder: str, kinds: tuple[str, ...] = MINED_KINDS) -> DataFrame:
    """Lines of a mining run's output, whose part files are named anew by every run.

    So the position of a line comes from its folder and its content: equal times are
    then decided alike whichever way the same lines were written.
    """
    text = spark.read.text(folder)
    return text.where(F.col("kind").isin(*kinds)).select(
        F.concat_ws("/", "kind", F.col("date").cast("string")).alias("file"),
        F.lit(0).cast("long").alias("block"),
        F.xxhash64("value").alias("line"),
        "value",
    )
