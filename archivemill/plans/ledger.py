"""A ledger of archive files: what was tried with which file, so that a run takes what is due and no more.

An entry holds a file's path, length and time as they were, the state it was left in and how often it was tried.  Entries
are only added, a folder a batch; the latest of a file counts.  One run at a time may use a ledger.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivemill.functions.scalars import path_date
from archivemill.operators.mining import mine_read
from archivemill.plans.sinks import remove, write_mined
from archivemill.plans.staging import stage_path
from archivemill.sources.archive import is_mounted, read_archive

#: ``state``: begun, mined, broken, or gone where the file was no longer there.
ENTRY = "path string, uri string, length bigint, time timestamp, state string, reason string, tries int, batch string"

_BEGUN, _ENDED = "begun", "ended"


def _names(spark: SparkSession, folder: str) -> list[str]:
    """The complete folders below one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    mark = spark._jvm.org.apache.hadoop.fs.Path
    found = [entry.getPath() for entry in store.listStatus(place) if entry.isDirectory()]
    return sorted(p.getName() for p in found if store.exists(mark(p, "_SUCCESS")))


def _entries(spark: SparkSession, ledger: str, kind: str) -> DataFrame:
    paths = [f"{ledger}/{kind}/{name}" for name in _names(spark, f"{ledger}/{kind}")]
    return spark.read.schema(ENTRY).parquet(*paths) if paths else spark.createDataFrame([], ENTRY)


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``(path, uri, length, time)`` of the ``.bz2`` files below a folder; an empty file is listed when it has content.

    Spark lists; no content is read.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.bz2").load(root)
    )
    uri = F.col("_metadata.file_path")
    return files.select(_plain(F.col("path")).alias("path"), uri.alias("uri"), "length", F.col("modificationTime").alias("time"))


def current(spark: SparkSession, ledger: str) -> DataFrame:
    """The latest entry of every file that was tried to its end."""
    whole = F.struct("batch", "path", "uri", "length", "time", "state", "reason", "tries")
    return _entries(spark, ledger, _ENDED).groupBy("path").agg(F.max_by(whole, "batch").alias("e")).select("e.*")


def due(files: DataFrame, known: DataFrame, most_tries: int) -> DataFrame:
    """The files to be read, and how often they were tried as they are now.

    Due is a file without an entry, one that was written anew since its entry, and a broken one that was tried less than
    ``most_tries`` times.  One join of the listing with the ledger.
    """
    old = known.select("path", *(F.col(c).alias(f"_{c}") for c in ("length", "time", "state", "tries")))
    same = F.col("length").eqNullSafe(F.col("_length")) & F.col("time").eqNullSafe(F.col("_time"))
    again = (F.col("_state") == "broken") & (F.col("_tries") < most_tries)
    return (
        files.join(old, "path", "left").where(F.col("_state").isNull() | ~same | again)
        .select("path", "uri", "length", "time", F.when(same, F.col("_tries")).otherwise(0).alias("tries"))
    )


def mine_due(
    spark: SparkSession, root: str, folder: str, ledger: str, *, most_tries: int = 3, files_per_batch: int = 10_000
) -> int:
    """Mine the files that are due below ``root`` into ``folder``, and return how many batches that took.

    The files are dealt to batches of about ``files_per_batch``, whose paths pass through the driver.  A batch is entered before its files
    are read and after its lines are written, into the one subfolder it owns: a call that fails
    is taken up by the next one, which writes the same batches again, so no line is lost or doubled.  A file that
    is mined and then written anew is mined again.  The files that are broken now stand in the subfolder ``batch=report``.
    """
    begun, ended = _names(spark, f"{ledger}/{_BEGUN}"), _names(spark, f"{ledger}/{_ENDED}")
    open_batches = [name for name in begun if name not in set(ended)]
    for name in open_batches:
        _mine_batch(spark, root, folder, ledger, name)
    path = stage_path(spark, "due")
    due(listing(spark, root), current(spark, ledger), most_tries).write.parquet(path)
    try:
        files = spark.read.parquet(path)
        batches = -(-files.count() // files_per_batch)
        run, names = uuid.uuid4().hex, []
        for i in range(batches):
            name = f"{len(begun) + i:08d}-{run}"
            own = files.where(F.pmod(F.xxhash64("path"), F.lit(batches)) == i)
            entered = own.select(
                "path", "uri", "length", "time", F.lit(_BEGUN).alias("state"), F.lit(None).cast("string").alias("reason"),
                F.col("tries").cast("int").alias("tries"), F.lit(name).alias("batch"),
            )
            entered.coalesce(1).write.mode("overwrite").parquet(f"{ledger}/{_BEGUN}/{name}")
            names.append(name)
    finally:
        remove(spark, path)
    for name in names:
        _mine_batch(spark, root, folder, ledger, name)
    if open_batches or names:
        _report(spark, folder, ledger)
    return len(open_batches) + batches


def _mine_batch(spark: SparkSession, root: str, folder: str, ledger: str, name: str) -> None:
    entered = spark.read.schema(ENTRY).parquet(f"{ledger}/{_BEGUN}/{name}")
    # As the files are now: one may have gone, or been written to, since it was entered.
    there = listing(spark, root).select("path", F.col("length").alias("_length"), F.col("time").alias("_time"))
    path, target = stage_path(spark, "batch"), f"{folder}/batch={name}"
    entered.join(there, "path", "left").withColumn("_there", F.col("_time").isNotNull()).write.parquet(path)
    try:
        files = spark.read.parquet(path)
        mounted = is_mounted(spark, root)
        chosen = [r[0] for r in files.where("_there").select("uri" if mounted else "path").collect()]  # about files_per_batch
        if chosen:
            write_mined(mine_read(read_archive(spark, chosen, direct=mounted)), target, mode="overwrite")
        _end_batch(spark, files, target, ledger, name)
    finally:
        remove(spark, path)


def _end_batch(spark: SparkSession, files: DataFrame, target: str, ledger: str, name: str) -> None:
    """Enter what became of a batch's files; their faults move from the mined lines to the ledger."""
    bad = spark.createDataFrame([], "path string, _reason string")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/kind=unusable")
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        found = spark.read.text(f"{target}/kind=unusable")
        value = lambda key: F.get_json_object("value", f"$.{key}")
        path = F.url_decode(F.replace(value("path"), F.lit("+"), F.lit("%2B")))  # writers of URIs differ in what they escape
        bad = found.select(_plain(path).alias("path"), value("reason").alias("_reason"))
    state = F.when(~F.col("_there"), "gone").when(F.col("_reason").isNotNull(), "broken").otherwise("mined")
    done = files.join(bad, "path", "left").select(
        "path", "uri", F.coalesce("_length", "length").alias("length"), F.coalesce("_time", "time").alias("time"),
        state.alias("state"), F.col("_reason").alias("reason"), (F.col("tries") + 1).cast("int").alias("tries"), "batch",
    )
    done.coalesce(1).write.mode("overwrite").parquet(f"{ledger}/{_ENDED}/{name}")
    remove(spark, f"{target}/kind=unusable")


def _report(spark: SparkSession, folder: str, ledger: str) -> None:
    """The files that are broken now, as mining runs report them."""
    value = F.to_json(F.struct(F.col("uri").alias("path"), "reason"))
    broken = current(spark, ledger).where("state = 'broken'")
    rows = broken.select(F.lit("unusable").alias("kind"), path_date(F.col("uri")).alias("date"), value.alias("value"))
    target = f"{folder}/batch=report"
    if broken.isEmpty():
        remove(spark, target)
    else:
        rows.coalesce(1).write.mode("overwrite").partitionBy("kind", "date").text(target)
