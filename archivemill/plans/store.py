"""Tables kept up run by run: rows lie in buckets by key, a run rewrites the buckets it touches, and a
manifest says which folder holds which bucket.

A run writes new folders only and then one manifest, which readers resolve: a run that fails,
or is still going on, leaves everything as it was.  One run at a time may write to a store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivemill.operators import flatten
from archivemill.operators.decode import deletions
from archivemill.operators.latest import distinct_rows, latest_by_key, sighting_order
from archivemill.operators.tables import DISTINCT_TABLES, LATEST_TABLES
from archivemill.plans import counts
from archivemill.plans.counts import COUNTS
from archivemill.plans.parse import PARALLEL_WRITES, split_stage
from archivemill.plans.sinks import remove
from archivemill.plans.staging import stage_path
from archivemill.schema import TABLES

#: Buckets of a new store; choose it so that a bucket of the largest table stays a few hundred MB.
BUCKETS = 64
_POSITION = "file string, block bigint, line bigint, depth int"

Manifest = dict


def stored_schema(name: str) -> str:
    """A table's columns; of the latest-row tables also where the row was read, which decides between equal times."""
    if name in COUNTS:
        return COUNTS[name]
    return f"{TABLES[name]}, {_POSITION}" if name in LATEST_TABLES else TABLES[name]


def key_of(name: str) -> str:
    """The column that deals a table's rows to buckets: its first one, an id."""
    return stored_schema(name).split()[0]


def folded(rows: DataFrame, name: str) -> DataFrame:
    """What a table keeps of its rows: the latest of each id, or the distinct ones."""
    return latest_by_key(rows, ["id"], sighting_order()) if name in LATEST_TABLES else distinct_rows(rows)


# --- the manifest ------------------------------------------------------------


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, folder: str) -> list[int]:
    store, place = _place(spark, f"{folder}/manifest")
    if not store.exists(place):
        return []
    names = [entry.getPath().getName() for entry in store.listStatus(place)]
    return sorted(int(name.removesuffix(".json")) for name in names if name[0].isdigit() and name.endswith(".json"))


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> Manifest:
    """The latest published manifest, or that of a version: buckets, and by table the folder of each bucket."""
    found = _versions(spark, folder)
    if not found:
        return {"version": 0, "buckets": None, "tables": {}}
    number = found[-1] if version is None else version
    text = spark.read.text(f"{folder}/manifest/{number:012d}.json", wholetext=True).first()
    return json.loads(text.value)


def publish(spark: SparkSession, folder: str, new: Manifest) -> None:
    """Make a manifest the current one: written beside, then given its name at once."""
    store, final = _place(spark, f"{folder}/manifest/{new['version']:012d}.json")
    _, beside = _place(spark, f"{folder}/manifest/.{uuid.uuid4().hex}")
    out = store.create(beside, False)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    if store.exists(final) or not store.rename(beside, final):
        store.delete(beside, False)
        raise RuntimeError(f"another run has published version {new['version']} of {folder}")


# --- reading -------------------------------------------------------------------


def _rows(spark: SparkSession, folder: str, state: Manifest, name: str, buckets: list[str] | None = None) -> DataFrame:
    """Stored rows of a table, or of some of its buckets."""
    runs = state["tables"].get(name, {})
    paths = [f"{folder}/{name}/run={run}/bucket={b}" for b, run in runs.items() if buckets is None or b in buckets]
    if not paths:
        return spark.createDataFrame([], stored_schema(name))
    return spark.read.schema(stored_schema(name)).parquet(*paths)


def read_current(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame:
    """A table as the latest published run left it, or as that of a version did."""
    return _current(spark, folder, manifest(spark, folder, version), name)


def _current(spark: SparkSession, folder: str, state: Manifest, name: str) -> DataFrame:
    return _rows(spark, folder, state, name).select(*(part.split()[0] for part in TABLES[name].split(",")))


def read_view(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame:
    """A view as the latest published run left it, or as that of a version did; from counts that runs keep up."""
    state = manifest(spark, folder, version)
    return counts.view(name, lambda count: _rows(spark, folder, state, count), lambda table: _current(spark, folder, state, table))


# --- writing -------------------------------------------------------------------


def _new_rows(stage: DataFrame, hydrated: bool) -> dict[str, DataFrame]:
    """Rows of every table out of the staged frame, less exact repeats where only distinct ones count."""
    rows, rest = split_stage(stage)
    built: dict[str, Callable[[], DataFrame]] = {name: (lambda t=t: t(rows)) for name, t in (LATEST_TABLES | DISTINCT_TABLES).items()}
    built["deleted_tweets"] = lambda: deletions(rest)
    return {name: build() for name, build in built.items() if not (hydrated and name == "user_tweet_career")}


def parse_more(lines: DataFrame, folder: str, *, buckets: int = BUCKETS, hydrated: bool = False, extended: bool = False) -> int:
    """Fold the lines' rows into the tables of a store, and return the version published.

    The lines are decoded once.  Of each table only the buckets that get rows are read and written anew, so the
    cost follows the new lines as long as they touch few buckets, and never more than a bucket's rows
    meet.  The counts behind the views get what the rewritten buckets add and take away.  The result is that of one run over all lines, equal times included, in whatever parts they came;
    lines given twice change nothing.  ``buckets`` counts for a new store only.
    """
    spark, run = lines.sparkSession, uuid.uuid4().hex
    old = manifest(spark, folder)
    count = old["buckets"] or buckets
    new = {"version": old["version"] + 1, "buckets": count, "tables": {name: dict(runs) for name, runs in old["tables"].items()}}
    path = stage_path(spark, "sightings")
    everything = flatten.everything(lines, extended=extended)
    everything.write.partitionBy("part").parquet(path)
    try:
        stage = spark.read.schema(everything.schema).parquet(path)

        def fold(name: str, rows: DataFrame) -> None:
            bucket = F.pmod(F.xxhash64(key_of(name)), F.lit(count)).cast("int")
            fresh = rows.select(*(part.split()[0] for part in stored_schema(name).replace(", ", ",").split(",")))
            touched = [str(r[0]) for r in fresh.select(bucket).distinct().collect()]  # at most `count`
            if not touched:
                return
            both = folded(_rows(spark, folder, old, name, touched).unionByName(fresh), name)
            dealt = both.withColumn("bucket", bucket).hint("rebalance", "bucket")
            dealt.write.partitionBy("bucket").parquet(f"{folder}/{name}/run={run}")
            new["tables"].setdefault(name, {}).update(dict.fromkeys(touched, run))

        _side_by_side(fold, _new_rows(stage, hydrated))
        # A store without counts, as one from before there were any, gets them from all its rows.
        counted = old if old.get("counts") else {"tables": {}}
        _side_by_side(lambda name, _: _fold_counts(spark, folder, counted, new, name, run), COUNTS)
        new["counts"] = True
        publish(spark, folder, new)
    finally:
        remove(spark, path)
    return new["version"]


def _side_by_side(job: Callable, items: dict) -> None:
    with ThreadPoolExecutor(max_workers=PARALLEL_WRITES) as pool:
        for done in [pool.submit(job, name, item) for name, item in items.items()]:
            done.result()


def _fold_counts(spark: SparkSession, folder: str, old: Manifest, new: Manifest, name: str, run: str) -> None:
    """Add to a count what the buckets that differ between two manifests gain and lose."""
    differ = {b for t in counts.SOURCES[name] for b, r in new["tables"].get(t, {}).items() if old["tables"].get(t, {}).get(b) != r}
    if not differ:
        return
    path = stage_path(spark, name)
    change = counts.delta(name, *(lambda t, state=state: _rows(spark, folder, state, t, sorted(differ)) for state in (old, new)))
    change.write.parquet(path)
    try:
        change = spark.read.schema(COUNTS[name]).parquet(path)
        bucket = F.pmod(F.xxhash64(key_of(name)), F.lit(new["buckets"])).cast("int")
        touched = [str(r[0]) for r in change.select(bucket).distinct().collect()]  # at most the number of buckets
        if touched:
            total = counts.summed(name, _rows(spark, folder, old, name, touched), change)
            dealt = total.withColumn("bucket", bucket).hint("rebalance", "bucket")
            dealt.write.partitionBy("bucket").parquet(f"{folder}/{name}/run={run}")
            runs = new["tables"].setdefault(name, {})
            for b in touched:
                store, place = _place(spark, f"{folder}/{name}/run={run}/bucket={b}")
                if store.exists(place):
                    runs[b] = run
                else:  # all its counts came to nothing
                    runs.pop(b, None)
    finally:
        remove(spark, path)


def remove_unused(spark: SparkSession, folder: str, *, keep: int = 1) -> int:
    """Delete manifests but the last ``keep``, and the folders that those left do not name; returns how many folders.

    Not to be called while a run writes or a reader of an older version is at work.
    """
    found = _versions(spark, folder)
    kept = [manifest(spark, folder, v) for v in found[-keep:]]
    used = {(name, run, b) for state in kept for name, runs in state["tables"].items() for b, run in runs.items()}
    gone = 0
    for version in found[:-keep]:
        remove(spark, f"{folder}/manifest/{version:012d}.json")
    for name in [*TABLES, *COUNTS]:
        store, place = _place(spark, f"{folder}/{name}")
        if not store.exists(place):
            continue
        for run in store.listStatus(place):
            for bucket in store.listStatus(run.getPath()):
                own = bucket.getPath().getName()
                label = run.getPath().getName().removeprefix("run=")
                if own.startswith("bucket=") and (name, label, own.removeprefix("bucket=")) not in used:
                    store.delete(bucket.getPath(), True)
                    gone += 1
    return gone
