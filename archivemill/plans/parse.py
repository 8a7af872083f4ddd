"""Lines -> tables.  ``tables`` is lazy; ``run_parse`` writes a whole output folder."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivemill.operators import decode, flatten
from archivemill.operators.decode import POSITION
from archivemill.operators.latest import distinct_rows, latest_sighting
from archivemill.operators.tables import DISTINCT_TABLES, LATEST_TABLES, without_counts
from archivemill.plans.mine import mine_archive
from archivemill.plans.sinks import remove, write_in_order, write_notices, write_table
from archivemill.plans.staging import stage_path
from archivemill.plans.views import VIEWS, build_views, view_order
from archivemill.schema import TABLES, csv_schema
from archivemill.sources.archive import Paths, json_lines, mined_lines
from archivemill.sources.tables import read_table

PARALLEL_WRITES = 4


def sightings_of(lines: DataFrame, *, extended: bool = False) -> DataFrame:
    return flatten.sightings(flatten.levels(lines), extended=extended)


def table(sightings: DataFrame, name: str, *, timeline: bool = False) -> DataFrame:
    """One message table, de-duplicated."""
    if name in LATEST_TABLES:
        df = latest_sighting(LATEST_TABLES[name](sightings))
    else:
        df = distinct_rows(DISTINCT_TABLES[name](sightings))
    return without_counts(df) if timeline else df


def split_stage(stage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``everything`` -> the sightings, and the other lines as ``(position, part, value)``."""
    rows = stage.filter(F.col("part") == "message")
    rest = stage.filter(F.col("part") != "message").select(
        *POSITION, "part", F.col("text").alias("value")
    )
    return rows, rest


def deleted_tweets(lines: DataFrame) -> DataFrame:
    return distinct_rows(decode.deletions(lines))


def tables(
    lines: DataFrame,
    *,
    timeline: bool = False,
    hydrated: bool = False,
    extended: bool = False,
    sightings: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All tables of the lines, by name.

    ``timeline``: the source has no quote and reply counts.  ``hydrated``: the
    messages were fetched at one time, so there is no career to record.
    """
    rows = sightings if sightings is not None else sightings_of(lines, extended=extended)
    out = {}
    for name in TABLES:
        if name == "deleted_tweets":
            out[name] = deleted_tweets(lines)
        elif not (hydrated and name == "user_tweet_career"):
            out[name] = table(rows, name, timeline=timeline)
    return out


def run_parse(
    lines: DataFrame,
    folder: str,
    *,
    fmt: str = "parquet",
    timeline: bool | None = False,
    hydrated: bool = False,
    extended: bool = False,
    views: bool = True,
    skip_empty: bool = False,
    split: bool = False,
    ordered: bool = False,
) -> DataFrame:
    """Write every table, the notices, the rejects and the views below ``folder``.

    The lines are read and decoded once, into a staged columnar frame by part; every
    output then reads its own part and columns of that.  What an earlier run wrote to the
    folder and this one does not is removed, the views are built from this run's tables only, and
    the stage is dropped at the end.  ``split``: the lines are those of split files, blank ones included, and
    rejects get their numbers in the files.  ``ordered``: the views stand in the order of their keys.  ``timeline=None``
    finds out from all lines whether the source has quote and reply counts, which reads them once more.  Returns the counts per type, embedded and incomplete
    messages included.
    """
    spark = lines.sparkSession
    if timeline is None:
        timeline = decode.counts_probe(lines).first().timeline
    path = stage_path(spark, "sightings")
    flatten.everything(lines, extended=extended).write.partitionBy("part").parquet(path)
    schema = flatten.everything(lines, extended=extended).schema
    try:
        return _write_run(
            spark.read.schema(schema).parquet(path), folder, fmt=fmt, timeline=timeline, hydrated=hydrated,
            views=views, skip_empty=skip_empty, split=split, ordered=ordered,
        )
    finally:
        remove(spark, path)


def _write_run(
    stage: DataFrame, folder: str, *, fmt: str, timeline: bool, hydrated: bool, views: bool, skip_empty: bool, split: bool,
    ordered: bool,
) -> DataFrame:
    spark = stage.sparkSession
    rows, rest = split_stage(stage)
    built = tables(rest, timeline=timeline, hydrated=hydrated, sightings=rows)
    written: dict[str, bool] = {}

    def write(name: str, df: DataFrame) -> None:
        # The three latest-row tables are written even when empty.
        leave_out = skip_empty and name not in LATEST_TABLES
        written[name] = write_table(df, f"{folder}/{name}", fmt=fmt, skip_empty=leave_out)

    jobs = [partial(write, name, df) for name, df in built.items()]
    notices = rest.filter(F.col("part") == "status_withheld")
    jobs.append(partial(write_notices, notices, f"{folder}/become_withheld"))
    jobs.append(partial(write_table, flatten.rejects(stage, split=split), f"{folder}/rejects"))
    _run_all(jobs)
    for name in TABLES:
        if not written.get(name):
            remove(spark, f"{folder}/{name}")
    if views:
        stored = {
            name: read_table(spark, folder, name, fmt=fmt, timeline=timeline)
            if written.get(name)
            else spark.createDataFrame([], csv_schema(name, timeline=timeline))
            for name in ("tweet_metadata", "network_retweet", "entities_hashtag", "deleted_tweets")
        }
        views_built = build_views(stored)
        orders = {name: view_order(name) if ordered else None for name in views_built}
        _run_all([
            partial(write_in_order, df, f"{folder}/{n}", orders[n], fmt=fmt) if orders[n] else partial(write_table, df, f"{folder}/{n}", fmt=fmt)
            for n, df in views_built.items()
        ])
    else:
        for name in VIEWS:
            remove(spark, f"{folder}/{name}")
    messages = stage.filter(F.col("part").isin("message", "incomplete"))
    counts = flatten.type_stats(messages)
    return spark.createDataFrame(counts.collect(), counts.schema)  # one row for each type


def _run_all(jobs: list[Callable[[], object]]) -> None:
    """Submit independent writes side by side: the short ones fill the others' gaps."""
    with ThreadPoolExecutor(max_workers=PARALLEL_WRITES) as pool:
        for done in [pool.submit(job) for job in jobs]:
            done.result()


def parse_folder(spark, source: str, folder: str, **options) -> DataFrame:
    """``run_parse`` over a folder of JSON-lines files; rejects name the file and the line's number in it, from 0."""
    return run_parse(json_lines(spark, source, blanks=True), folder, split=True, **options)


def parse_mined(spark: SparkSession, mined: str, folder: str, **options) -> DataFrame:
    """``run_parse`` over what a mining run wrote."""
    return run_parse(mined_lines(spark, mined), folder, **options)


def mine_and_parse(spark: SparkSession, root: Paths, mined: str, folder: str, **options) -> DataFrame:
    """Mine an archive, then parse all that is mined below ``mined``."""
    mine_archive(spark, root, mined)
    return parse_mined(spark, mined, folder, **options)
