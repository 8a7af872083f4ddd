"""Mine archive files as they arrive, and fold newly parsed tables into stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivemill.operators.latest import distinct_rows, latest_by_key
from archivemill.operators.mining import as_json, mine_read
from archivemill.operators.tables import LATEST_TABLES
from archivemill.plans.ledger import mine_due
from archivemill.plans.staging import staged
from archivemill.schema import TABLES
from archivemill.sources.archive import stream_archive


def mine_new_files(
    spark: SparkSession, root: str, folder: str, ledger: str, *, files_per_batch: int = 10_000, most_tries: int = 3
) -> None:
    """Mine the files that came since the last call, then stop.

    ``plans.ledger`` knows what was mined.  A file that is not intact yet, say because it is still being uploaded,
    is tried ``most_tries`` times, and anew when it has been written to; the subfolder
    ``batch=report`` lists such files.  With a new ledger every file is mined, and nothing that was mined before is touched.
    """
    mine_due(spark, root, folder, ledger, files_per_batch=files_per_batch, most_tries=most_tries)


def stream_mining(spark: SparkSession, root: str, folder: str, checkpoint: str):
    """A started stream that mines the files appearing below a mounted folder, then stops.

    Written by Spark's file sink, which takes each batch once; read it with ``mined_lines``.  What is wrong with
    which file stands under ``kind=unusable``; such a file is read again when it is written anew.
    """
    rows = as_json(mine_read(stream_archive(spark, root)))
    return (
        rows.writeStream.format("text").partitionBy("kind", "date").option("path", folder)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def fold_table(stored: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """A stored table with newly parsed rows: the latest row of each key, or the distinct rows.

    Staged, so that it can be written over the folder ``stored`` was read from.
    """
    both = stored.unionByName(new.select(*stored.columns))
    if name not in LATEST_TABLES:
        return staged(distinct_rows(both), name)
    rest = [F.col(c).desc_nulls_last() for c in stored.columns if c not in ("id", "access")]
    return staged(latest_by_key(both, ["id"], [F.col("access").desc_nulls_last(), *rest]), name)


def fold_run(stored: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``fold_table`` for every table that either side has."""
    out = {}
    for name in TABLES:
        sides = [side[name] for side in (stored, new) if name in side]
        if sides:
            out[name] = fold_table(*sides, name) if len(sides) == 2 else sides[0]
    return out
