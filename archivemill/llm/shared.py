"""What several operators of this package use: session settings, stored stages,
and gapless numbering that no hot group can send to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archivemill.plans.staging import stage_path, staged
from archivemill.session import configure

__all__ = ["gapless", "prepared", "stage_path", "staged", "text_or_empty", "word_count"]

#: Words of the corpus: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch.  Rows hold whole texts, so the default of 10,000 is too many.
BATCH_ROWS = "500"

#: Pieces that a group is numbered in; each is one window group of one task.
PIECES = 1024


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings and the code on executors that the operators rely on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")


def gapless(rows: DataFrame, group: str, order: list[str], out: str, pieces: int = PIECES) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in column ``out``.

    ``rows`` should be narrow.  Equal rows are folded into one with a count before
    anything shuffles by key, and a group is cut into ``pieces`` by the hash of its
    order columns, so neither a hot group nor a hot key meets in one task.  Numbers
    follow (piece, ``order``, the remaining columns); they depend on the rows alone.

    The number of groups must be bounded (shards, buckets): groups x pieces
    counters are broadcast.  Nulls group and order like a value of their own.
    """
    names = rows.columns
    folded = staged(
        rows.groupBy(*names)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_piece", F.pmod(F.xxhash64(*names), F.lit(pieces)).cast("int")),
        "numbering",
    )
    before = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        folded.groupBy(group, "_piece")
        .agg(F.sum("_n").alias("_size"))
        .select(
            F.col(group).alias("_group"),
            F.col("_piece").alias("_p"),
            F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
        )
    )
    rest = [c for c in names if c not in (group, *order)]
    inside = (
        Window.partitionBy(group, "_piece").orderBy(*order, *rest).rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = folded.withColumn("_first", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    joined = numbered.join(
        F.broadcast(starts),  # groups x pieces rows, whatever the input
        numbered[group].eqNullSafe(starts["_group"]) & (numbered["_piece"] == starts["_p"]),
    )
    first = F.col("_start") + F.col("_first")
    return joined.select(*names, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias(out))
