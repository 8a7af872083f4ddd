"""Membership flags and their propagation to authors.

The key sets are joined without a broadcast hint: Catalyst broadcasts one whose
known size is small, AQE decides again at run time, and a hot key on the large
side is split by AQE's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_KEY_SPREAD = 1024


def existence_flag(
    df: DataFrame, keys: DataFrame, column: str, flag: str, *, null_as: bool | None = False
) -> DataFrame:
    """Add ``flag``: is ``column`` among the first column of ``keys``?

    A NULL in ``column`` gives ``null_as``.  Such rows join on spread negative
    keys, so that they do not all meet in one task; a match there is ignored.
    """
    key_type = df.schema[column].dataType
    members = (
        keys.select(F.col(keys.columns[0]).cast(key_type).alias("_key"))
        .filter(F.col("_key").isNotNull())
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    spread = (-1 - F.pmod(F.xxhash64(*_hashable(df)), F.lit(NULL_KEY_SPREAD))).cast(key_type)
    keyed = df.withColumn("_key", F.coalesce(F.col(column), spread))
    value = F.when(F.col(column).isNull(), F.lit(null_as).cast("boolean")).otherwise(
        F.col("_hit").isNotNull()
    )
    return keyed.join(members, "_key", "left").withColumn(flag, value).drop("_key", "_hit")


def _hashable(df: DataFrame) -> list[Column]:
    simple = ("bigint", "int", "string", "timestamp", "timestamp_ntz", "date")
    return [F.col(name) for name, dtype in df.dtypes if dtype in simple]


def linked_flag(metadata: DataFrame, withheld: DataFrame) -> DataFrame:
    """``linked_withheld``: NULL without a linked message, else is that one withheld."""
    return existence_flag(metadata, withheld, "linked_tweet", "linked_withheld", null_as=None)


def withheld_owners(metadata: DataFrame, withheld: DataFrame) -> DataFrame:
    """Authors with a withheld message whose linked message is not withheld.

    The message itself must then be the reason, hence its author.  Only the rows
    of withheld ids get past the first join.
    """
    keys = withheld.select(F.col(withheld.columns[0]).cast("bigint").alias("_key")).distinct()
    own = metadata.filter(F.col("linked_tweet").isNotNull()).select("id", "linked_tweet", "author_id")
    return (
        own.join(keys, F.col("id") == F.col("_key"), "left_semi")
        .join(keys, F.col("linked_tweet") == F.col("_key"), "left_anti")
        .select("author_id")
        .distinct()
    )


def flag_propagation(metadata: DataFrame, withheld: DataFrame) -> DataFrame:
    """Metadata with ``withheld``, ``linked_withheld`` and ``user_withheld``.

    The flags are found on the three ids they depend on; the wide rows move once.
    """
    ids = ["id", "linked_tweet", "author_id"]
    flagged = existence_flag(metadata.select(*ids).distinct(), withheld, "id", "withheld")
    flagged = linked_flag(flagged, withheld)
    flagged = existence_flag(flagged, withheld_owners(metadata, withheld), "author_id", "user_withheld")
    keys = flagged.select(*(F.col(c).alias(f"_{c}") for c in ids), "withheld", "linked_withheld", "user_withheld")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ids]
    return metadata.join(keys, same).select(*metadata.columns, "withheld", "linked_withheld", "user_withheld")


def withheld_authors(metadata: DataFrame, withheld: DataFrame) -> DataFrame:
    """Authors with at least one withheld message."""
    keys = withheld.select(F.col(withheld.columns[0]).cast("bigint").alias("id"))
    return metadata.join(keys, "id", "left_semi").select("author_id").distinct()


def propagate_flag(df: DataFrame, owner: str, cond: Column, flag: str) -> DataFrame:
    """Every row of an owner with at least one row under ``cond`` is flagged."""
    owners = df.filter(cond).select(owner).distinct()
    return existence_flag(df, owners, owner, flag)
