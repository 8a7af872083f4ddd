"""Edges, per-author statistics and the activity log.

Every grouping combines map-side before its shuffle, so a heavy author or a
heavy edge costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_weights(df: DataFrame, source: str, target: str) -> DataFrame:
    """Directed weighted graph: rows per (source, target); rows lacking an end do not count."""
    return (
        df.filter(F.col(source).isNotNull() & F.col(target).isNotNull())
        .groupBy(F.col(source).alias("source"), F.col(target).alias("target"))
        .agg(F.count("*").alias("weight"))
    )


def counts_outer(frames: Mapping[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """Rows per key in each frame, 0 where a key is missing from one.

    Same result as full outer joins of the single counts, in one shuffle.
    ``frames`` maps the count's name to ``(frame, key column)``.
    """
    tagged = None
    for name, (df, column) in frames.items():
        marks = [F.lit(1 if other == name else 0).cast("long").alias(other) for other in frames]
        part = df.filter(F.col(column).isNotNull()).select(F.col(column).alias(key), *marks)
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy(key).agg(*(F.sum(name).alias(name) for name in frames))


def retweet_graph(network_retweet: DataFrame) -> DataFrame:
    edges = edge_weights(network_retweet, "author_id", "original_author_id")
    return edges.select(_text("source"), _text("target"), "weight")


def edge_marks(network_retweet: DataFrame) -> DataFrame:
    """One row, of weight 1, for each retweet with both ends."""
    ends = network_retweet.select("author_id", "original_author_id", F.lit(1).cast("long").alias("weight"))
    return ends.filter(F.col("author_id").isNotNull() & F.col("original_author_id").isNotNull())


def named_edges(counts: DataFrame) -> DataFrame:
    return counts.select(_text("author_id").alias("source"), _text("original_author_id").alias("target"), "weight")


def user_stats(metadata: DataFrame, network_retweet: DataFrame) -> DataFrame:
    """Messages written, retweets made and retweets received per author."""
    marks = user_marks(metadata, network_retweet)
    return named_users(marks.groupBy("author_id").agg(*(F.sum(c).alias(c) for c in ("tw_num", "do_rt_num", "get_rt_num"))))


def named_users(counts: DataFrame) -> DataFrame:
    return counts.select(_text("author_id"), "tw_num", "do_rt_num", "get_rt_num")


def user_marks(metadata: DataFrame, network_retweet: DataFrame) -> DataFrame:
    """One row for each message and each end of a retweet, with a 1 in its column."""
    # Both ends of an edge come from one pass over the network.
    end = F.inline(
        F.array(
            F.struct(F.col("author_id").alias("who"), F.lit(True).alias("made")),
            F.struct(F.col("original_author_id").alias("who"), F.lit(False).alias("made")),
        )
    )
    ends = network_retweet.select(end.alias("author_id", "made"))

    def marks(tw: Column, made: Column, got: Column) -> list[Column]:
        return [
            tw.cast("long").alias("tw_num"),
            made.cast("long").alias("do_rt_num"),
            got.cast("long").alias("get_rt_num"),
        ]

    posts = metadata.select("author_id", *marks(F.lit(1), F.lit(0), F.lit(0)))
    links = ends.select("author_id", *marks(F.lit(0), F.col("made"), ~F.col("made")))
    return posts.unionByName(links).filter(F.col("author_id").isNotNull())


def hashtag_marks(hashtags: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row, of count 1, for each use of a hashtag by a known author."""
    uses = hashtags.join(metadata.select("id", "author_id"), "id").filter(F.col("author_id").isNotNull())
    return uses.select("author_id", "hashtag", F.lit(1).cast("long").alias("count"))


def hashtag_counts(hashtags: DataFrame, metadata: DataFrame) -> DataFrame:
    """Uses per (author, hashtag), a missing hashtag included: what both hashtag views are built from."""
    return hashtag_marks(hashtags, metadata).groupBy("author_id", "hashtag").agg(F.sum("count").alias("count"))


def author_hashtag(hashtags: DataFrame, metadata: DataFrame) -> DataFrame:
    return named_counts(hashtag_counts(hashtags, metadata))


def named_counts(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("hashtag").isNotNull()).select(_text("author_id"), "hashtag", "count")


def author_hashtag_stats(hashtags: DataFrame, metadata: DataFrame) -> DataFrame:
    return count_stats(hashtag_counts(hashtags, metadata))


def count_stats(counts: DataFrame) -> DataFrame:
    """Uses and different hashtags per author, rolled up from the pair counts.

    A missing hashtag counts as a use, but an author needs one that is not missing.
    """
    return (
        counts.groupBy("author_id")
        .agg(
            F.sum("count").alias("total_hashtags"),
            F.count("*").alias("different_hashtags"),
            F.count("hashtag").alias("_named"),
        )
        .filter("_named > 0")
        .select(_text("author_id"), "total_hashtags", "different_hashtags")
    )


def activity_log(metadata: DataFrame, deletions: DataFrame | None) -> DataFrame:
    """Posts and deletions in one log; replies and quotes count as tweets."""
    kind = F.when(F.col("tweet_type").isin("reply", "quote"), "tweet").otherwise(F.col("tweet_type"))
    posts = metadata.select(_text("id"), _text("author_id"), "created_at", kind.alias("tweet_type"))
    if deletions is None:
        return posts
    removed = deletions.select(
        _text("id"),
        _text("author_id"),
        F.col("deletion_time").alias("created_at"),
        F.lit("deletion").alias("tweet_type"),
    )
    return posts.unionByName(removed)


def _text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)
