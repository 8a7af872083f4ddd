"""The five views over the tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivemill.operators import rollups
from archivemill.plans.staging import staged


VIEWS = ("view_retweet_graph", "view_user_stats", "view_author_hashtag", "view_author_hashtag_stats", "view_activity")


def view_order(name: str) -> list[Column] | None:
    """The order in which a view is written where order is asked for; the log has none.

    Ids of the graph and the statistics are in the order of texts, authors of hashtags in that of numbers.
    """
    number = F.col("author_id").cast("long") if name.startswith("view_author") else None
    return {
        "view_retweet_graph": lambda: [F.col("source"), F.col("target")],
        "view_user_stats": lambda: [F.col("author_id")],
        "view_author_hashtag": lambda: [number, F.col("hashtag")],
        "view_author_hashtag_stats": lambda: [number],
    }.get(name, lambda: None)()


def build_views(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The views, lazily but for the pair counts, which two views share and which are staged."""
    metadata, network = tables["tweet_metadata"], tables["network_retweet"]
    counts = staged(rollups.hashtag_counts(tables["entities_hashtag"], metadata), "hashtag-counts")
    return {
        "view_retweet_graph": rollups.retweet_graph(network),
        "view_user_stats": rollups.user_stats(metadata, network),
        "view_author_hashtag": rollups.named_counts(counts),
        "view_author_hashtag_stats": rollups.count_stats(counts),
        "view_activity": rollups.activity_log(metadata, tables.get("deleted_tweets")),
    }
