"""The counts behind the views, kept up by signed deltas.

A run replaces rows of the tables, as a later sighting replaces an earlier one.  What a changed bucket
counts for now, less what it counted for before, is added to the stored counts; a count that comes to
nothing goes.  So the views follow the changed rows and are never counted from scratch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivemill.operators import rollups

#: Stored counts: their columns, the keys first.
COUNTS: dict[str, str] = {
    "retweet_counts": "author_id bigint, original_author_id bigint, weight bigint",
    "user_counts": "author_id bigint, tw_num bigint, do_rt_num bigint, get_rt_num bigint",
    "hashtag_counts": "author_id bigint, hashtag string, count bigint",
}
KEYS = {"retweet_counts": 2, "user_counts": 1, "hashtag_counts": 2}

#: By count: the rows that add to it, from what reads a table.
MARKS: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]] = {
    "retweet_counts": lambda read: rollups.edge_marks(read("network_retweet")),
    "user_counts": lambda read: rollups.user_marks(read("tweet_metadata"), read("network_retweet")),
    "hashtag_counts": lambda read: rollups.hashtag_marks(read("entities_hashtag"), read("tweet_metadata")),
}
#: The tables a count is made from.
SOURCES = {
    "retweet_counts": ["network_retweet"], "user_counts": ["tweet_metadata", "network_retweet"],
    "hashtag_counts": ["entities_hashtag", "tweet_metadata"],
}


def _columns(name: str) -> tuple[list[str], list[str]]:
    fields = [part.split()[0] for part in COUNTS[name].split(",")]
    return fields[: KEYS[name]], fields[KEYS[name] :]


def summed(name: str, *parts: DataFrame) -> DataFrame:
    """Signed counts added up; what comes to nothing goes."""
    keys, sums = _columns(name)
    total = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
    return total.where(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in sums]))


def delta(name: str, before: Callable[[str], DataFrame], after: Callable[[str], DataFrame]) -> DataFrame:
    """What a count gains and loses between two states of the rows that changed."""
    keys, sums = _columns(name)
    gone = MARKS[name](before).select(*keys, *((-F.col(c)).alias(c) for c in sums))
    return summed(name, MARKS[name](after), gone)


def view(name: str, count: Callable[[str], DataFrame], table: Callable[[str], DataFrame]) -> DataFrame:
    """A view out of the stored counts; the log is a union of two tables."""
    if name == "view_retweet_graph":
        return rollups.named_edges(count("retweet_counts"))
    if name == "view_user_stats":
        return rollups.named_users(count("user_counts"))
    if name == "view_author_hashtag":
        return rollups.named_counts(count("hashtag_counts"))
    if name == "view_author_hashtag_stats":
        return rollups.count_stats(count("hashtag_counts"))
    if name == "view_activity":
        return rollups.activity_log(table("tweet_metadata"), table("deleted_tweets"))
    raise ValueError(f"no view {name}")
