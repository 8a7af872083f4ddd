"""The sixteen tables as projections of the sightings frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivemill.functions.scalars import (
    clean_newlines,
    clean_or_empty,
    client_label,
    client_link,
    url_host,
)
from archivemill.operators.decode import POSITION

# Order keys of a sighting; kept on the tables that hold the latest row per id.
SIGHTING_ORDER = [*POSITION, "depth"]

TIMELINE_ABSENT = ["quote_count", "reply_count"]


def _by_type(retweet: str, quote: str, reply: str) -> Column:
    kind = F.col("tweet_type")
    return (
        F.when(kind == "retweet", F.col(retweet))
        .when(kind == "quote", F.col(quote))
        .when(kind == "reply", F.col(reply))
    )


def linked_tweet() -> Column:
    return _by_type("rt_tweet", "qt_tweet", "reply_tweet")


def linked_user() -> Column:
    return _by_type("rt_user", "qt_user", "reply_user")


def _own_content(s: DataFrame) -> DataFrame:
    return s.filter(F.col("tweet_type") != "retweet")


def tweet_metadata(s: DataFrame) -> DataFrame:
    return s.select(
        "id",
        "author_id",
        "created_at",
        "lang",
        "tweet_type",
        client_label(F.col("source_anchor")).alias("source"),
        client_link(F.col("source_anchor")).alias("source_link"),
        F.col("retweets").alias("retweet_count"),
        F.col("favorites").alias("favorite_count"),
        "quote_count",
        "reply_count",
        linked_tweet().alias("linked_tweet"),
        linked_user().alias("linked_user"),
        "sensitive",
        "access",
        *SIGHTING_ORDER,
    )


def tweet_text(s: DataFrame) -> DataFrame:
    text = F.coalesce("extended_text", "plain_text", "full_text")
    return _own_content(s).select("id", "lang", clean_newlines(text).alias("text"))


def entities_hashtag(s: DataFrame) -> DataFrame:
    return _own_content(s).select("id", F.inline("hashtags").alias("hashtag"))


def entities_mention(s: DataFrame) -> DataFrame:
    mentions = _own_content(s).select("id", F.inline("mentions").alias("mid", "mentioned_screen_name"))
    return mentions.select(
        "id", F.col("mid").try_cast("bigint").alias("mentioned_id"), "mentioned_screen_name"
    )


def entities_url(s: DataFrame) -> DataFrame:
    urls = _own_content(s).select("id", F.inline("urls").alias("url"))
    return urls.select("id", "url", url_host(F.col("url")).alias("host"))


def entities_media(s: DataFrame) -> DataFrame:
    media = F.when(F.size("extended_media") > 0, F.col("extended_media")).otherwise(
        F.col("plain_media")
    )
    items = _own_content(s).select("id", F.inline(media).alias("mid", "type", "url"))
    return items.select("id", F.col("mid").try_cast("bigint").alias("media_id"), "type", "url")


def twitter_user(s: DataFrame) -> DataFrame:
    return s.select(
        F.col("author_id").alias("id"),
        F.col("user_created_at").alias("created_at"),
        F.col("user_lang").alias("lang"),
        clean_or_empty(F.col("user_name")).alias("name"),
        "screen_name",
        clean_or_empty(F.col("user_location")).alias("location"),
        clean_or_empty(F.col("user_description")).alias("description"),
        F.col("user_url").alias("url"),
        "followers_count",
        "friends_count",
        "favourites_count",
        "listed_count",
        "statuses_count",
        "protected",
        "verified",
        "default_profile",
        "default_profile_image",
        "access",
        *SIGHTING_ORDER,
    )


def user_timezone(s: DataFrame) -> DataFrame:
    known = F.col("time_zone").isNotNull() | F.col("utc_offset").isNotNull()
    return s.filter(known).select(
        F.coalesce("author_id_str", "author_id").alias("author_id"),
        F.col("id").alias("tweet_id"),
        "time_zone",
        F.col("utc_offset").cast("int").alias("utc_offset"),
        "access",
    )


def user_profile(s: DataFrame) -> DataFrame:
    return s.select(
        F.coalesce("author_id_str", "author_id").alias("id"),
        F.col("background_image").alias("profile_background_image_url"),
        F.col("profile_image_https").alias("profile_image_url"),
        F.col("banner").alias("profile_banner_url"),
        "access",
        *SIGHTING_ORDER,
    )


def user_tweet_career(s: DataFrame) -> DataFrame:
    return s.select(
        "author_id",
        F.col("id").alias("tweet_id"),
        F.col("retweets").alias("retweet_count"),
        F.col("favorites").alias("favourite_count"),
        "reply_count",
        "quote_count",
        "followers_count",
        "friends_count",
        "statuses_count",
        "access",
        "screen_name",
        clean_or_empty(F.col("user_name")).alias("name"),
        clean_or_empty(F.col("user_description")).alias("description"),
        F.col("profile_image").alias("profile_image_url"),
        "user_lang",
        clean_or_empty(F.col("user_location")).alias("location"),
        clean_or_empty(F.col("user_url")).alias("url"),
    )


def _edges(kind: str, date: str, tweet: str, user: str, name: str):
    def table(s: DataFrame) -> DataFrame:
        return s.filter(F.col("tweet_type") == kind).select(
            "id",
            F.col(tweet).alias("original_tweet_id"),
            F.col("created_at").alias(date),
            "author_id",
            F.col(user).alias("original_author_id"),
            "screen_name",
            F.col(name).alias("original_screen_name"),
        )

    return table


network_retweet = _edges("retweet", "retweeted_date", "rt_tweet", "rt_user", "rt_name")
network_quote = _edges("quote", "quoted_date", "qt_tweet", "qt_user", "qt_name")
network_reply = _edges("reply", "replied_date", "reply_tweet", "reply_user", "reply_name")


def geotagged_tweets(s: DataFrame) -> DataFrame:
    return s.filter(F.col("place").isNotNull()).select("id", "place.*")


def withheld_tweets(s: DataFrame) -> DataFrame:
    return s.select("id", F.explode("withheld").alias("country"))


# Tables that keep the latest row per id; the others keep distinct rows.
LATEST_TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "tweet_metadata": tweet_metadata,
    "twitter_user": twitter_user,
    "user_profile": user_profile,
}

DISTINCT_TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "tweet_text": tweet_text,
    "entities_hashtag": entities_hashtag,
    "entities_mention": entities_mention,
    "entities_url": entities_url,
    "entities_media": entities_media,
    "user_timezone": user_timezone,
    "user_tweet_career": user_tweet_career,
    "network_retweet": network_retweet,
    "network_quote": network_quote,
    "network_reply": network_reply,
    "geotagged_tweets": geotagged_tweets,
    "withheld_tweets": withheld_tweets,
}


def without_counts(df: DataFrame) -> DataFrame:
    """Timeline mode: the source has no quote and reply counts."""
    return df.drop(*TIMELINE_ABSENT)
