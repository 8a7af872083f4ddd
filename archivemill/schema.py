"""Field lists and types of the sixteen tables."""

from __future__ import annotations

_USER_COUNTS = "followers_count bigint, friends_count bigint"
_EDGE = (
    "id bigint, original_tweet_id bigint, {date} timestamp, author_id bigint, "
    "original_author_id bigint, screen_name string, original_screen_name string"
)

TABLES: dict[str, str] = {
    "tweet_metadata": "id bigint, author_id bigint, created_at timestamp, lang string, "
    "tweet_type string, source string, source_link string, retweet_count bigint, "
    "favorite_count bigint, quote_count bigint, reply_count bigint, linked_tweet bigint, "
    "linked_user bigint, sensitive boolean, access timestamp",
    "tweet_text": "id bigint, lang string, text string",
    "entities_hashtag": "id bigint, hashtag string",
    "entities_mention": "id bigint, mentioned_id bigint, mentioned_screen_name string",
    "entities_url": "id bigint, url string, host string",
    "entities_media": "id bigint, media_id bigint, type string, url string",
    "twitter_user": "id bigint, created_at timestamp, lang string, name string, "
    f"screen_name string, location string, description string, url string, {_USER_COUNTS}, "
    "favourites_count bigint, listed_count bigint, statuses_count bigint, protected boolean, "
    "verified boolean, default_profile boolean, default_profile_image boolean, access timestamp",
    "user_timezone": "author_id bigint, tweet_id bigint, time_zone string, utc_offset int, "
    "access timestamp",
    "user_profile": "id bigint, profile_background_image_url string, profile_image_url string, "
    "profile_banner_url string, access timestamp",
    "user_tweet_career": "author_id bigint, tweet_id bigint, retweet_count bigint, "
    f"favourite_count bigint, reply_count bigint, quote_count bigint, {_USER_COUNTS}, "
    "statuses_count bigint, access timestamp, screen_name string, name string, "
    "description string, profile_image_url string, user_lang string, location string, url string",
    "network_retweet": _EDGE.format(date="retweeted_date"),
    "network_reply": _EDGE.format(date="replied_date"),
    "network_quote": _EDGE.format(date="quoted_date"),
    "geotagged_tweets": "id bigint, country_code string, name string, place_type string",
    "deleted_tweets": "id bigint, author_id bigint, timestamp_ms bigint, deletion_time timestamp",
    "withheld_tweets": "id bigint, country string",
}

TIMELINE_ABSENT = ("quote_count", "reply_count")


def columns(name: str, *, timeline: bool = False) -> list[str]:
    fields = [part.split()[0] for part in TABLES[name].split(",")]
    return [f for f in fields if not (timeline and f in TIMELINE_ABSENT)]


def csv_schema(name: str, *, timeline: bool = False) -> str:
    keep = set(columns(name, timeline=timeline))
    return ", ".join(p.strip() for p in TABLES[name].split(",") if p.split()[0] in keep)
