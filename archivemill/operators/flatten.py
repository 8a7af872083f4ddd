"""Unnest messages: one row per message, embedded ones included.

``sightings`` is the wide typed frame every table projects from.  A row is one
sighting of a message; ``access`` is when the outer message was created.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivemill.functions.scalars import created_at_to_timestamp
from archivemill.functions.variants import scalar, with_default
from archivemill.operators.decode import POSITION, ROUTE_FIELDS, decode, line_numbers, reject_reason, route

# Levels decoded with the line, as real messages nest: the message, what it repeats or
# quotes, and what that one quotes.  Anything else stays raw and takes the loop in `_chain`.
PLAIN_LEVELS = 3

_MEDIA = "media: array<struct<id_str: string, type: string, media_url_https: string>>"
_ENTITIES = (
    "struct<hashtags: array<struct<text: string>>, urls: array<struct<expanded_url: string>>, "
    f"user_mentions: array<struct<id_str: string, screen_name: string>>, {_MEDIA}>"
)
_USER = (
    "struct<id: bigint, id_str: string, created_at: string, lang: string, name: string, "
    "screen_name: string, location: string, description: string, url: string, "
    "followers_count: bigint, friends_count: bigint, favourites_count: bigint, "
    "listed_count: bigint, statuses_count: bigint, protected: boolean, verified: boolean, "
    "default_profile: boolean, default_profile_image: boolean, "
    "profile_background_image_url_https: string, profile_image_url_https: string, "
    "profile_image_url: string, profile_banner_url: variant, time_zone: string, utc_offset: bigint>"
)
# Fields of one message; VARIANT where an absent key differs from a JSON null.
MESSAGE = {
    "id": "bigint",
    "created_at": "string",
    "text": "variant",
    "full_text": "variant",
    "lang": "variant",
    "source": "string",
    "retweet_count": "variant",
    "favorite_count": "variant",
    "reply_count": "bigint",
    "quote_count": "bigint",
    "in_reply_to_status_id": "bigint",
    "in_reply_to_user_id": "bigint",
    "in_reply_to_screen_name": "string",
    "possibly_sensitive": "variant",
    "place": "struct<country_code: string, name: string, place_type: string>",
    "withheld_in_countries": "array<string>",
    "entities": _ENTITIES,
    "extended_entities": f"struct<{_MEDIA}>",
    "extended_text": "variant",
    "extended_tweet": f"struct<full_text: string, entities: {_ENTITIES}, "
    f"extended_entities: struct<{_MEDIA}>>",
    "user": _USER,
}
EMBEDDING = ["retweeted_status", "quoted_status"]


def _fields(level: int, message: dict[str, str]) -> str:
    """DDL of a message at ``level`` with what is decoded below it."""
    own = [f"{name}: {dtype}" for name, dtype in message.items()]
    typed = EMBEDDING[:] if level == 0 else EMBEDDING[1:] if level + 1 < PLAIN_LEVELS else []
    for key in EMBEDDING:
        own.append(f"{key}: struct<{_fields(level + 1, message)}>" if key in typed else f"{key}: variant")
    return ", ".join(own)


# Expressions over all fields are put together as SQL text: one call, not hundreds.


def _chain(v: str) -> str:
    """Array of the raw message ``v`` and everything below it, of any depth.

    The embedding keys in its JSON bound the loop; it stops growing at the last message.
    """
    last = "element_at(acc, -1)"
    below = _first_non_null(*(f"try_variant_get({last}, '$.{key}', 'variant')" for key in EMBEDDING))
    return f"""aggregate(sequence(1, size(split(to_json({v}), '(retweet|quot)ed_status"'))), array({v}),
        (acc, i) -> CASE WHEN size(acc) < i THEN acc WHEN {below} IS NULL THEN acc ELSE array_append(acc, {below}) END)"""


def _first_non_null(*raw: str) -> str:
    """The first variant that is there and not JSON null, in a CASE that is NULL without one."""
    return "CASE " + " ".join(f"WHEN {_there(v)} THEN {v}" for v in raw) + " END"


def _there(raw: str) -> str:
    return f"({raw} IS NOT NULL AND NOT is_variant_null({raw}))"


def _row(m: str, raw: list[str], message: dict[str, str]) -> str:
    """One message as a struct of its own fields and the ids of what it embeds.

    ``raw``: the embedding keys that hold a VARIANT.
    """

    def link(key: str) -> str:
        below = f"{m}.{key}"
        if key in raw:
            parts = [
                f"try_variant_get({below}, '$.id', 'bigint')",
                f"try_variant_get({below}, '$.user.id', 'bigint')",
                f"try_variant_get({below}, '$.user.screen_name', 'string')",
            ]
            there = _there(below)
        else:
            parts = [f"{below}.id", f"{below}.user.id", f"{below}.user.screen_name"]
            there = f"{below} IS NOT NULL"
        if "user" not in message:  # only whether there is one
            return f"CASE WHEN {there} THEN true END"
        tweet, user, name = parts
        return f"""CASE WHEN {there}
            THEN named_struct('tweet', {tweet}, 'user', {user}, 'name', {name}) END"""

    own = ", ".join(f"'{name}', {m}.{name}" for name in message)
    links = f"'rt', {link('retweeted_status')}, 'qt', {link('quoted_status')}"
    return f"CASE WHEN {m} IS NOT NULL THEN named_struct({own}, {links}) END"


def message_type(m: str) -> Column:
    """retweet before quote before reply: a reply that quotes is a quote.

    A JSON null under an embedding key counts as absent.
    """
    return (
        F.when(F.col(f"{m}.rt").isNotNull(), "retweet")
        .when(F.col(f"{m}.qt").isNotNull(), "quote")
        .when(F.col(f"{m}.in_reply_to_status_id").isNotNull(), "reply")
        .otherwise("tweet")
    )


def levels(lines: DataFrame, *, others: bool = False, fields: list[str] | None = None) -> DataFrame:
    """Archive lines -> ``(file, block, line, depth, access, tweet_type, m)``.

    With ``others`` the lines that are no messages stay too, as one row with
    their ``route`` and text, so that one pass can feed every output.  ``fields`` are the
    wanted fields of a message (default: all); without ``user`` among them ``m`` says only
    whether a message embeds another.
    """
    message = {name: MESSAGE[name] for name in fields} if fields is not None else MESSAGE
    needed = {"created_at": MESSAGE["created_at"], "in_reply_to_status_id": MESSAGE["in_reply_to_status_id"], **message}
    message = needed if fields is not None else MESSAGE
    extra = ["route", "other"] if others else []
    notices = ", ".join(f for f in ROUTE_FIELDS.split(", ") if f.split()[0] not in message)
    is_message = F.col("route") == "message"
    df = (
        decode(lines, f"{notices}, {_fields(0, message)}")
        .withColumn("route", route("v"))
        .select(
            *POSITION,
            F.col("v.created_at").alias("seen"),
            "route",
            F.when(~is_message, F.col("value")).alias("other"),
            F.when(is_message, F.col("v")).alias("l0"),
        )
    )
    # The embedded message: what it repeats, else what it quotes.
    repeated, quoted = EMBEDDING
    rest = f"CASE WHEN {_there(f'l1.{repeated}')} THEN l1.{repeated} WHEN {_there(f'l2.{repeated}')} THEN l2.{repeated} WHEN {_there(f'l2.{quoted}')} THEN l2.{quoted} END"
    df = df.withColumn("l1", F.coalesce(*(F.col(f"l0.{key}") for key in EMBEDDING)))
    df = df.withColumn("l2", F.expr(f"CASE WHEN NOT {_there(f'l1.{repeated}')} THEN l1.{quoted} END"))
    df = df.withColumn("rest", F.expr(rest))

    raw = [[], [repeated], EMBEDDING]
    rows = [_row(f"l{depth}", raw[depth], message) for depth in range(PLAIN_LEVELS)]
    last_level = f"struct<{_fields(PLAIN_LEVELS - 1, message)}>"
    records = f"transform({_chain('rest')}, x -> from_json(to_json(x), '{last_level}'))"
    unnested = F.expr(
        f"""CASE WHEN rest IS NULL THEN array({', '.join(rows)})
        ELSE concat(filter(array({', '.join(rows)}), m -> m IS NOT NULL), transform({records}, r -> {_row('r', EMBEDDING, message)})) END"""
    )
    df = df.select(*POSITION, "seen", *extra, F.posexplode(unnested).alias("depth", "m"))
    kept = F.col("m").isNotNull()
    if others:
        kept = kept | ((F.col("depth") == 0) & (F.col("route") != "message"))
    return df.filter(kept).select(
        *POSITION,
        "depth",
        created_at_to_timestamp(F.col("seen")).alias("access"),
        message_type("m").alias("tweet_type"),
        *extra,
        "m",
    )


# Columns of the sightings frame that are plain fields of the message.
_PLAIN = {
    "id": "id",
    "source_anchor": "source",
    "reply_count": "reply_count",
    "quote_count": "quote_count",
    "reply_tweet": "in_reply_to_status_id",
    "reply_user": "in_reply_to_user_id",
    "reply_name": "in_reply_to_screen_name",
    "rt_tweet": "rt.tweet",
    "rt_user": "rt.user",
    "rt_name": "rt.name",
    "qt_tweet": "qt.tweet",
    "qt_user": "qt.user",
    "qt_name": "qt.name",
    "place": "place",
    "withheld": "withheld_in_countries",
    "extended_text": "extended_tweet.full_text",
    "author_id": "user.id",
    "user_lang": "user.lang",
    "user_name": "user.name",
    "screen_name": "user.screen_name",
    "user_location": "user.location",
    "user_description": "user.description",
    "user_url": "user.url",
    "followers_count": "user.followers_count",
    "friends_count": "user.friends_count",
    "favourites_count": "user.favourites_count",
    "listed_count": "user.listed_count",
    "statuses_count": "user.statuses_count",
    "protected": "user.protected",
    "verified": "user.verified",
    "default_profile": "user.default_profile",
    "default_profile_image": "user.default_profile_image",
    "background_image": "user.profile_background_image_url_https",
    "profile_image_https": "user.profile_image_url_https",
    "profile_image": "user.profile_image_url",
    "time_zone": "user.time_zone",
    "utc_offset": "user.utc_offset",
}


def _typed(flat: DataFrame, extended: bool) -> DataFrame:
    """Every field as a typed column, defaults applied."""
    use_extended = F.col("m.extended_text").isNotNull()
    if extended:
        use_extended = use_extended | F.col("m.extended_tweet.entities").isNotNull()

    def entity(path: str, name: str) -> Column:
        extended_form = F.col(f"m.extended_tweet.{path}")
        return F.when(use_extended, extended_form).otherwise(F.col(f"m.{path}")).alias(name)

    derived = [
        created_at_to_timestamp(F.col("m.created_at")).alias("created_at"),
        scalar("m.text", "string").alias("plain_text"),
        scalar("m.full_text", "string").alias("full_text"),
        with_default("m.lang", "string", "unknown").alias("lang"),
        with_default("m.retweet_count", "bigint", -1).alias("retweets"),
        with_default("m.favorite_count", "bigint", -1).alias("favorites"),
        with_default("m.possibly_sensitive", "boolean", False).alias("sensitive"),
        with_default("m.user.profile_banner_url", "string", "").alias("banner"),
        created_at_to_timestamp(F.col("m.user.created_at")).alias("user_created_at"),
        F.col("m.user.id_str").try_cast("bigint").alias("author_id_str"),
        entity("entities.hashtags", "hashtags"),
        entity("entities.urls", "urls"),
        entity("entities.user_mentions", "mentions"),
        entity("entities.media", "plain_media"),
        entity("extended_entities.media", "extended_media"),
    ]
    plain = flat.selectExpr("*", *(f"m.{path} AS {name}" for name, path in _PLAIN.items()))
    return plain.select("*", *derived)


def _complete() -> Column:
    return F.col("id").isNotNull() & F.col("author_id").isNotNull()


def sightings(flat: DataFrame, *, extended: bool = False) -> DataFrame:
    """``levels`` -> wide typed frame, messages with an id and an author only.

    ``extended`` prefers the entities of the extended form; without it they
    count only under the (unusual) key ``extended_text``.
    """
    return _typed(flat, extended).filter(_complete()).drop("m")


def everything(lines: DataFrame, *, extended: bool = False) -> DataFrame:
    """Sightings plus all other lines in one frame, made to be written once.

    ``part`` is ``message`` for sightings, ``incomplete`` for messages without id
    or author, ``blank`` for lines without text, else the line's route; ``text`` holds what is no sighting.
    """
    wide = _typed(levels(lines, others=True), extended)
    is_message = F.col("route") == "message"
    blank = (F.col("route") == "reject") & (F.length(F.trim("other")) == 0)
    part = F.when(is_message & ~_complete(), "incomplete").when(blank, "blank").otherwise(F.col("route"))
    text = F.when(F.col("part") == "incomplete", F.to_json("m")).otherwise(F.col("other"))
    return wide.withColumn("part", part).withColumn("text", text).drop("m", "route", "other")


def rejects(stage: DataFrame, *, split: bool = False) -> DataFrame:
    """What went to no table, out of ``everything``: position, reason and text.

    Only these few lines are decoded again, to tell why they were rejected.  ``split``: the lines come from
    split files, blank ones included, and ``line`` is made their number in the file.
    """
    bad = stage.filter(F.col("part").isin("reject", "incomplete")).select(
        *POSITION, "part", F.col("text").alias("value")
    )
    reason = F.when(F.col("part") == "incomplete", "incomplete").otherwise(
        reject_reason(F.col("value"), F.col("v"))
    )
    found = decode(bad, ROUTE_FIELDS).select(*POSITION, reason.alias("reason"), "value")
    if not split:
        return found
    numbered = found.join(line_numbers(stage.select(*POSITION)), ["file", "block"])
    return numbered.select("file", "block", (F.col("offset") + F.col("line") - F.col("first")).alias("line"), "reason", "value")


# What the type of a message is told from.
TYPE_FIELDS = ["in_reply_to_status_id"]


def type_stats(flat: DataFrame) -> DataFrame:
    """Messages read per type, embedded ones included, before any de-duplication."""
    return flat.groupBy("tweet_type").agg(F.count("*").alias("sightings"))
