"""Derive raw archive messages from the ``events`` table.

The driver's tables hold no nested messages, so the registered queries turn
every event into one JSON line by arithmetic rules and run the real pipeline on
those lines.  A rule only looks at the event's own columns; the mapping is one
projection without a shuffle and grows with the table.

========== =====================================================================
event      line
========== =====================================================================
view       plain message
click      message embedding the original it repeats (``retweeted_status``)
purchase   message embedding the original it quotes (``quoted_status``)
signup     reply to the previous event
error      by ``event_id % 10``: 0 limit, 2 scrub_geo, 4 status_withheld,
           6 and 8 a withheld notice without ``created_at``, odd a deletion;
           every ``event_id % 30 == 1`` line is cut off in the middle
========== =====================================================================
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from archivemill.session import spread

ORIGINAL_BASE = 1_000_000_000
QUOTED_BASE = 2_000_000_000
AUTHORS = 150
BLOCK = 2000

# The rules are SQL expressions put together as text.  An expression renders a
# piece of JSON; SQL NULL stands for "key absent".


def _fields(**fields: str) -> str:
    pairs = (f"""concat('"{key}":', {value})""" for key, value in fields.items())
    return f"concat_ws(',', {', '.join(pairs)})"


def _obj(**fields: str) -> str:
    return f"concat('{{', {_fields(**fields)}, '}}')"


def _arr(*items: str) -> str:
    return f"concat('[', concat_ws(',', {', '.join(items)}), ']')"


def _num(value: str) -> str:
    return f"cast({value} AS string)"


def _txt(*parts: str) -> str:
    """A JSON string of SQL expressions; literals stand in single quotes."""
    return f"""concat('"', {', '.join(parts)}, '"')"""


def _when(cond: str, value: str) -> str:
    """The key is absent unless ``cond``."""
    return f"CASE WHEN {cond} THEN {value} END"


def _nullable(cond: str, value: str) -> str:
    """JSON null unless ``cond``; the key itself is always written."""
    return f"CASE WHEN {cond} THEN {value} ELSE 'null' END"


def _stamp(ts: str) -> str:
    return _txt(f"date_format({ts}, 'EEE MMM dd HH:mm:ss \\'+0000\\' yyyy')")


def _user(user: str, seen_in: str) -> str:
    # Counters follow the carrying message so that two sightings of a user differ.
    return _obj(
        id=_num(user),
        id_str=_txt(user),
        created_at=_stamp(f"timestamp_seconds(1262304000 + {user} * 86400)"),
        lang=_nullable(f"{user} % 2 = 0", _txt("'en'")),
        name=_txt("'N'", user, f"CASE WHEN {user} % 7 = 0 THEN '\\\\r\\\\nx' ELSE '' END"),
        screen_name=_txt("'u'", user),
        location=_nullable(f"{user} % 4 <> 0", _txt("'L'", f"{user} % 10", "'\\\\nhere'")),
        description=_nullable(f"{user} % 5 <> 0", _txt("'d'", user, "'\\\\rend'")),
        url=_nullable(f"{user} % 3 <> 1", _txt("'http://u'", user, "'.example.com'")),
        followers_count=_num(f"{seen_in} % 1000 + {user}"),
        friends_count=_num(f"{seen_in} % 500"),
        favourites_count=_num(f"{seen_in} % 250"),
        listed_count=_num(f"{user} % 9"),
        statuses_count=_num(seen_in),
        protected=_num(f"{user} % 12 = 0"),
        verified=_num(f"{user} % 40 = 0"),
        default_profile=_num(f"{user} % 2 = 1"),
        default_profile_image=_num(f"{user} % 25 = 0"),
        profile_background_image_url_https=_txt("'https://bg.example.com/'", user),
        profile_image_url_https=_txt("'https://img.example.com/'", user),
        profile_image_url=_txt("'http://img.example.com/'", user),
        profile_banner_url=_when(f"{user} % 6 <> 0", _txt("'https://banner.example.com/'", user)),
        time_zone=_nullable(f"{user} % 3 = 0", _txt("'TZ'", f"{user} % 8")),
        utc_offset=_nullable(f"{user} % 5 = 0", _num(f"({user} % 24 - 12) * 3600")),
        withheld_in_countries=_when(f"{user} % 50 = 0", """'["TR"]'"""),
    )


def _media(mid: str, kind: str) -> str:
    return _arr(
        _obj(
            id_str=_txt("'9'", mid),
            type=_txt(f"'{kind}'"),
            media_url_https=_txt(f"'https://{kind}.example.com/'", mid),
        )
    )


def _render(m: str) -> str:
    """The fields of one message ``(mid, user, ts, is_retweet, reply_to)``, without braces."""
    mid, user, target = f"{m}.mid", f"{m}.user", f"{m}.reply_to"
    is_reply = f"{target} IS NOT NULL"
    withheld = f"""CASE WHEN {mid} % 13 = 0 THEN 'null'
        WHEN {user} % 10 < 3 AND {mid} % 22 = 0 THEN '["TR","DE"]'
        WHEN {user} % 10 < 3 AND {mid} % 11 = 0 THEN '["TR"]' END"""
    text = _txt("'t'", mid, "'\\\\n#h'", f"{mid} % 17")
    link = _txt("'http://host'", f"{mid} % 9", "'.example.com/p/'", mid)
    mentioned = f"{mid} * 7 % {AUTHORS}"
    anchor = _txt(
        """'<a href=\\\\"http://c'""",
        f"{mid} % 3",
        """'\\\\" rel=\\\\"nofollow\\\\">C'""",
        f"{mid} % 3",
        "'</a>'",
    )
    place = _obj(
        country_code=_txt("'C'", f"{mid} % 5"), name=_txt("'P'", f"{mid} % 11"), place_type=_txt("'city'")
    )
    return _fields(
        created_at=_stamp(f"{m}.ts"),
        id=_num(mid),
        text=_when(f"{mid} % 8 <> 0", text),
        full_text=_when(f"{mid} % 8 = 0", text),
        source=f"CASE WHEN {mid} % 29 = 0 THEN {_txt("'web'")} ELSE {anchor} END",
        in_reply_to_status_id=_nullable(is_reply, _num(target)),
        in_reply_to_user_id=_nullable(is_reply, _num(f"{target} % {AUTHORS}")),
        in_reply_to_screen_name=_nullable(is_reply, _txt("'u'", f"{target} % {AUTHORS}")),
        user=_user(user, mid),
        place=_nullable(f"{mid} % 4 = 0", place),
        lang=f"CASE WHEN {mid} % 31 = 0 THEN 'null' WHEN {mid} % 23 <> 0 THEN {_txt("'en'")} END",
        retweet_count=_when(f"{mid} % 19 <> 0", _num(f"{mid} % 100")),
        favorite_count=f"""CASE WHEN {mid} % 37 = 0 THEN 'null'
            WHEN {mid} % 41 <> 0 THEN {_num(f"{mid} % 50")} END""",
        reply_count=_num(f"{mid} % 7"),
        quote_count=_num(f"{mid} % 3"),
        possibly_sensitive=_when(f"{mid} % 4 = 1", _num(f"{mid} % 8 = 1")),
        withheld_in_countries=withheld,
        entities=_obj(
            hashtags=_arr(
                _when(f"{mid} % 3 = 0", _obj(text=_txt("'h'", f"{mid} % 17"))),
                _when(f"{mid} % 6 = 0", _obj(text=_txt("'h'", f"{mid} % 5"))),
            ),
            urls=_arr(
                _when(f"{mid} % 4 = 1", _obj(expanded_url=_nullable(f"{mid} % 20 <> 5", link)))
            ),
            user_mentions=_arr(
                _when(
                    f"{mid} % 7 = 0",
                    _obj(id_str=_txt(mentioned), screen_name=_txt("'u'", mentioned)),
                )
            ),
            media=_when(f"{mid} % 10 = 0", _media(mid, "photo")),
        ),
        extended_entities=_when(f"{mid} % 20 = 0", _obj(media=_media(mid, "video"))),
        extended_tweet=_when(
            f"{mid} % 12 = 0 AND NOT {m}.is_retweet", _obj(full_text=_txt("'x'", mid))
        ),
    )


def _notice() -> str:
    e, u = "event_id", "user_id"
    withheld = _obj(id=_num(e), user_id=_num(u), withheld_in_countries="""'["TR"]'""")
    deletion = _obj(
        delete=_obj(
            status=_obj(id=_num(f"{e} - 1"), user_id=_num(u)),
            timestamp_ms=_txt("unix_millis(cast(ts AS timestamp))"),
        )
    )
    return f"""CASE
        WHEN {e} % 30 = 1 THEN concat('{{"delete":{{"status":{{"id":', {e})
        WHEN {e} % 2 = 1 THEN {deletion}
        WHEN {e} % 10 = 0 THEN {_obj(limit=_obj(track=_num(e)))}
        WHEN {e} % 10 = 2 THEN {_obj(scrub_geo=_obj(user_id=_num(u)))}
        WHEN {e} % 10 = 4 THEN {_obj(status_withheld=withheld)}
        ELSE {withheld} END"""


def _level(mid: str, user: str, at: str, is_retweet: str = "false", reply_to: str = "NULL") -> str:
    return f"""named_struct('mid', cast({mid} AS bigint), 'user', cast({user} AS bigint),
        'ts', {at}, 'is_retweet', {is_retweet}, 'reply_to', cast({reply_to} AS bigint))"""


def message_lines(events: DataFrame) -> DataFrame:
    """``events`` -> archive lines ``(file, block, line, value)``.

    ``line`` is the event id: it grows along the file, and only the order counts.
    A new ``block`` starts every 2,000 events.
    """
    original = f"({ORIGINAL_BASE} + event_id div 10)"
    quoted = f"({QUOTED_BASE} + event_id div 100)"
    outer = _level(
        "event_id",
        "user_id",
        "cast(ts AS timestamp)",
        "event_type = 'click'",
        _when("event_type = 'signup'", "event_id - 1"),
    )
    repeated = _level(
        original, f"{original} % {AUTHORS}", "timestamp_seconds(1701388800 + event_id div 10)"
    )
    nested = _level(
        quoted, f"{quoted} % {AUTHORS}", "timestamp_seconds(1698796800 + event_id div 100)"
    )
    # One rendering rule for all levels, each a column of its own: a lambda over an array of levels would be
    # interpreted for every message.  The pieces are then put inside each other.
    levels = {
        "m0": outer,
        "m1": _when("event_type IN ('click', 'purchase')", repeated),
        "m2": _when(f"event_type = 'click' AND {original} % 5 = 0", nested),
    }
    parts = {m: _when(f"event_type <> 'error' AND {m}.mid IS NOT NULL", _render(m)) for m in levels}
    below = """coalesce(concat(',"quoted_status":{', p2, '}'), '')"""
    key = "CASE event_type WHEN 'click' THEN 'retweeted' ELSE 'quoted' END"
    embedded = f"""coalesce(concat(',"', {key}, '_status":{{', p1, {below}, '}}'), '')"""
    position = [
        "concat(date_format(ts, 'yyyy/MM/dd/HH'), '/00.json.bz2') AS file",
        f"event_id - event_id % {BLOCK} AS block",
        "event_id AS line",
    ]
    return (
        events.selectExpr(*position, "event_id", "user_id", "ts", "event_type", *(f"{level} AS {m}" for m, level in levels.items()))
        .selectExpr(
            "file", "block", "line", "event_type", f"CASE WHEN event_type = 'error' THEN {_notice()} END AS notice",
            *(f"{part} AS p{m[1:]}" for m, part in parts.items()),
        )
        .selectExpr("file", "block", "line", f"coalesce(notice, concat('{{', p0, {embedded}, '}}')) AS value")
    )


def lines_from_events(spark: SparkSession, sf_dir: str, by: Sequence[Column | str] = ()) -> DataFrame:
    """The lines; with ``by``, keys of an event, each task makes those of a range of the keys."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "ts", "user_id", "event_type"
    )
    return message_lines(spread(events, by=by))
