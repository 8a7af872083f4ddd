"""DuckDB SQL that restates every registered query from the tables themselves.

The message queries are restated from ``events`` by the arithmetic rules of
``archivemill.sources.events``, with no JSON in between.
"""

from __future__ import annotations

from archivemill.schema import columns

_TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _text(expr: str) -> str:
    return _TEXT.format(expr)


_EVENTS = """
ev AS (
  SELECT event_id AS e, user_id AS u, event_type AS k, ts,
         date_trunc('second', ts) AS sec,
         strftime(ts, '%Y/%m/%d/%H') || '/00.json.bz2' AS file,
         1000000000 + event_id // 10 AS oid,
         2000000000 + event_id // 100 AS qid,
         make_timestamp((1701388800 + event_id // 10) * 1000000) AS ots,
         make_timestamp((1698796800 + event_id // 100) * 1000000) AS qts
  FROM events
)"""

# One row per message sighting: outer, embedded original, its own quote.
_LEVELS = (
    _EVENTS
    + """,
lv AS (
  SELECT e AS line, file, 0 AS depth, sec AS access, e AS id, u AS usr, sec AS created,
         CASE k WHEN 'click' THEN 'retweet' WHEN 'purchase' THEN 'quote'
                WHEN 'signup' THEN 'reply' ELSE 'tweet' END AS tweet_type,
         CASE WHEN k IN ('click', 'purchase') THEN oid WHEN k = 'signup' THEN e - 1 END AS lt,
         CASE WHEN k IN ('click', 'purchase') THEN oid % 150
              WHEN k = 'signup' THEN (e - 1) % 150 END AS lu
  FROM ev WHERE k <> 'error'
  UNION ALL
  SELECT e, file, 1, sec, oid, oid % 150, ots,
         CASE WHEN k = 'click' AND oid % 5 = 0 THEN 'quote' ELSE 'tweet' END,
         CASE WHEN k = 'click' AND oid % 5 = 0 THEN qid END,
         CASE WHEN k = 'click' AND oid % 5 = 0 THEN qid % 150 END
  FROM ev WHERE k IN ('click', 'purchase')
  UNION ALL
  SELECT e, file, 2, sec, qid, qid % 150, qts, 'tweet', NULL, NULL
  FROM ev WHERE k = 'click' AND oid % 5 = 0
),
m AS (
  SELECT *,
    CASE WHEN id % 31 = 0 THEN NULL WHEN id % 23 = 0 THEN 'unknown' ELSE 'en' END AS lang,
    CASE WHEN id % 19 = 0 THEN -1 ELSE id % 100 END AS retweets,
    CASE WHEN id % 37 = 0 THEN NULL WHEN id % 41 = 0 THEN -1 ELSE id % 50 END AS favorites,
    id % 7 AS replies, id % 3 AS quotes,
    CASE WHEN id % 4 = 1 THEN id % 8 = 1 ELSE false END AS sensitive,
    CASE WHEN id % 29 = 0 THEN 'web' ELSE 'C' || (id % 3) END AS source,
    CASE WHEN id % 29 = 0 THEN 'web' ELSE 'http://c' || (id % 3) END AS source_link,
    CASE WHEN usr % 6 = 0 THEN '' ELSE 'https://banner.example.com/' || usr END AS banner,
    make_timestamp((1262304000 + usr * 86400) * 1000000) AS user_created,
    CASE WHEN usr % 2 = 0 THEN 'en' END AS user_lang,
    CASE WHEN usr % 7 = 0 THEN 'N' || usr || '  x' ELSE 'N' || usr END AS name,
    'u' || usr AS screen_name,
    CASE WHEN usr % 4 <> 0 THEN 'L' || (usr % 10) || ' here' ELSE '' END AS location,
    CASE WHEN usr % 5 <> 0 THEN 'd' || usr || ' end' ELSE '' END AS description,
    CASE WHEN usr % 3 <> 1 THEN 'http://u' || usr || '.example.com' END AS user_url,
    id % 1000 + usr AS followers, id % 500 AS friends
  FROM lv
)"""
)

_LATEST_ORDER = "access DESC, file DESC, line DESC, depth ASC"

_LATEST_METADATA = (
    _LEVELS
    + f""",
md AS (
  SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_LATEST_ORDER}) = 1
),
rt AS (
  SELECT DISTINCT id, lt, created, usr, lu FROM m WHERE tweet_type = 'retweet'
),
tags AS (
  SELECT id, 'h' || (id % 17) AS hashtag FROM m WHERE tweet_type <> 'retweet' AND id % 3 = 0
  UNION
  SELECT id, 'h' || (id % 5) FROM m WHERE tweet_type <> 'retweet' AND id % 6 = 0
),
wh AS (
  SELECT DISTINCT id FROM m WHERE id % 13 <> 0 AND usr % 10 < 3 AND id % 11 = 0
),
pairs AS (
  SELECT usr, hashtag, count(*) AS n FROM tags JOIN md USING (id) GROUP BY usr, hashtag
),
deleted AS (
  SELECT DISTINCT e - 1 AS id, u AS author_id, epoch_us(ts) // 1000 AS timestamp_ms, sec AS deletion_time
  FROM ev WHERE k = 'error' AND e % 2 = 1 AND e % 30 <> 1
),
owners AS (
  SELECT DISTINCT usr FROM md
  WHERE lt IS NOT NULL AND id IN (SELECT id FROM wh) AND lt NOT IN (SELECT id FROM wh)
)"""
)


def _from_events(select: str) -> str:
    return f"WITH {_EVENTS}\n{select}"


def _from_levels(select: str) -> str:
    return f"WITH {_LEVELS}\n{select}"


def _from_tables(select: str) -> str:
    return f"WITH {_LATEST_METADATA}\n{select}"


_METADATA = f"""id, usr AS author_id, {_text('created')} AS created_at, lang, tweet_type, source,
  source_link, retweets AS retweet_count, favorites AS favorite_count, {{counts}}
  lt AS linked_tweet, lu AS linked_user, sensitive, {_text('access')} AS access"""


def _network(kind: str, date: str) -> str:
    return _from_levels(
        f"""SELECT DISTINCT id, lt AS original_tweet_id, {_text('created')} AS {date},
          usr AS author_id, lu AS original_author_id, screen_name,
          'u' || lu AS original_screen_name
        FROM m WHERE tweet_type = '{kind}'"""
    )


_NOTICE = """'{"id":' || e || ',"user_id":' || u || ',"withheld_in_countries":["TR"]' """

_CARRIED = (
    _EVENTS
    + """,
clock AS (
  SELECT e, u, k, file, sec,
    last_value(CASE WHEN k <> 'error' THEN strftime(ts, '%a %b %d %H:%M:%S +0000 %Y') END IGNORE NULLS)
      OVER (PARTITION BY file ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen
  FROM ev
),
notices AS (
  SELECT e, u, file, sec,
    coalesce(seen, strftime(date_trunc('hour', sec), '%Y-%m-%d %H:%M:00')) AS approx_time
  FROM clock WHERE k = 'error' AND e % 10 IN (6, 8)
)"""
)


def _marked(mid: str, user: str) -> str:
    return f"({mid} % 13 = 0 OR ({user} % 10 < 3 AND {mid} % 11 = 0))"


_MINED = f"""
  SELECT e, ts, 'tweets' AS kind, 'no' AS linked FROM ev WHERE k <> 'error' AND {_marked('e', 'u')}
  UNION ALL SELECT e, ts, 'users', 'no' FROM ev WHERE k <> 'error' AND u % 50 = 0
  UNION ALL SELECT e, ts, 'tweets', CASE k WHEN 'click' THEN 'retweeted' ELSE 'quoted' END
    FROM ev WHERE k IN ('click', 'purchase') AND {_marked('oid', '(oid % 150)')}
  UNION ALL SELECT e, ts, 'users', CASE k WHEN 'click' THEN 'retweeted' ELSE 'quoted' END
    FROM ev WHERE k IN ('click', 'purchase') AND (oid % 150) % 50 = 0"""


# Table by the query that returns it.
_STORED = {
    "tweet_metadata": "t_metadata", "tweet_text": "t_text", "entities_hashtag": "t_hashtag", "entities_mention": "t_mention",
    "entities_url": "t_url", "entities_media": "t_media", "twitter_user": "t_user", "user_timezone": "t_timezone",
    "user_profile": "t_profile", "user_tweet_career": "t_career", "network_retweet": "t_net_retweet",
    "network_reply": "t_net_reply", "network_quote": "t_net_quote", "geotagged_tweets": "t_geo",
    "deleted_tweets": "t_deleted", "withheld_tweets": "t_withheld",
}


# View by the query that returns it, with its columns.
_VIEWS = {
    "view_retweet_graph": ("retweet_graph", "source target weight"),
    "view_user_stats": ("user_stats", "author_id tw_num do_rt_num get_rt_num"),
    "view_author_hashtag": ("author_hashtag", "author_id hashtag count"),
    "view_author_hashtag_stats": ("author_hashtag_stats", "author_id total_hashtags different_hashtags"),
    "view_activity": ("activity_log", "id author_id created_at tweet_type"),
    "become_withheld": ("status_withheld_notices", "value"),
}


# Views that are written in order, with that order.
_ORDERED = {
    "view_retweet_graph": "source, target", "view_user_stats": "author_id",
    "view_author_hashtag": "CAST(author_id AS BIGINT), hashtag", "view_author_hashtag_stats": "CAST(author_id AS BIGINT)",
}


def _rows(name: str, columns: list[str], sql: str) -> str:
    cells = ", ".join(f"coalesce(CAST(\"{c}\" AS VARCHAR), '~')" for c in sorted(columns))
    return f"SELECT '{name}' AS name, concat_ws('|', {cells}) AS row_text FROM ({sql})"


def _whole_runs(checks: dict[str, str]) -> dict[str, str]:
    """The rows of all tables that a run stores, each as one text."""
    tables = [_rows(table, columns(table), checks[query]) for table, query in _STORED.items()]
    views = [_rows(view, names.split(), checks[query]) for view, (query, names) in _VIEWS.items()]
    flags = "id author_id linked_tweet withheld linked_withheld user_withheld".split()
    inferred = [
        _rows("metadata_updated", flags, checks["flag_propagation"]),
        _rows("all_users", ["author_id"], checks["withheld_authors"]),
        _rows("users_inferred", ["author_id"], checks["inferred_authors"]),
    ]
    return {
        "stored_contents": " UNION ALL ".join(tables + views),
        "views_kept_up": " UNION ALL ".join(views[:-1]),
        "ordered_views": " UNION ALL ".join(
            _rows(view, names.split(), checks[query]).replace(" AS row_text", f" AS row_text, row_number() OVER (ORDER BY {_ORDERED[view]}) - 1 AS place")
            for view, (query, names) in _VIEWS.items() if view in _ORDERED
        ),
        "parsed_in_halves": " UNION ALL ".join(tables),
        "inferred_run": " UNION ALL ".join(inferred),
    }


# The archive of eight files, of which the first two are broken.
_BROKEN = {
    "archive_broken_files": """
        SELECT event_id % 8 AS slot, CASE event_id % 8 WHEN 0 THEN 'cut off' WHEN 1 THEN 'damaged' END AS reason,
          CASE WHEN event_id % 8 < 2 THEN 0 ELSE count(*) END AS n_lines,
          CASE WHEN event_id % 8 < 2 THEN 0 ELSE count(*) - 1 END AS last_line
        FROM events GROUP BY event_id % 8""",
    "ledger_runs": """
        SELECT event_id % 8 AS slot, CASE WHEN event_id % 8 < 2 THEN 'broken' ELSE 'mined' END AS state,
          CASE event_id % 8 WHEN 0 THEN 'cut off' WHEN 1 THEN 'damaged' END AS reason,
          CASE WHEN event_id % 8 < 2 THEN 2 ELSE 1 END AS tries
        FROM events GROUP BY event_id % 8""",
    "latest_on_stream": """
        SELECT user_id, event_id, event_type, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1""",
    "distinct_on_stream": """
        SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts
        FROM (SELECT DISTINCT user_id, event_type, ts FROM events)""",
    "mined_archive": f"""WITH {_CARRIED}
        SELECT kind, e AS id, linked, CAST(NULL AS BIGINT) AS broken_slot, CAST(NULL AS VARCHAR) AS reason
        FROM ({_MINED}) WHERE e % 8 >= 2
        UNION ALL SELECT 'messages', e, NULL, NULL, NULL FROM notices WHERE e % 8 >= 2
        UNION ALL SELECT 'unusable', NULL, NULL, 0, 'cut off' UNION ALL SELECT 'unusable', NULL, NULL, 1, 'damaged'""",
}


def all_checks() -> dict[str, str]:
    checks = _checks()
    checks["archive_roundtrip"] = _from_levels("SELECT depth, id, tweet_type FROM m")
    checks["mined_then_parsed"] = _from_levels(
        f"SELECT DISTINCT id, usr AS author_id, tweet_type FROM m WHERE line IN (SELECT e FROM ({_MINED}))"
    )
    checks["csv_roundtrip"] = checks["t_user"]
    checks["stored_tables"] = " UNION ALL ".join(
        f"SELECT '{table}' AS name, (SELECT count(*) FROM ({checks[query]})) AS n_rows" for table, query in _STORED.items()
    )
    numbers = """SELECT e, sum(1 + CASE WHEN e % 7 = 0 THEN 1 ELSE 0 END)
        OVER (PARTITION BY e % 8 ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM ev"""
    checks["rejected_line_numbers"] = f"""
        SELECT r.line % 8 AS slot, CAST(coalesce(n.at, 0) AS BIGINT) AS line, r.reason, r.value
        FROM ({checks['rejected_lines']}) r JOIN ({_from_events(numbers)}) n ON n.e = r.line"""
    return checks | _BROKEN | _whole_runs(checks)


def _checks() -> dict[str, str]:
    return {
        "json_tolerant_parse": """
            SELECT event_id, props LIKE '{%}' AS is_object,
              CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events""",
        "rejected_lines": _from_events(
            f"""SELECT file, e AS line, CASE WHEN e % 2 = 1 THEN 'bad_json' ELSE 'no_text' END AS reason,
              CASE WHEN e % 2 = 1 THEN '{{"delete":{{"status":{{"id":' || e
                   ELSE {_NOTICE} || '}}' END AS value
            FROM ev WHERE k = 'error' AND (e % 30 = 1 OR e % 10 IN (6, 8))"""
        ),
        "path_time": """
            SELECT event_id AS line, strftime(ts, '%Y-%m-%d') AS date,
              strftime(ts, '%Y-%m-%d %H:00:00') AS start_time FROM events""",
        "table_scan": """
            SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS author_id,
              o_orderpriority AS kind FROM orders""",
        "probe_counts_present": _from_events(
            """SELECT count(*) FILTER (k <> 'error') AS with_counts,
              CAST(0 AS BIGINT) AS without_counts, CAST(0 AS BIGINT) AS undecidable,
              false AS timeline FROM ev"""
        ),
        "route_messages": _from_events(
            """SELECT e AS line, CASE WHEN k <> 'error' THEN 'message' WHEN e % 30 = 1 THEN 'reject'
              WHEN e % 2 = 1 THEN 'delete' WHEN e % 10 = 0 THEN 'limit'
              WHEN e % 10 = 2 THEN 'scrub_geo' WHEN e % 10 = 4 THEN 'status_withheld'
              ELSE 'reject' END AS route FROM ev"""
        ),
        "status_withheld_notices": _from_events(
            f"""SELECT e AS line, '{{"status_withheld":' || {_NOTICE} || '}}}}' AS value
            FROM ev WHERE k = 'error' AND e % 10 = 4"""
        ),
        "message_type": _from_levels("SELECT line, depth, id, tweet_type FROM m"),
        "mine_withheld": _from_events(
            f"SELECT e AS line, strftime(ts, '%Y-%m-%d') AS date, kind, linked FROM ({_MINED})"
        ),
        "mined_lines": f"""WITH {_CARRIED}
            SELECT kind, strftime(ts, '%Y-%m-%d') AS date, e AS id, linked,
              CAST(NULL AS VARCHAR) AS approx_time FROM ({_MINED})
            UNION ALL
            SELECT 'messages', strftime(sec, '%Y-%m-%d'), e, NULL, approx_time FROM notices""",
        "mine_messages": f"""WITH {_CARRIED}
            SELECT e AS line, strftime(sec, '%Y-%m-%d') AS date,
              {_NOTICE} || ',"approx_time":"' || approx_time || '"}}' AS value FROM notices""",
        "approx_time_locf": f"""WITH {_CARRIED}
            SELECT file, e AS line, approx_time FROM notices""",
        "carry_forward_events": """
            SELECT event_id, user_id,
              last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (
                PARTITION BY user_id ORDER BY ts, event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_bought
            FROM events""",
        "flatten_messages": _from_levels(
            f"""SELECT file, line, depth, id, usr AS author_id, tweet_type,
              {_text('access')} AS access FROM m"""
        ),
        "legacy_text": _from_levels(
            "SELECT line, depth, id, 't' || id || chr(10) || '#h' || (id % 17) AS text FROM m"
        ),
        "linked_reference": _from_levels(
            "SELECT line, depth, id, lt AS linked_tweet, lu AS linked_user FROM m"
        ),
        "t_metadata": _from_tables(
            f"SELECT {_METADATA.format(counts='quotes AS quote_count, replies AS reply_count,')} FROM md"
        ),
        "timeline_projection": _from_tables(f"SELECT {_METADATA.format(counts='')} FROM md"),
        "t_text": _from_levels(
            """SELECT DISTINCT id, lang, CASE WHEN id % 12 = 0 THEN 'x' || id
              ELSE 't' || id || ' #h' || (id % 17) END AS text FROM m WHERE tweet_type <> 'retweet'"""
        ),
        "t_user": _from_levels(
            f"""SELECT usr AS id, {_text('user_created')} AS created_at, user_lang AS lang, name,
              screen_name, location, description, user_url AS url, followers AS followers_count,
              friends AS friends_count, id % 250 AS favourites_count, usr % 9 AS listed_count,
              id AS statuses_count, usr % 12 = 0 AS protected, usr % 40 = 0 AS verified,
              usr % 2 = 1 AS default_profile, usr % 25 = 0 AS default_profile_image,
              {_text('access')} AS access
            FROM m QUALIFY row_number() OVER (PARTITION BY usr ORDER BY m.{_LATEST_ORDER}) = 1"""
        ),
        "t_profile": _from_levels(
            f"""SELECT usr AS id, 'https://bg.example.com/' || usr AS profile_background_image_url,
              'https://img.example.com/' || usr AS profile_image_url, banner AS profile_banner_url,
              {_text('access')} AS access
            FROM m QUALIFY row_number() OVER (PARTITION BY usr ORDER BY m.{_LATEST_ORDER}) = 1"""
        ),
        "t_timezone": _from_levels(
            f"""SELECT DISTINCT usr AS author_id, id AS tweet_id,
              CASE WHEN usr % 3 = 0 THEN 'TZ' || (usr % 8) END AS time_zone,
              CAST(CASE WHEN usr % 5 = 0 THEN (usr % 24 - 12) * 3600 END AS INTEGER) AS utc_offset,
              {_text('access')} AS access FROM m WHERE usr % 3 = 0 OR usr % 5 = 0"""
        ),
        "t_career": _from_levels(
            f"""SELECT DISTINCT usr AS author_id, id AS tweet_id, retweets AS retweet_count,
              favorites AS favourite_count, replies AS reply_count, quotes AS quote_count,
              followers AS followers_count, friends AS friends_count, id AS statuses_count,
              {_text('access')} AS access, screen_name, name, description,
              'http://img.example.com/' || usr AS profile_image_url, user_lang, location,
              coalesce(user_url, '') AS url FROM m"""
        ),
        "t_geo": _from_levels(
            """SELECT DISTINCT id, 'C' || (id % 5) AS country_code, 'P' || (id % 11) AS name,
              'city' AS place_type FROM m WHERE id % 4 = 0"""
        ),
        "t_withheld": _from_levels(
            """SELECT id, 'TR' AS country FROM m
                WHERE id % 13 <> 0 AND usr % 10 < 3 AND id % 11 = 0
              UNION SELECT id, 'DE' FROM m WHERE id % 13 <> 0 AND usr % 10 < 3 AND id % 22 = 0"""
        ),
        "t_hashtag": _from_tables("SELECT id, hashtag FROM tags"),
        "t_mention": _from_levels(
            """SELECT DISTINCT id, (id * 7) % 150 AS mentioned_id,
              'u' || ((id * 7) % 150) AS mentioned_screen_name
            FROM m WHERE tweet_type <> 'retweet' AND id % 7 = 0"""
        ),
        "t_url": _from_levels(
            """SELECT DISTINCT id,
              CASE WHEN id % 20 <> 5 THEN 'http://host' || (id % 9) || '.example.com/p/' || id END AS url,
              CASE WHEN id % 20 <> 5 THEN 'host' || (id % 9) || '.example.com' ELSE '' END AS host
            FROM m WHERE tweet_type <> 'retweet' AND id % 4 = 1"""
        ),
        "t_media": _from_levels(
            """SELECT DISTINCT id, CAST('9' || id AS BIGINT) AS media_id,
              CASE WHEN id % 20 = 0 THEN 'video' ELSE 'photo' END AS type,
              'https://' || CASE WHEN id % 20 = 0 THEN 'video' ELSE 'photo' END
                || '.example.com/' || id AS url
            FROM m WHERE tweet_type <> 'retweet' AND id % 10 = 0"""
        ),
        "t_net_retweet": _network("retweet", "retweeted_date"),
        "t_net_quote": _network("quote", "quoted_date"),
        "t_net_reply": _network("reply", "replied_date"),
        "t_deleted": _from_tables(
            f"""SELECT id, author_id, timestamp_ms, {_text('deletion_time')} AS deletion_time
            FROM deleted"""
        ),
        "parse_created_at": _from_levels(
            f"""SELECT line, depth, {_text('created')} AS created_at,
              {_text('user_created')} AS user_created_at FROM m"""
        ),
        "epoch_ms_to_ts": f"""
            SELECT event_id, {_text("date_trunc('second', ts)")} AS second FROM events""",
        "clean_newlines": """
            SELECT doc_id, translate(text, chr(13) || chr(10), '  ') AS text FROM documents""",
        "clean_newlines_turns": """
            SELECT conv_id, turn, coalesce(translate(text, chr(13) || chr(10), '  '), '') AS text
            FROM conversations""",
        "client_source": _from_levels("SELECT line, depth, source, source_link FROM m"),
        "url_host": """
            SELECT page_id, coalesce(split_part(split_part(url, '//', 2), '/', 1), '') AS host
            FROM pages""",
        "absent_defaults": _from_levels(
            "SELECT line, depth, lang, retweets, favorites, sensitive, banner FROM m"
        ),
        "latest_by_id": _from_levels(
            f"""SELECT usr AS id, followers AS followers_count, id AS statuses_count,
              {_text('access')} AS access
            FROM m QUALIFY row_number() OVER (PARTITION BY usr ORDER BY m.{_LATEST_ORDER}) = 1"""
        ),
        "latest_event_per_user": """
            SELECT user_id, event_id, event_type, value FROM events
            QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
        "distinct_rows": "SELECT DISTINCT text, lang FROM documents",
        "type_stats": _from_levels(
            "SELECT tweet_type, count(*) AS sightings FROM m GROUP BY tweet_type"
        ),
        "retweet_graph": _from_tables(
            """SELECT CAST(usr AS VARCHAR) AS source, CAST(lu AS VARCHAR) AS target,
              count(*) AS weight FROM rt GROUP BY usr, lu"""
        ),
        "supplier_part_edges": """
            SELECT l_suppkey AS source, l_partkey AS target, count(*) AS weight
            FROM lineitem GROUP BY l_suppkey, l_partkey""",
        "user_stats": _from_tables(
            """SELECT CAST(author AS VARCHAR) AS author_id, coalesce(a.n, 0) AS tw_num,
              coalesce(b.n, 0) AS do_rt_num, coalesce(c.n, 0) AS get_rt_num
            FROM (SELECT usr AS author, count(*) AS n FROM md GROUP BY usr) a
            FULL JOIN (SELECT usr AS author, count(*) AS n FROM rt GROUP BY usr) b USING (author)
            FULL JOIN (SELECT lu AS author, count(*) AS n FROM rt GROUP BY lu) c USING (author)"""
        ),
        "nation_counts": """
            SELECT nationkey, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers,
              coalesce(t.n, 0) AS nations
            FROM (SELECT c_nationkey AS nationkey, count(*) AS n FROM customer GROUP BY 1) c
            FULL JOIN (SELECT s_nationkey AS nationkey, count(*) AS n FROM supplier GROUP BY 1) s
              USING (nationkey)
            FULL JOIN (SELECT n_nationkey AS nationkey, count(*) AS n FROM nation GROUP BY 1) t
              USING (nationkey)""",
        "customer_counts": """
            SELECT custkey, coalesce(c.n, 0) AS customers, coalesce(o.n, 0) AS orders
            FROM (SELECT c_custkey AS custkey, count(*) AS n FROM customer GROUP BY 1) c
            FULL JOIN (SELECT o_custkey AS custkey, count(*) AS n FROM orders GROUP BY 1) o
              USING (custkey)""",
        "author_hashtag": _from_tables(
            "SELECT CAST(usr AS VARCHAR) AS author_id, hashtag, n AS count FROM pairs"
        ),
        "author_hashtag_stats": _from_tables(
            """SELECT CAST(usr AS VARCHAR) AS author_id, CAST(sum(n) AS BIGINT) AS total_hashtags,
              count(*) AS different_hashtags FROM pairs GROUP BY usr"""
        ),
        "activity_log": _from_tables(
            f"""SELECT CAST(id AS VARCHAR) AS id, CAST(usr AS VARCHAR) AS author_id,
              {_text('created')} AS created_at,
              CASE WHEN tweet_type = 'retweet' THEN 'retweet' ELSE 'tweet' END AS tweet_type FROM md
            UNION ALL
            SELECT CAST(id AS VARCHAR), CAST(author_id AS VARCHAR), {_text('deletion_time')},
              'deletion' FROM deleted"""
        ),
        "flag_propagation": _from_tables(
            """SELECT id, usr AS author_id, lt AS linked_tweet,
              id IN (SELECT id FROM wh) AS withheld,
              CASE WHEN lt IS NOT NULL THEN lt IN (SELECT id FROM wh) END AS linked_withheld,
              usr IN (SELECT usr FROM owners) AS user_withheld FROM md"""
        ),
        "linked_flag": _from_tables(
            """SELECT id, lt AS linked_tweet,
              CASE WHEN lt IS NOT NULL THEN lt IN (SELECT id FROM wh) END AS linked_withheld FROM md"""
        ),
        "toxic_documents": """
            SELECT doc_id, lang, source,
              doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS is_toxic FROM documents""",
        "users_with_errors": """
            SELECT event_id, user_id, user_id IN (
              SELECT user_id FROM events WHERE event_type = 'error' AND value > 90) AS user_flagged
            FROM events""",
        "withheld_authors": _from_tables(
            "SELECT DISTINCT usr AS author_id FROM md WHERE id IN (SELECT id FROM wh)"
        ),
        "inferred_authors": _from_tables("SELECT usr AS author_id FROM owners"),
    }
