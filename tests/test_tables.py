import pytest

from archivemill import schema
from archivemill.functions.scalars import as_text
from archivemill.plans import parse
from archivemill.plans.parse import sightings_of, tables
from tests.messages import ABSENT, deletion, message, user


def read(df, name, **options):
    return [tuple(r) for r in as_text(tables(df, **options)[name]).collect()]


@pytest.fixture
def rich(lines):
    entities = {
        "hashtags": [{"text": "NA", "indices": [0, 1]}, {"text": "Tag"}, {"text": "Tag"}],
        "urls": [{"expanded_url": None}, {"expanded_url": "http://h.example:80/p"}, {"expanded_url": "mailto:x"}],
        "user_mentions": [{"id_str": "44", "id": 44, "screen_name": "m"}],
        "media": [{"id_str": "1", "type": "photo", "media_url_https": "https://m/1"}],
    }
    own = message(
        1,
        text="a\r\nb\nc",
        entities=entities,
        extended_entities={"media": [{"id_str": "2", "type": "video", "media_url_https": "https://m/2"}]},
        place={"country_code": "TR", "name": "Ankara", "place_type": "city", "id": "x"},
        withheld_in_countries=["TR", "DE"],
        user=user(7, time_zone="Ankara", name=None, location="x\ny"),
    )
    empty = message(3, entities={**entities, "urls": []}, extended_entities={"media": []}, place=None)
    return lines(
        own,
        message(2, retweeted_status=own, entities=entities, withheld_in_countries=[]),
        message(4, in_reply_to_status_id=1, in_reply_to_user_id=7, in_reply_to_screen_name="user7"),
        message(5, uid=8, quoted_status=empty, withheld_in_countries=None),
        deletion(),
    )


def test_all_tables_have_their_fields(rich):
    built = tables(rich)
    assert list(built) == list(schema.TABLES)
    for name, df in built.items():
        fields = [f"{n} {t}" for n, t in df.dtypes]
        assert fields == [f.strip() for f in schema.TABLES[name].split(",")], name


def test_metadata(rich):
    row = {r[0]: r for r in read(rich, "tweet_metadata")}
    seen = "2018-05-02 13:08:45"
    common = ("tr", "Client", "http://client.example", 1, 2, 4, 3)
    assert row[2] == (2, 7, seen, "tr", "retweet", *common[1:], 1, 7, False, seen)
    assert row[4][11:13] == (1, 7) and row[4][4] == "reply"
    assert row[5][11:13] == (3, 7) and row[5][4] == "quote"
    assert row[1][11:13] == (None, None) and len(row) == 5


def test_text_of_own_messages_only(rich):
    assert sorted(read(rich, "tweet_text")) == [
        (1, "tr", "a  b c"), (3, "tr", "text 3"), (4, "tr", "text 4"), (5, "tr", "text 5")
    ]


def test_extended_text_wins(lines):
    long = message(1, extended_tweet={"full_text": "long"})
    assert read(lines(long), "tweet_text") == [(1, "tr", "long")]


def test_entities(rich):
    assert sorted(read(rich, "entities_hashtag")) == [(1, "NA"), (1, "Tag"), (3, "NA"), (3, "Tag")]
    assert sorted(read(rich, "entities_mention")) == [(1, 44, "m"), (3, 44, "m")]
    assert sorted(read(rich, "entities_url"), key=str) == [
        (1, "http://h.example:80/p", "h.example:80"), (1, "mailto:x", ""), (1, None, "")
    ]
    assert sorted(read(rich, "entities_media")) == [(1, 2, "video", "https://m/2"), (3, 1, "photo", "https://m/1")]


def test_entities_of_the_extended_form(lines):
    def tags(*names):
        return {"hashtags": [{"text": n} for n in names], "urls": [], "user_mentions": []}

    plain = message(1, entities=tags("short"), extended_tweet={"full_text": "x", "entities": tags("short", "long")})
    keyed = message(2, entities=tags("short"), extended_text=1, extended_tweet={"full_text": "x", "entities": tags("long")})
    df = lines(plain, keyed)
    assert sorted(read(df, "entities_hashtag")) == [(1, "short"), (2, "long")]
    assert sorted(read(df, "entities_hashtag", extended=True)) == [(1, "long"), (1, "short"), (2, "long")]


def test_places_and_countries(rich):
    assert read(rich, "geotagged_tweets") == [(1, "TR", "Ankara", "city")]
    assert sorted(read(rich, "withheld_tweets")) == [(1, "DE"), (1, "TR")]


def test_users(lines):
    df = lines(message(1, user=user(7, name="a\nb", profile_banner_url=ABSENT)),
               message(2, user=user(8, name=None, description=None, url="http://u", profile_banner_url="b")))
    users = {r[0]: r for r in read(df, "twitter_user")}
    assert users[7][1:8] == ("2008-08-27 13:08:45", "tr", "a b", "user7", "", "a  b", None)
    assert users[8][3] == "" and users[8][6] == "" and users[8][7] == "http://u"
    assert {r[0]: r[3] for r in read(df, "user_profile")} == {7: "", 8: "b"}


def test_timezones(lines):
    df = lines(message(1), message(2, user=user(8, time_zone="X")), message(3, user=user(9, utc_offset=-3600)))
    assert sorted(r[:4] for r in read(df, "user_timezone")) == [(8, 2, "X", None), (9, 3, None, -3600)]


def test_career_has_every_sighting_and_blank_urls(rich):
    rows = read(rich, "user_tweet_career")
    assert len(rows) == 5  # message 1 seen twice at the same time is one row
    assert {r[-1] for r in rows} == {""}
    assert "user_tweet_career" not in tables(rich, hydrated=True)


def test_networks(rich):
    seen = "2018-05-02 13:08:45"
    assert read(rich, "network_retweet") == [(2, 1, seen, 7, 7, "user7", "user7")]
    assert read(rich, "network_quote") == [(5, 3, seen, 8, 7, "user8", "user7")]
    assert read(rich, "network_reply") == [(4, 1, seen, 7, 7, "user7", "user7")]


def test_timeline_mode_drops_the_counts(rich):
    built = tables(rich, timeline=True)
    for name, df in built.items():
        assert df.columns == schema.columns(name, timeline=True)


def test_latest_row_wins_and_ties_are_decided(lines):
    def at(second, **changes):
        return {"created_at": f"Wed May 02 13:08:{second:02d} +0000 2018", **changes}

    older = message(1, **at(10), retweet_count=10)
    embedded = message(1, **at(10), retweet_count=30)
    df = lines(
        message(2, **at(30), retweeted_status=embedded), older, message(3, **at(40), retweet_count=1),
        message(3, **at(40), retweet_count=2), message(4, **at(40), retweet_count=7, quoted_status=message(4, retweet_count=8)),
    )
    expected = {1: 30, 2: 1, 3: 2, 4: 7}
    for frame in (df, df.orderBy("line", ascending=False), df.repartition(3, "line")):
        rows = parse.table(sightings_of(frame), "tweet_metadata").collect()
        assert {r.id: r.retweet_count for r in rows} == expected and len(rows) == 4
