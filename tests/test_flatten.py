import time

from archivemill.operators import flatten
from archivemill.operators.flatten import levels, sightings
from tests.messages import ABSENT, CREATED, deletion, message


def seen(df):
    rows = sightings(levels(df)).orderBy("line", "depth").collect()
    return [(r.line, r.depth, r.id, r.tweet_type) for r in rows]


def test_embedded_messages_become_rows(lines):
    quoted = message(3)
    df = lines(
        message(1, retweeted_status=message(2, quoted_status=quoted), quoted_status=message(99)),
        message(4, quoted_status=message(5)),
        deletion(),
    )
    assert seen(df) == [
        (0, 0, 1, "retweet"), (0, 1, 2, "quote"), (0, 2, 3, "tweet"),
        (1, 0, 4, "quote"), (1, 1, 5, "tweet"),
    ]


def test_any_depth(lines):
    nested = message(40)
    for mid in range(39, 0, -1):
        nested = message(mid, quoted_status=nested)
    rows = sightings(levels(lines(nested, message(100)))).orderBy("line", "depth").collect()
    assert [(r.depth, r.id) for r in rows] == [(i, i + 1) for i in range(40)] + [(0, 100)]


def test_a_repeat_inside_a_repeat(lines):
    deep = message(3, retweeted_status=message(4, quoted_status=message(5)))
    df = lines(message(1, retweeted_status=message(2, retweeted_status=deep, quoted_status=message(99))), message(6, quoted_status=message(7, retweeted_status=message(8))))
    assert [(d, i) for _, d, i, _ in seen(df)] == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 6), (1, 7), (2, 8)]


def test_a_long_message_below_the_typed_levels_takes_bounded_time(lines):
    nested = message(9, text="x" * 1_000_000)
    for mid in range(8, 0, -1):
        nested = message(mid, quoted_status=nested)
    start = time.time()
    assert len(seen(lines(nested))) == 9
    assert time.time() - start < 20


def test_all_rows_carry_the_outer_time(lines):
    inner = message(2, created_at="Tue May 01 00:00:00 +0000 2018")
    rows = sightings(levels(lines(message(1, retweeted_status=inner)))).collect()
    assert {str(r.access) for r in rows} == {"2018-05-02 13:08:45"}
    assert {str(r.created_at) for r in rows} == {"2018-05-02 13:08:45", "2018-05-01 00:00:00"}


def test_text_under_its_old_and_new_key_at_every_level(lines):
    old = {"text": ABSENT, "full_text": "long"}
    df = lines(message(1, retweeted_status=message(2, **old, quoted_status=message(3, **old))))
    rows = sightings(levels(df)).orderBy("depth").collect()
    assert [r.plain_text or r.full_text for r in rows] == ["text 1", "long", "long"]


def test_defaults_for_absent_but_not_for_null(lines):
    keys = ("lang", "retweet_count", "favorite_count", "possibly_sensitive")
    absent = message(1, **dict.fromkeys(keys, ABSENT))
    null = message(2, **dict.fromkeys(keys, None))
    filled = message(3, possibly_sensitive=True)
    rows = sightings(levels(lines(absent, null, filled))).orderBy("line").collect()
    values = [(r.lang, r.retweets, r.favorites, r.sensitive) for r in rows]
    assert values == [("unknown", -1, -1, False), (None, None, None, None), ("tr", 1, 2, True)]


def test_type_counts_include_repeated_sightings(lines):
    same = message(2)
    df = levels(lines(message(1, retweeted_status=same), message(3, retweeted_status=same)))
    counts = {r.tweet_type: r.sightings for r in flatten.type_stats(df).collect()}
    assert counts == {"retweet": 2, "tweet": 2}


def test_incomplete_messages_are_left_out(lines):
    df = lines(message(1, user=ABSENT), message(2, id=None), message(3, retweeted_status={"text": "x"}))
    assert seen(df) == [(2, 0, 3, "retweet")]


def test_unreadable_time_is_null(lines):
    df = lines(message(1, created_at="yesterday"), message(2, created_at=CREATED.replace("+0000", "+0200")))
    assert [(r.created_at, r.access) for r in sightings(levels(df)).collect()] == [(None, None)] * 2
