import random
from collections import Counter

import pytest

from archivemill.operators import flags, rollups


@pytest.fixture
def network(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        author = 1 if rnd.random() < 0.4 else rnd.randrange(2, 9)
        original = rnd.choice([1, 3, 20, 21, None])
        rows.append((i, author, original))
    return rows, spark.createDataFrame(rows, "id bigint, author_id bigint, original_author_id bigint")


@pytest.fixture
def metadata(spark):
    rows = [(i, i % 5 + 1, f"t{i % 4}") for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, author_id bigint, tweet_type string")
    return rows, df.selectExpr("*", "timestamp_seconds(id) AS created_at")


def test_retweet_graph(network):
    rows, df = network
    expected = Counter((str(a), str(o)) for _, a, o in rows if o is not None)
    got = {(r.source, r.target): r.weight for r in rollups.retweet_graph(df).collect()}
    assert got == expected and sum(got.values()) == sum(o is not None for *_, o in rows)


def test_user_stats_equal_the_full_outer_joins(network, metadata):
    rows, net = network
    posts, md = metadata
    tw = Counter(str(a) for _, a, _ in posts)
    made = Counter(str(a) for _, a, _ in rows)
    got = Counter(str(o) for *_, o in rows if o is not None)
    expected = {k: (tw[k], made[k], got[k]) for k in {*tw, *made, *got}}
    found = {r[0]: tuple(r[1:]) for r in rollups.user_stats(md, net).collect()}
    assert found == expected

    frames = {"tw": (md, "author_id"), "made": (net, "author_id"), "got": (net, "original_author_id")}
    generic = {str(r[0]): tuple(r[1:]) for r in rollups.counts_outer(frames, "author").collect()}
    assert generic == expected
    joined = None
    for name, (df, key) in frames.items():
        one = df.filter(f"{key} is not null").groupBy(df[key].alias("author")).count().withColumnRenamed("count", name)
        joined = one if joined is None else joined.join(one, "author", "full")
    assert {str(r[0]): tuple(r[1:]) for r in joined.fillna(0).collect()} == expected


def test_hashtags(spark, metadata):
    _, md = metadata
    tags = spark.createDataFrame(
        [(0, "a"), (5, "a"), (5, "b"), (1, "NA"), (1, "null"), (2, None), (6, None), (6, "x"), (99, "lost")],
        "id bigint, hashtag string",
    )
    pairs = {(r.author_id, r.hashtag): r["count"] for r in rollups.author_hashtag(tags, md).collect()}
    assert pairs == {("1", "a"): 2, ("1", "b"): 1, ("2", "NA"): 1, ("2", "null"): 1, ("2", "x"): 1}
    stats = {r[0]: tuple(r[1:]) for r in rollups.author_hashtag_stats(tags, md).collect()}
    assert stats == {"1": (3, 2), "2": (4, 4)}


def test_activity(spark):
    md = spark.createDataFrame(
        [(1, 7, "reply"), (2, 7, "quote"), (3, 8, "retweet"), (4, 8, "tweet")],
        "id bigint, author_id bigint, tweet_type string",
    ).selectExpr("*", "timestamp_seconds(id) AS created_at")
    gone = spark.createDataFrame([(9, 7)], "id bigint, author_id bigint").selectExpr(
        "*", "timestamp_seconds(5) AS deletion_time"
    )
    rows = sorted((r.id, r.author_id, r.tweet_type) for r in rollups.activity_log(md, gone).collect())
    assert rows == [("1", "7", "tweet"), ("2", "7", "tweet"), ("3", "8", "retweet"), ("4", "8", "tweet"), ("9", "7", "deletion")]
    assert rollups.activity_log(md, None).count() == 4


def flagged(spark, rows, withheld):
    md = spark.createDataFrame(rows, "id bigint, linked_tweet bigint, author_id bigint")
    ids = spark.createDataFrame([(i,) for i in withheld], "id bigint")
    out = {r.id: (r.withheld, r.linked_withheld, r.user_withheld) for r in flags.flag_propagation(md, ids).collect()}
    assert len(out) == len(rows)
    return out, md, ids


CASES = [
    (1, None, 10),  # withheld, links to nothing
    (2, 100, 11),  # withheld, links to a withheld one
    (3, 101, 12),  # withheld, links to one that is not
    (4, None, 12),  # other row of that author
    (5, 100, 13),  # not withheld, links to a withheld one
    (6, 101, 14),
    (7, None, None),
]


def test_flags_spread_to_the_author(spark):
    out, md, ids = flagged(spark, CASES, [1, 2, 3, 100, 100])
    assert out == {
        1: (True, None, False), 2: (True, True, False), 3: (True, False, True), 4: (False, None, True),
        5: (False, True, False), 6: (False, False, False), 7: (False, None, False),
    }
    assert [r.author_id for r in flags.withheld_owners(md, ids).collect()] == [12]
    assert sorted(r.author_id for r in flags.withheld_authors(md, ids).collect()) == [10, 11, 12]


def test_another_withheld_id_can_flag_and_unflag(spark):
    more, *_ = flagged(spark, CASES, [1, 2, 3, 6, 100])
    assert more[6] == (True, False, True)
    fewer, *_ = flagged(spark, CASES, [1, 2, 3, 100, 101])
    assert fewer[3] == (True, True, False) and fewer[4] == (False, None, False)
    none, *_ = flagged(spark, CASES, [])
    assert not any(f[0] or f[2] for f in none.values())


def test_hot_and_null_keys_with_shuffle_joins(spark):
    """Half the rows link to nothing, a third to one message; no broadcast."""
    rnd = random.Random(5)
    rows = [(i, None if i % 2 else (7 if i % 3 else rnd.randrange(1000)), i % 11) for i in range(3000)]
    withheld = set(range(0, 1000, 3)) | {7}
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4096",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        out, *_ = flagged(spark, rows, withheld)
    finally:
        for key in settings:
            spark.conf.unset(key)
    owners = {a for i, linked, a in rows if i in withheld and linked is not None and linked not in withheld}
    assert out == {
        i: (i in withheld, None if linked is None else linked in withheld, a in owners) for i, linked, a in rows
    }


def test_string_and_int_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "-5")], "n int, s string")
    keys = spark.createDataFrame([("a",), (None,), ("-5",), ("-1",)], "k string")
    got = flags.existence_flag(df, keys, "s", "f", null_as=None).collect()
    assert {r.n: r.f for r in got} == {1: True, 2: None, 3: True}
    many = spark.createDataFrame([(-i,) for i in range(1, 1100)], "k bigint")
    assert {r.n: r.f for r in flags.existence_flag(df.withColumn("m", df.n * 0 - 1).filter("n < 3"), many, "m", "f").collect()} == {1: True, 2: True}
