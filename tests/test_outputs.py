import datetime
import os

import pytest
from pyspark.sql import functions as F

from archivemill import schema
from archivemill.operators import rollups
from archivemill.operators.mining import withheld_profiles
from archivemill.plans import staging
from archivemill.plans.infer import run_infer
from archivemill.plans.parse import run_parse, tables
from archivemill.plans.sinks import write_in_order, write_table
from archivemill.sources.tables import read_table
from archivemill.streaming.incremental import fold_run
from tests.messages import ABSENT, deletion, message, user

HELD = {"withheld_in_countries": ["TR"]}


@pytest.fixture
def some(lines):
    tags = {"hashtags": [{"text": 'q"uo,te'}, {"text": ""}], "urls": [], "user_mentions": []}
    return lines(
        message(1, entities=tags, user=user(7, url='say "hi", \\ you')),
        message(2, uid=8, retweeted_status=message(1, uid=7, **HELD), **HELD),
        message(3, uid=8, text="ünï \t code"),
        message(4, text=ABSENT),
        deletion(),
        {"status_withheld": {"id": 1}},
        "{",
        message(5, user=ABSENT),
    )


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
@pytest.mark.parametrize("timeline", [False, True])
def test_a_whole_run(spark, some, tmp_path, fmt, timeline):
    out = str(tmp_path / "out")
    counts = run_parse(some, out, fmt=fmt, timeline=timeline)
    assert {r.tweet_type: r.sightings for r in counts.collect()} == {"tweet": 4, "retweet": 1}
    for name, df in tables(some, timeline=timeline).items():
        stored = read_table(spark, out, name, fmt=fmt, timeline=timeline)
        assert stored.columns == schema.columns(name, timeline=timeline)
        assert sorted(map(str, stored.collect())) == sorted(map(str, df.collect())), name
    assert spark.read.text(f"{out}/become_withheld").count() == 1
    reasons = sorted(r.reason for r in spark.read.parquet(f"{out}/rejects").collect())
    assert reasons == ["bad_json", "incomplete", "no_text"]
    for view in ("retweet_graph", "user_stats", "author_hashtag", "author_hashtag_stats", "activity"):
        assert os.path.exists(f"{out}/view_{view}/_SUCCESS")
    graph = spark.read.format(fmt).option("header", True).load(f"{out}/view_retweet_graph")
    assert [tuple(map(str, r)) for r in graph.collect()] == [("8", "7", "1")]


def test_a_run_replaces_the_one_before(spark, some, lines, tmp_path):
    out = str(tmp_path / "out")
    run_parse(some, out, views=False)
    run_parse(lines(message(9)), out, views=False, skip_empty=True)
    assert not os.path.exists(f"{out}/view_activity")
    assert [r.id for r in read_table(spark, out, "tweet_metadata").collect()] == [9]


def test_nothing_of_the_run_before_stays(spark, some, lines, tmp_path):
    out = str(tmp_path / "out")
    run_parse(some, out)
    run_parse(lines(message(9)), out, skip_empty=True, hydrated=True)
    assert not os.path.exists(f"{out}/network_retweet") and not os.path.exists(f"{out}/user_tweet_career")
    assert spark.read.parquet(f"{out}/view_retweet_graph").count() == 0
    assert spark.read.text(f"{out}/become_withheld").count() == 0
    run_parse(lines(message(9)), out, views=False)
    assert not any(name.startswith("view_") for name in os.listdir(out))


def test_the_same_input_twice_gives_the_same_folder(spark, some, tmp_path, monkeypatch):
    stages = tmp_path / "stages"
    monkeypatch.setattr(staging, "staging_root", lambda spark: str(stages))
    out = str(tmp_path / "out")
    for _ in range(2):
        run_parse(some, out, views=False)
        assert spark.read.text(f"{out}/become_withheld").count() == 1
        assert spark.read.parquet(f"{out}/rejects").count() == 3
    assert os.listdir(stages) == [], "the stage is dropped"


AWKWARD = ["An\nkara", 'say "hi", \\ you', "", None, " x ", "a,b", "#", "\n", '"', "é\t"]


@pytest.mark.parametrize("name", list(schema.TABLES))
def test_csv_keeps_every_table(spark, tmp_path, name):
    fields = [f.strip().split() for f in schema.TABLES[name].split(",")]
    makers = {
        "string": lambda i, j: AWKWARD[(i + j) % len(AWKWARD)], "timestamp": lambda i, j: datetime.datetime(2018, 5, 2, 3, i),
        "boolean": lambda i, j: [True, False, None][(i + j) % 3],
    }
    rows = [tuple(makers.get(kind, lambda i, j: i * 7 + j if i else None)(i, j) for j, (_, kind) in enumerate(fields)) for i in range(10)]
    df = spark.createDataFrame(rows, schema.TABLES[name])
    write_table(df, str(tmp_path / name), fmt="csv")
    stored = read_table(spark, str(tmp_path), name, fmt="csv")
    assert sorted(map(str, stored.collect())) == sorted(map(str, df.collect()))


def test_new_rows_are_folded_into_stored_tables(spark, lines, tmp_path):
    early = message(1, uid=7, created_at="Wed May 02 10:00:00 +0000 2018")
    late = message(1, uid=7, text="changed", retweet_count=50)
    first, second = tables(lines(early, message(2))), tables(lines(late, message(3)))
    both = fold_run(first, second)
    expected = tables(lines(early, message(2)).union(lines(late, message(3), block=1)))
    for name in ("tweet_metadata", "tweet_text", "user_tweet_career"):
        assert sorted(map(str, both[name].collect())) == sorted(map(str, expected[name].collect())), name
    again = fold_run(both, second)
    assert sorted(map(str, again["tweet_metadata"].collect())) == sorted(map(str, both["tweet_metadata"].collect()))


def test_known_withheld_users_are_not_inferred(spark, some, tmp_path):
    metadata, ids = tables(some)["tweet_metadata"], spark.createDataFrame([(2,)], "id bigint")
    run_infer(metadata, ids, str(tmp_path), profiles=spark.createDataFrame([(8,)], "author_id bigint"))
    assert spark.read.parquet(f"{tmp_path}/users_inferred").count() == 0
    assert spark.read.parquet(f"{tmp_path}/all_users").count() == 1


def test_profiles_that_are_withheld_as_a_whole(lines):
    df = lines(
        message(1, user=user(7, **HELD)), message(2, uid=9, retweeted_status=message(3, user=user(8, **HELD))),
        message(4, uid=9, quoted_status=message(5, uid=6, **HELD)), message(6, uid=5, quoted_status=message(7, user=user(7, **HELD))),
    )
    assert sorted(r.author_id for r in withheld_profiles(df).collect()) == [7, 8]


def test_a_user_without_the_text_id_is_kept(lines):
    found = tables(lines(message(1, user=user(7, id_str=None))))
    assert [r.id for r in found["user_profile"].collect()] == [7]


def test_empty_tables_can_be_left_out(spark, lines, tmp_path):
    out = str(tmp_path / "out")
    run_parse(lines(deletion()), out, skip_empty=True)
    stored = {d for d in os.listdir(out) if d in schema.TABLES}
    assert stored == {"tweet_metadata", "twitter_user", "user_profile", "deleted_tweets"}
    missing = read_table(spark, out, "network_retweet", optional=True)
    assert missing.count() == 0 and missing.columns == schema.columns("network_retweet")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_table(spark, out, "network_retweet")
    assert spark.read.parquet(f"{out}/view_activity").count() == 1
    assert spark.read.parquet(f"{out}/view_retweet_graph").count() == 0


def test_scan_reads_only_the_asked_columns(spark, some, tmp_path):
    out = str(tmp_path / "out")
    write_table(tables(some)["tweet_metadata"], f"{out}/tweet_metadata")
    df = read_table(spark, out, "tweet_metadata", ["id", "author_id"]).filter("id = 3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,author_id:bigint>" in plan and "EqualTo(id,3)" in plan


def test_csv_keeps_empty_text_and_null_apart(spark, tmp_path):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "NA"), (4, 'a"b,c')], "id bigint, hashtag string")
    write_table(df, str(tmp_path / "entities_hashtag"), fmt="csv")
    stored = read_table(spark, str(tmp_path), "entities_hashtag", fmt="csv")
    assert {r.id: r.hashtag for r in stored.collect()} == {1: "", 2: None, 3: "NA", 4: 'a"b,c'}


def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path):
    texts = ["a\nb", "\\n", "\\\\n\r\n", "\\", "", None, 'q"\n,"', "\r", "x\\\n", "plain"]
    rows = [(i, "en", texts[i % len(texts)]) for i in range(3000)]
    df = spark.createDataFrame(rows, schema.TABLES["tweet_text"])
    write_table(df.coalesce(1), str(tmp_path / "tweet_text"), fmt="csv")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        stored = read_table(spark, str(tmp_path), "tweet_text", fmt="csv")
        found = sorted((r.id, r.lang, r.text) for r in stored.collect())
        tasks = stored.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == rows and tasks > 3 and stored.select("id").columns == ["id"]


def test_csv_with_line_ends_in_its_fields_can_still_be_read(spark, tmp_path):
    (tmp_path / "tweet_text").mkdir()
    (tmp_path / "tweet_text" / "a.csv").write_text('id,lang,text\n1,en,"a\nb"\n2,en,\\n\n')
    stored = read_table(spark, str(tmp_path), "tweet_text", fmt="csv", one_line=False)
    assert {r.id: r.text for r in stored.collect()} == {1: "a\nb", 2: "\\n"}


def test_files_written_in_order_are_sorted_one_after_the_other(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id * 7919 % 20011 AS k", "cast(id as string) AS v").repartition(6)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_in_order(df, str(tmp_path / "t"), [F.col("k"), F.col("v")])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    files = sorted(p for p in os.listdir(tmp_path / "t") if p.startswith("part-"))
    keys = [r.k for f in files for r in spark.read.parquet(str(tmp_path / "t" / f)).collect()]
    assert len(files) > 2 and keys == sorted(keys) and len(keys) == 20_000


def test_inference_outputs(spark, some, tmp_path):
    metadata = tables(some)["tweet_metadata"]
    ids = spark.createDataFrame([(2,)], "id bigint")
    out = str(tmp_path / "out")
    run_infer(metadata, ids, out)
    rows = spark.read.parquet(f"{out}/metadata_updated").collect()
    assert {r.id: (r.withheld, r.linked_withheld, r.user_withheld) for r in rows} == {
        1: (False, None, False), 2: (True, False, True), 3: (False, None, True)
    }
    assert [r.author_id for r in spark.read.parquet(f"{out}/all_users").collect()] == [8]
    assert [r.author_id for r in spark.read.parquet(f"{out}/users_inferred").collect()] == [8]


def test_edges_sum_to_the_network(some):
    network = tables(some)["network_retweet"]
    graph = rollups.retweet_graph(network)
    assert graph.agg(F.sum("weight")).first()[0] == network.count()
