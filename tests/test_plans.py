"""What the plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from archivemill.operators import flags, flatten, latest, mining, tables
from archivemill.plans import parse
from archivemill.queries import all_queries
from archivemill.sources.events import message_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture
def stored(spark, lines, tmp_path):
    """Lines read from files, as in real use."""
    path = str(tmp_path / "lines")
    lines("{}").write.parquet(path)
    return spark.read.parquet(path)


def optimized(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "10000")
    return df._jdf.queryExecution().optimizedPlan().toString()


def parses(plan):
    """Decodings of lines; the one inside the loop for deep messages does not count."""
    return plan.count("from_json(ArrayType")


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_table_parses_each_line_once(stored):
    rows = parse.sightings_of(stored)
    for name in [*tables.LATEST_TABLES, *tables.DISTINCT_TABLES]:
        plan = optimized(parse.table(rows, name))
        assert parses(plan) == 1, name


def test_other_outputs_parse_once(stored):
    for df in (
        mining.mine_withheld(stored), parse.deleted_tweets(stored), flatten.everything(stored),
        flatten.type_stats(flatten.levels(stored)),
    ):
        assert parses(optimized(df)) == 1


def test_types_are_counted_without_decoding_users(stored):
    plan = optimized(flatten.type_stats(flatten.levels(stored, fields=flatten.TYPE_FIELDS)))
    assert "screen_name" not in plan and "profile" not in plan and parses(plan) == 1


def test_mining_has_no_shuffle(stored):
    assert "Exchange" not in physical(mining.mine_withheld(stored))


def test_the_carry_shuffles_the_lines_once(stored):
    df = mining.mine_messages(stored)
    df.collect()
    final = physical(df).split("== Initial Plan ==")[0]
    assert len(re.findall(r"ReusedExchange .*REPARTITION_BY_COL", final)) == 1
    assert final.count("Scan parquet") == 1


def test_latest_rows_are_cut_down_before_the_shuffle(stored):
    plan = physical(latest.latest_sighting(tables.tweet_metadata(parse.sightings_of(stored))))
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def test_no_nested_loops_and_no_unchecked_broadcast(spark):
    md = spark.range(10).selectExpr("id", "id AS linked_tweet", "id AS author_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(flags.flag_propagation(md, spark.range(5)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Broadcast" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("name", ["retweet_graph", "user_stats", "author_hashtag", "carry_forward_events", "toxic_documents"])
def test_registered_plans_have_no_cross_join(spark, name):
    plan = physical(all_queries()[name](spark, SF))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_lines_are_made_without_interpreted_lambdas(spark):
    rows = [(5, "2024-01-01 00:00:00", 7, "click"), (6, "2024-01-01 00:00:01", 7, None), (10, "2024-01-01 00:00:02", None, "purchase"), (12, None, 1, "error")]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string")
    made = message_lines(events.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    assert "lambda" not in optimized(made)
    found = {r.line: r.value for r in made.collect()}
    assert found[5].count('"retweeted_status":{') == 1 and found[5].count('"quoted_status":{') == 1
    assert found[6] is None and '"quoted_status":{' in found[10] and '"scrub_geo"' in found[12]


def test_code_that_the_jvm_would_not_compile_is_cut_up(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
