import json

from archivemill.operators import decode, flatten
from archivemill.plans import parse
from tests.messages import ABSENT, deletion, message


def routes(df):
    return [r.route for r in decode.routed(df).orderBy("line").collect()]


def test_one_object_per_line_is_decoded(lines):
    df = lines(
        '{"a": 1}', ' \t{"a": 2}  ', '{"a": 1', "[1]", "5", "", '{"a":1}{"b":2}', '{"a":1},{"b":2}',
        '{"a":1} x', '{"a": 1, "a": 2}', '[{"a": 1}]', '{"a": 1]} x', '{"a": 12345678901234567}',
    )
    rows = decode.decode(df, "a bigint").select("line", "v.a").orderBy("line").collect()
    assert [r.a for r in rows] == [1, 2, None, None, None, None, None, None, None, 2, None, None, 12345678901234567]


def test_presence_tells_absent_from_null(lines):
    df = decode.decode(lines({"k": None}, {"k": []}, {"k": ["TR"]}, {"j": 1}), "k variant")
    rows = df.select("line", "v.k").orderBy("line").collect()
    assert [r.k is not None for r in rows] == [True, True, True, False]


def test_first_notice_key_in_order_decides(lines):
    df = lines(
        deletion(), {"scrub_geo": {}, "limit": {}}, {"limit": {"track": 1}}, {"status_withheld": {}},
        {"limit": {}, "delete": {}}, {"status_withheld": {}, "limit": None}, message(),
        message(text=ABSENT, full_text="x"), message(text=None), {"id": 1}, {"text": "no id"}, "[]", "{",
    )
    assert routes(df) == [
        "delete", "scrub_geo", "limit", "status_withheld", "delete", "limit", "message", "message",
        "message", "reject", "message", "reject", "reject",
    ]


def test_rejects_carry_a_reason(lines):
    df = lines(
        "{", "[]", {"id": 1}, {"text": "no id", "user": {"id": 1}}, message(2, user=None), message(3),
        message(4, retweeted_status={"id": 9, "text": "t"}), deletion(),
    )
    rows = flatten.rejects(flatten.everything(df)).orderBy("line", "value").collect()
    assert [(r.line, r.reason) for r in rows] == [
        (0, "bad_json"), (1, "not_object"), (2, "no_text"), (3, "incomplete"), (4, "incomplete"),
        (6, "incomplete"),
    ]
    assert json.loads(rows[5].value) == {"id": 9, "text": "t"}


def test_deletions(lines):
    df = lines(deletion(5, 7, "1525266525999"), deletion(5, 7, "1525266525999"), deletion(6, 8, 1525266526000))
    rows = parse.deleted_tweets(df).orderBy("id").collect()
    assert [(r.id, r.author_id, r.timestamp_ms, str(r.deletion_time)) for r in rows] == [
        (5, 7, 1525266525999, "2018-05-02 13:08:45"),
        (6, 8, 1525266526000, "2018-05-02 13:08:46"),
    ]


def test_notices_are_kept_raw(lines):
    text = '{"status_withheld": {"id": 1},  "x": 2}'
    assert [r.value for r in decode.status_withheld_notices(lines(text, message())).collect()] == [text]


def test_counts_probe(lines):
    full, bare = message(), message(reply_count=ABSENT)
    odd = message(in_reply_to_status_id=ABSENT)
    assert tuple(decode.counts_probe(lines(bare, bare, odd)).first()) == (0, 2, 1, True)
    assert tuple(decode.counts_probe(lines(full, bare, deletion())).first()) == (1, 1, 0, False)


def test_type_priority(lines):
    other = message(9)
    df = lines(
        message(1), message(2, in_reply_to_status_id=5), message(3, quoted_status=other),
        message(4, quoted_status=other, in_reply_to_status_id=5),
        message(5, retweeted_status=other, quoted_status=other),
        message(6, retweeted_status=None, quoted_status=None),
        message(7, in_reply_to_status_id=ABSENT),
    )
    rows = flatten.levels(df).filter("depth = 0").orderBy("line").collect()
    assert [r.tweet_type for r in rows] == ["tweet", "reply", "quote", "quote", "retweet", "tweet", "tweet"]


def test_a_run_finds_out_about_counts_itself(lines, tmp_path):
    bare = {k: v for k, v in message(1).items() if k not in ("reply_count", "quote_count")}
    bare["in_reply_to_status_id"] = None
    for name, wanted in (("bare", False), ("full", True)):
        found = lines(bare if name == "bare" else message(2, in_reply_to_status_id=None, reply_count=1, quote_count=2))
        parse.run_parse(found, str(tmp_path / name), timeline=None, views=False)
        stored = found.sparkSession.read.parquet(str(tmp_path / name / "tweet_metadata"))
        assert ("quote_count" in stored.columns) == wanted
