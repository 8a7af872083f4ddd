import json

from archivemill.operators.mining import as_json, mine, mine_messages, mine_withheld
from tests.conftest import FILE
from tests.messages import ABSENT, CREATED, message, user

HELD = {"withheld_in_countries": ["TR"]}


def hits(df):
    return sorted((r.line, r.kind, r.linked) for r in mine_withheld(df).collect())


def test_presence_counts_even_when_null_or_empty(lines):
    df = lines(
        message(1), message(2, withheld_in_countries=None), message(3, withheld_in_countries=[]),
        message(4, **HELD), message(5, user=user(7, **HELD)), message(6, user=user(7, withheld_in_countries=None)),
    )
    assert hits(df) == [(1, "tweets", "no"), (2, "tweets", "no"), (3, "tweets", "no"), (4, "users", "no"), (5, "users", "no")]


def test_every_reason_is_one_row(lines):
    both = message(2, user=user(8, **HELD), **HELD)
    df = lines(message(1, user=user(7, **HELD), retweeted_status=both, **HELD))
    assert hits(df) == [
        (0, "tweets", "no"), (0, "tweets", "retweeted"), (0, "users", "no"), (0, "users", "retweeted")
    ]


def test_quote_only_without_a_usable_repeat(lines):
    held = message(2, user=user(8, **HELD), **HELD)
    quoted = [("tweets", "quoted"), ("users", "quoted")]
    df = lines(
        message(1, quoted_status=held),
        message(1, quoted_status=held, retweeted_status=message(3)),
        message(1, quoted_status=held, retweeted_status=None),
        message(1, quoted_status=held, retweeted_status=message(3, user=None)),
        message(1, quoted_status=held, retweeted_status=message(3, user=ABSENT, **HELD)),
        message(1, quoted_status=None),
    )
    expected = [(i, *q) for i in (0, 2, 3, 4) for q in quoted] + [(4, "tweets", "retweeted")]
    assert hits(df) == sorted(expected)


def test_five_rows_at_most(lines):
    held = message(2, user=user(8, **HELD), **HELD)
    bare = message(3, user=ABSENT, **HELD)
    df = lines(message(1, user=user(7, **HELD), quoted_status=held, retweeted_status=bare, **HELD))
    assert len(hits(df)) == 5


def test_undated_messages_take_the_time_before_them(lines):
    later = CREATED.replace("13:08:45", "13:09:00")
    df = lines(
        {"id": 1, **HELD}, message(2), "{broken", {"id": 3, **HELD}, {"delete": {}}, {"id": 4, "withheld_in_countries": None},
        message(5, created_at=later), {"id": 6, **HELD}, {"id": 7}, message(8, created_at=None), {"id": 9, **HELD},
    )
    rows = mine_messages(df).orderBy("line").collect()
    assert [(r.line, r.approx_time) for r in rows] == [
        (0, "2018-05-02 13:07:00"), (3, CREATED), (5, CREATED), (7, later), (10, None)
    ]
    assert {r.date for r in rows} == {"2018-05-02"}


def test_time_is_not_taken_from_another_file(lines):
    first = lines(message(1))
    other = FILE.replace("07.json", "08.json")
    second = lines({"id": 2, **HELD}, file=other)
    assert [r.approx_time for r in mine_messages(first.union(second)).collect()] == ["2018-05-02 13:08:00"]


def test_time_crosses_the_blocks_of_a_file(lines):
    df = lines(message(1)).union(lines(message(2, text="x"), block=10)).union(lines({"id": 3, **HELD}, block=20))
    assert [r.approx_time for r in mine_messages(df).collect()] == [CREATED]


def test_one_pass_gives_the_same_rows(lines):
    df = lines(message(1, **HELD), {"id": 3, **HELD}, message(4, quoted_status=message(5, **HELD)), message(6))
    rows = mine(df).collect()
    assert sorted((r.line, r.kind, r.linked) for r in rows if r.kind != "messages") == hits(df)
    assert [(r.line, r.approx_time) for r in rows if r.kind == "messages"] == [(1, CREATED)]


def test_json_with_added_fields(lines):
    df = lines(message(1, **HELD), '{"id": 3, "note": "a\\"}", "withheld_in_countries": null}  ')
    values = {r.kind: r.value for r in as_json(mine(df)).collect()}
    assert json.loads(values["tweets"]) == {**message(1, **HELD), "linked": "no"}
    assert json.loads(values["messages"]) == {
        "id": 3, "note": 'a"}', "withheld_in_countries": None, "approx_time": CREATED
    }


def test_added_fields_keep_the_line_valid(lines):
    """A null time, and a line that ends in a tab."""
    df = lines(message(8, created_at=None), {"id": 9, **HELD}, json.dumps(message(1, **HELD)) + "\t \r")
    values = {r.kind: json.loads(r.value) for r in as_json(mine(df)).collect()}
    assert values["messages"] == {"id": 9, **HELD, "approx_time": None}
    assert values["tweets"]["linked"] == "no"


def test_lines_in_order_need_no_shuffle(spark, lines):
    rows = [message(1), {"id": 2, **HELD}, message(3, created_at=None), {"id": 4, **HELD}] + [message(i, **HELD) for i in range(5, 30)]
    other = FILE.replace("07.json", "08.json")
    df = lines(*rows, {"id": 40, **HELD}).coalesce(1).union(lines({"id": 50, **HELD}, message(51), {"id": 52, **HELD}, file=other)).coalesce(1)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = mine(df, in_order=True)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, found.collect())) == sorted(map(str, mine(df).collect()))
    finally:
        df.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
