import datetime as dt
import random

from pyspark.sql import functions as F

from archivemill.operators.latest import distinct_rows, latest_by_key
from archivemill.plans.store import parse_more, read_current, read_view
from archivemill.plans.views import VIEWS
from archivemill.schema import TABLES
from archivemill.streaming.latest import distinct_changes, latest_changes, stream_changes, stream_tables
from tests.conftest import LINE_SCHEMA
from tests.messages import message

START = dt.datetime(2018, 5, 2, 13)
SCHEMA = "id bigint, at timestamp, name string, n int"
ORDER = [("at", True), ("name", True), ("n", True)]


def rows(*found):
    """``(id, minutes or None, name, n)`` as rows."""
    return [(i, None if m is None else START + dt.timedelta(minutes=m), name, n) for i, m, name, n in found]


class Source:
    """Files that a stream reads, one a batch, in the order they were put there."""

    def __init__(self, spark, path, schema=SCHEMA):
        self.spark, self.path, self.schema = spark, str(path / "in"), schema

    def put(self, found):
        self.spark.createDataFrame(found, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)

    def batch(self):
        return self.spark.read.schema(self.schema).parquet(self.path)


def texts(df):
    return sorted(map(str, df.collect()))


def test_late_and_repeated_rows_leave_the_latest(spark, tmp_path):
    source, out, state = Source(spark, tmp_path), str(tmp_path / "out"), str(tmp_path / "state")
    key = [F.col(c).desc_nulls_last() for c, _ in ORDER]

    def step(*found):
        source.put(rows(*found))
        stream_changes(latest_changes(source.stream(), ["id"], ORDER), out, state).awaitTermination()
        written = spark.read.schema(SCHEMA).parquet(out)
        assert texts(latest_by_key(written, ["id"], key)) == texts(latest_by_key(source.batch(), ["id"], key))
        return written.count()

    assert step((1, 5, "a", 1), (1, 9, "b", 1), (2, None, "c", 1), (None, 3, "d", 1)) == 3, "one row a key"
    assert step((1, 9, "b", 1), (1, 2, "z", 1), (2, None, None, 7), (None, 3, "d", 1)) == 3, "late and repeated rows change nothing"
    assert step((1, 9, "b", 2), (2, 1, None, None), (3, 1, "é", 1), (3, 1, "z", 1)) == 6, "equal times go on to the next column"


def test_rows_are_distinct_and_no_late_row_is_lost(spark, tmp_path):
    source, out, state = Source(spark, tmp_path), str(tmp_path / "out"), str(tmp_path / "state")
    pick = random.Random(3)
    found = [(pick.randrange(4), m + pick.randrange(20), pick.choice("ab"), None) for m in range(0, 200, 2)]
    steps = [found[:40], found[40:] + found[20:60], [*found[:10], (7, 1, "new and late", 1)], [(8, None, "no time", 1)] * 2]
    for step in steps:
        source.put(rows(*step))
        stream_changes(distinct_changes(source.stream(), "at", "10 minutes"), out, state).awaitTermination()
    written = spark.read.parquet(out)
    assert texts(distinct_rows(written.drop("late"))) == texts(distinct_rows(source.batch()))
    on_time = written.where("NOT late")
    assert on_time.count() == on_time.distinct().count(), "what is not late comes out once"
    assert {r.name for r in written.where("late").collect()} >= {"new and late", "no time"}
    assert written.where("name = 'no time'").count() == 1


def test_state_is_let_go_behind_the_watermark(spark, tmp_path):
    source, out, state = Source(spark, tmp_path), str(tmp_path / "out"), str(tmp_path / "state")
    held = []
    for start in range(0, 300, 100):
        source.put(rows(*((i, start + i, "a", 1) for i in range(50))))
        query = stream_changes(distinct_changes(source.stream(), "at", "1 minute"), out, state)
        query.awaitTermination()
        held.append(sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]))
    assert max(held) < 3 * 100, "a batch's rows, their timers and the timers' order; not those of all batches"
    assert spark.read.parquet(out).where("NOT late").count() == 150


def test_a_stream_of_lines_keeps_up_the_tables(spark, lines, tmp_path):
    source = Source(spark, tmp_path, LINE_SCHEMA)
    whole = lines(*(message(i % 7 + 1, user={"id": i % 3, "followers_count": i}) for i in range(30)), "broken", {"id": 4}).collect()
    folder, state = str(tmp_path / "store"), str(tmp_path / "state")
    for part in (whole[20:], whole[:20], whole[10:25], []):
        source.put([tuple(r) for r in part])
        stream_tables(source.stream(), folder, state, buckets=2).awaitTermination()
    parse_more(spark.createDataFrame(whole, LINE_SCHEMA), str(tmp_path / "once"), buckets=2)
    for name in TABLES:
        assert texts(read_current(spark, folder, name)) == texts(read_current(spark, str(tmp_path / "once"), name)), name
    for name in VIEWS:
        assert texts(read_view(spark, folder, name)) == texts(read_view(spark, str(tmp_path / "once"), name)), name
