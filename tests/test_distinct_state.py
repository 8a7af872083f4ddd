"""The state of distinct rows: few values, however many rows."""

import datetime as dt

from archivemill.streaming import latest
from archivemill.streaming.latest import distinct_changes, stream_changes

SCHEMA = "id bigint, at timestamp, x double"


def test_rows_of_an_hour_share_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(latest, "_PARTS", 4)
    at = dt.datetime(2018, 5, 2, 13)
    rows = [(i, at + dt.timedelta(seconds=i), x) for i in range(300) for x in (0.0, None)]
    rows += [(i, t, -0.0 if x == 0 else x) for i, t, x in rows]  # all repeated; zeros are equal
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[::2] + rows[:50], rows[1::2] + rows[20:60]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        query = stream_changes(distinct_changes(stream, "at", "1 day"), out, str(tmp_path / "state"))
        query.awaitTermination()
    found = spark.read.parquet(out)
    assert found.count() == 600 and found.distinct().count() == 600 and found.where("late").isEmpty()
    assert sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"]) <= 3 * 4
