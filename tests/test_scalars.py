from pyspark.sql import functions as F

from archivemill.functions import scalars


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_created_at(spark):
    values = ["Wed Aug 27 13:08:45 +0000 2008", "Wed Aug 27 13:08:45 +0100 2008", "Thu Feb 29 00:00:00 +0000 2024",
              "Thu Feb 30 00:00:00 +0000 2024", "x", "", None]
    found = [v and str(v) for v in apply(spark, scalars.created_at_to_timestamp, values)]
    assert found == ["2008-08-27 13:08:45", None, "2024-02-29 00:00:00", None, None, None, None]


def test_epoch_millis(spark):
    found = apply(spark, scalars.epoch_ms_to_timestamp, ["1525266525999", "x", None])
    assert [v and str(v) for v in found] == ["2018-05-02 13:08:45", None, None]


def test_newlines(spark):
    assert apply(spark, scalars.clean_newlines, ["a\r\nb\nc\rd", None]) == ["a  b c d", None]
    assert apply(spark, scalars.clean_or_empty, [None, "\n"]) == ["", " "]


def test_client(spark):
    values = ['<a href="http://c/x" rel="n">Name</a>', "web", "w", "", None, "a>b", 'x"y']
    assert apply(spark, scalars.client_label, values) == ["Name", "web", "", "", "", "b", 'x"y']
    assert apply(spark, scalars.client_link, values) == ["http://c/x", "web", "", "", "", "a>b", "y"]


def test_host(spark):
    values = ["http://a.b:80/c//d", "https://a", "//x/y", "mailto:x", "a/b", "", None]
    assert apply(spark, scalars.url_host, values) == ["a.b:80", "a", "x", "", "", "", ""]


def test_path(spark):
    values = ["file:/x/2018/05/02/13/07.json.bz2"]
    assert apply(spark, scalars.path_date, values) == ["2018-05-02"]
    assert apply(spark, scalars.path_time, values) == ["2018-05-02 13:07:00"]
