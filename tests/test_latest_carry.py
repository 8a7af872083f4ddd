import random

from pyspark.sql import functions as F

from archivemill.operators.carry import carry_forward, carry_in_order, carry_in_ranges
from archivemill.operators.latest import distinct_rows, latest_by_key


def rows(spark, n=600, seed=1):
    """A third of the rows belongs to one key."""
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.34 else rnd.choice("abcdef")
        data.append((key, i, rnd.choice([None, None, i])))
    return data, spark.createDataFrame(data, "k string, t int, x int").withColumn("c", F.floor(F.col("t") / 50))


def filled(data):
    last, out = {}, {}
    for key, t, x in data:
        last[key] = x if x is not None else last.get(key)
        out[key, t] = last[key]
    return out


def test_carry_matches_a_plain_loop(spark):
    data, df = rows(spark)
    expected = filled(data)
    for frame in (df, df.orderBy(F.rand(3))):
        for chunk in (None, "c"):
            got = carry_forward(frame, ["k"], ["t"], "x", "y", chunk=chunk).collect()
            assert {(r.k, r.t): r.y for r in got} == expected and len(got) == len(data)


def test_carry_across_many_empty_pieces(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 100, None), ("a", 200, None), ("b", 150, None)], "k string, t int, x int")
    got = carry_forward(df.withColumn("c", F.floor(F.col("t") / 10)), ["k"], ["t"], "x", "y", chunk="c")
    assert {(r.k, r.t): r.y for r in got.collect()} == {("a", 0): 5, ("a", 100): 5, ("a", 200): 5, ("b", 150): None}


def test_latest_keeps_one_row_per_key_and_is_idempotent(spark):
    data, df = rows(spark)
    order = [F.col("t").desc()]
    once = latest_by_key(df, ["k"], order)
    expected = {key: t for key, t, _ in data}
    assert {r.k: r.t for r in once.collect()} == expected
    assert sorted(latest_by_key(once, ["k"], order).collect()) == sorted(once.collect())


def test_distinct_is_idempotent(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (2, "a")], "a int, b string")
    once = distinct_rows(df)
    assert once.count() == 3 and distinct_rows(once).count() == 3


def test_carry_in_order_over_batches(spark):
    data, _ = rows(spark)
    data = sorted(data, key=lambda r: (r[0], r[1]))
    df = spark.createDataFrame(data, "k string, t int, x int").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = carry_in_order(df, "k", "x", "y").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.k, r.t): r.y for r in got} == filled(data)


def test_ranges_are_even_whatever_a_group_holds(spark):
    """One group has a value once and nothing for many ranges; another holds a third of the rows."""
    data, _ = rows(spark, n=3000)
    data += [("z", i, 7 if i == 3 else None) for i in range(2000)]
    data += [("zz", 0, None), ("zzz", 0, 1)]
    df = spark.createDataFrame(data, "k string, t int, x int").repartition(5)
    for n in (1, 7, 40):
        got = carry_in_ranges(df, ["k"], ["t"], "x", "y", partitions=n)
        assert {(r.k, r.t): r.y for r in got.collect()} == filled(data)
    sizes = df.repartitionByRange(40, "k", "t").groupBy(F.spark_partition_id()).count().agg({"count": "max"}).first()[0]
    assert sizes <= 3 * len(data) / 40


def test_ranges_with_null_keys_several_keys_and_clashing_types(spark):
    data = [(None, "a", i, 1.5 if i == 2 else None) for i in range(50)] + [(1, None, i, None) for i in range(50)]
    df = spark.createDataFrame(data, "a int, b string, t int, x double")
    got = carry_in_ranges(df, ["a", "b"], ["t"], "x", "y", partitions=9).collect()
    assert {(r.a, r.b, r.t): r.y for r in got} == {(a, b, t): 1.5 if b and t >= 2 else None for a, b, t, _ in data}
    assert carry_in_ranges(df.limit(0), ["a"], ["t"], "x", "y").collect() == []
    structs = df.select("a", "t", F.when(F.col("x").isNotNull(), F.struct("x", "b")).alias("s"))
    got = carry_in_ranges(structs, ["a"], ["t"], "s", "last", partitions=4).where("last is not null")
    assert got.count() == 48 and got.first()["last"].x == 1.5
