"""Connected components of an edge table, by the least label among neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivemill.llm.shared import staged

#: Rows of one key from which the key is looked up apart, and the most such keys that are broadcast.
HUB = 500
MOST_HUBS = 100_000


def looked_up(rows: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """``rows`` joined with the one row of ``table`` for their key.

    Keys with many rows are hubs: their rows of the table go to the tasks, so that no task gets all rows
    of a hub.  A hub has at least ``HUB`` rows, so hubs are few; above ``MOST_HUBS``
    the whole join is left to the session's handling of skew.
    """
    hubs = staged(rows.groupBy(key).count().where(F.col("count") >= HUB).select(F.col(key).alias("_hub")), "hubs")
    if not 0 < hubs.count() <= MOST_HUBS:
        return rows.join(table, rows[key] == table[table_key])
    few = table.join(F.broadcast(hubs), table[table_key] == hubs["_hub"], "left_semi")
    rest = rows.join(F.broadcast(hubs), rows[key] == hubs["_hub"], "left_anti")
    return rows.join(F.broadcast(few), rows[key] == few[table_key]).unionByName(rest.join(table, rest[key] == table[table_key]))


def components(edges: DataFrame) -> DataFrame:
    """``edges``: columns a and b.  Returns every vertex once: v, and root, the least vertex it is connected to.

    Each round takes the least label of the neighbours and then that label's own label, so
    the rounds grow with the logarithm of the longest path for the usual shapes.  Labels are
    written to the shared folder each round; nothing but counts reach the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = staged(both.where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("root")), "labels")
    while True:
        heard = looked_up(both, "b", labels, "v").groupBy("a").agg(F.min("root").alias("least"))
        lower = labels.join(heard, labels["v"] == heard["a"]).select("v", "root", F.least("root", "least").alias("new"))
        lower = staged(lower, "heard")
        up = labels.select(F.col("v").alias("of"), F.col("root").alias("up"))
        jumped = looked_up(lower, "new", up, "of").select("v", F.col("root").alias("old"), F.least("new", "up").alias("root"))
        after = staged(jumped, "labels")
        if after.where(F.col("old") != F.col("root")).isEmpty():
            return after.select("v", "root")
        labels = after.select("v", "root")
