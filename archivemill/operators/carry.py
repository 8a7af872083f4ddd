"""Last observation carried forward."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivemill.plans.staging import staged


def carry_forward(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    col: str,
    out: str,
    *,
    chunk: str | None = None,
) -> DataFrame:
    """Add ``out``: the last non-null ``col`` up to and including the row, per ``by``.

    ``chunk`` names a column that rises with the order and cuts every group
    into bounded pieces.  The rows are then filled per piece, and
    only the last value of each piece crosses to the pieces behind it, so a group that
    holds a third of all rows is not worked on by one task.  Without ``chunk`` the
    groups must be small; ``carry_in_ranges`` needs neither.
    """
    so_far = (Window.unboundedPreceding, Window.currentRow)
    if chunk is None:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(*so_far)
        return df.withColumn(out, F.last(col, ignorenulls=True).over(w))

    piece = [*by, chunk]
    # One shuffle feeds both branches; `max_by` takes the whole row so that both
    # ask for the same columns and the exchange is reused.
    parts = df.repartition(*piece)
    w = Window.partitionBy(*piece).orderBy(*order).rowsBetween(*so_far)
    filled = parts.withColumn("_own", F.last(col, ignorenulls=True).over(w))

    rank = F.struct(*order)
    ends = parts.groupBy(*piece).agg(
        F.max_by(F.struct(*(F.col(c) for c in df.columns)), F.when(F.col(col).isNotNull(), rank)).alias("_end")
    )
    before = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *(F.col(c).alias(f"_k{i}") for i, c in enumerate(piece)),
        F.last(f"_end.{col}", ignorenulls=True).over(before).alias("_in"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(piece)]
    joined = filled.join(carried, same, "left")
    return joined.select(*df.columns, F.coalesce("_own", "_in").alias(out))


class _Fill:
    """The last value so far, over batches whose rows stand in order, group after group."""

    def __init__(self, by: Sequence[int], col: int):
        self.by, self.col = by, col
        self.group: tuple | None = None
        self.last = None

    def fill(self, batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
        """The filled column, and which rows begin a group."""
        n, values = batch.num_rows, batch.column(self.col)
        new = np.zeros(n, bool)
        for i in self.by:
            codes = batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        new[0] = self._key(batch, 0) != self.group
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        there = values.is_valid().to_numpy(zero_copy_only=False)
        seen = np.maximum.accumulate(np.where(there, np.arange(n), -1))
        found = values.take(pa.array(seen, mask=seen < start))
        early = (seen < start) & (start == 0) & ~new[0]  # before the batch's first value, in the group carried in
        if self.last is not None and early.any():
            both = pa.concat_arrays([values, pa.array([self.last], values.type)])
            found = both.take(pa.array(np.where(early, n, seen), mask=(seen < start) & ~early))
        self.group, self.last = self._key(batch, n - 1), found[n - 1].as_py()
        return found, new

    def _key(self, batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(i)[row].as_py() for i in self.by)


def carry_in_order(df: DataFrame, by: str, col: str, out: str) -> DataFrame:
    """``carry_forward`` for rows that stand in order already, each ``by`` within one partition.

    Lines of the archive do: a task reads a file from its first line to its last.
    Nothing is shuffled or sorted; a batch is filled at once.
    """
    names, kind = df.columns, df.schema[col].dataType
    key, value = names.index(by), names.index(col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = _Fill([key], value)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, filled.fill(batch)[0]], names=[*names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, kind)]))


def carry_in_ranges(
    df: DataFrame, by: Sequence[str], order: Sequence[str], col: str, out: str, partitions: int | None = None
) -> DataFrame:
    """``carry_forward`` for groups of any size: all rows are cut into even ranges of (``by``, ``order``).

    A task fills its range in order.  Of a range only the first group can lack a value that stands in ranges before it,
    and only the last group can have rows behind it; so the last value of each range crosses, one row a range,
    however many rows a group holds.  Rows equal in ``by`` and ``order`` stay in one range, in no fixed order.
    """
    names, kind = df.columns, df.schema[col].dataType
    place = T.StructType([
        *df.schema.fields, T.StructField("_range", T.IntegerType()), T.StructField(out, kind),
        T.StructField("_open", T.BooleanType()), T.StructField("_end", T.BooleanType()),
    ])
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *by, *order).sortWithinPartitions(*by, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, first, held = _Fill([names.index(c) for c in by], names.index(col)), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held
            found, new = filled.fill(batch)
            begun = np.cumsum(new) + (first or 0)
            first = int(begun[-1])
            open_ = (begun == 1) & found.is_null().to_numpy(zero_copy_only=False)
            held = pa.RecordBatch.from_arrays([*batch.columns, found, pa.array(open_), pa.array(np.zeros(len(new), bool))], schema=_named(batch, found, out))
        if held is not None:
            end = np.arange(held.num_rows) == held.num_rows - 1
            yield held.set_column(held.num_columns - 1, "_end", pa.array(end))

    rows = staged(ranged.withColumn("_range", F.spark_partition_id()).mapInArrow(run, place), "ranges")
    marks = rows.where("_end").select(*by, "_range", F.lit(1).alias("_kind"), F.col(out).alias("_value"))
    heads = rows.where("_open").select(*by, "_range").distinct()
    heads = heads.select(*by, "_range", F.lit(0).alias("_kind"), F.lit(None).cast(kind).alias("_value"))
    # At most two rows of each range.
    before = Window.partitionBy(*by).orderBy("_range", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.union(heads).withColumn("_in", F.last("_value", ignorenulls=True).over(before)).where("_kind = 0")
    carried = carried.select(F.col("_range").alias("_of"), "_in")
    joined = rows.join(F.broadcast(carried), F.col("_open") & (F.col("_range") == F.col("_of")), "left")
    return joined.select(*names, F.coalesce(out, "_in").alias(out))


def _named(batch: pa.RecordBatch, found: pa.Array, out: str) -> pa.Schema:
    return pa.schema([*batch.schema, pa.field(out, found.type), pa.field("_open", pa.bool_()), pa.field("_end", pa.bool_())])
