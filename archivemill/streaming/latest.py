"""Latest row per key and distinct rows of a stream: state per key, and only what is new comes out.

Both give rows to append.  What they have given out so far, folded once more by ``latest_by_key`` or
``distinct_rows``, is what these give over all rows in one run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType, TimestampType

from archivemill.plans.store import parse_more

#: State lies in files beside the checkpoint, as more keys come than memory holds.
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_LATE = "late"


def _with_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def _times(schema: StructType) -> set[str]:
    return {f.name for f in schema if isinstance(f.dataType, TimestampType)}


def _plain(rows: DataFrame) -> DataFrame:
    """Times as microseconds: no Python worker's time zone takes part."""
    times = _times(rows.schema)
    return rows.select(*(F.unix_micros(c).alias(c) if c in times else F.col(c) for c in rows.columns))


def _typed(rows: DataFrame, schema: StructType) -> DataFrame:
    times = _times(schema)
    return rows.select(*(F.timestamp_micros(c).alias(c) if c in times else F.col(c) for c in rows.columns))


class _Latest(StatefulProcessor):
    """Keeps the row that comes first, and gives it out when that changes."""

    def __init__(self, schema: StructType, order: Sequence[tuple[int, bool]]):
        self.schema, self.order = schema, list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", self.schema)

    def _before(self, row, other) -> bool:
        for place, descending in self.order:
            a, b = row[place], other[place]
            if a == b:
                continue
            if a is None or b is None:
                return b is None  # nulls last
            return (a > b) == descending
        return False

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        stored = self.row.get() if self.row.exists() else None
        best = None
        for row in rows:
            if best is None or self._before(row, best):
                best = row
        if stored is None or self._before(best, stored):
            self.row.update(tuple(best))
            yield best

    def close(self) -> None:
        """Nothing is open."""


def latest_changes(rows: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """The rows of a stream that come before all earlier ones of their key.

    ``order``: columns and whether the greater value comes first; nulls come last.  It should tell the rows of a key
    apart, else of equal ones the first to arrive stays.  A batch gives at most one row a key, and none where
    a late or repeated row changes nothing.  The state holds one row a key.
    """
    _with_state(rows.sparkSession)
    place = {name: i for i, name in enumerate(rows.columns)}
    plain = _plain(rows)
    processor = _Latest(plain.schema, [(place[c], descending) for c, descending in order])
    found = plain.groupBy(*keys).transformWithState(processor, plain.schema, outputMode="Append", timeMode="None")
    return _typed(found, rows.schema)


#: Rows share a state by the span of time they lie in, and within it by their hash.
_SPAN_MS = 60 * 60 * 1000
_PARTS = 64
_DIGEST = 16


class _Distinct(StatefulProcessor):
    """Knows the rows of a span of time and a part of the hashes, until the watermark has passed the span.

    A row is known by 128 bits of a cryptographic hash: rows of a billion share them with a chance of 1e-21.
    """

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "digests binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        held = bytes(self.seen.get()[0]) if self.seen.exists() else b""
        known = {held[i : i + _DIGEST] for i in range(0, len(held), _DIGEST)}
        passed, fresh, end = timerValues.getCurrentWatermarkInMs(), [], None
        for row in rows:
            values = [row[c] for c in self.columns]
            text = repr([v + 0.0 if isinstance(v, float) else v for v in values])  # a zero has no sign
            digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=_DIGEST).digest()
            if digest in known:
                continue
            known.add(digest)
            at = row["_at"]
            late = at is None or at <= passed  # its timer may have gone off
            if not late:
                fresh.append(digest)
                end = (at // _SPAN_MS + 1) * _SPAN_MS - 1
            yield Row(**dict(zip(self.columns, values, strict=True)), **{_LATE: late})
        if fresh:
            if not held:
                self.handle.registerTimer(end)
            self.seen.update((held + b"".join(fresh),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        """Nothing is open."""


def distinct_changes(rows: DataFrame, time: str, delay: str) -> DataFrame:
    """The rows of a stream without repeats, and ``late``: whether a row may be a repeat after all.

    A row is remembered until the watermark, ``delay`` behind the latest ``time``, passes the hour of its time, so the state
    follows the rows of that span: 16 bytes a row, one value for each hour and part of the hashes.  No row is lost for being later than that, or for having no time: it comes out as ``late``, once a
    batch, and is to be compared with what is stored; all others come out once.
    """
    _with_state(rows.sparkSession)
    columns = rows.columns
    # The watermark is taken from a copy of the time: by the column itself Spark would drop the late rows.
    at = F.col(time).cast("timestamp")
    timed = rows.withColumn("_at", F.unix_millis(at)).withColumn("_clock", at + F.expr("INTERVAL 0 SECOND"))
    watched = _plain(timed.withWatermark("_clock", delay).select(*columns, "_at"))
    schema = StructType([*(StructField(c, watched.schema[c].dataType) for c in columns), StructField(_LATE, BooleanType())])
    dealt = watched.withColumn("_slot", F.floor(F.col("_at") / _SPAN_MS)).withColumn("_part", F.pmod(F.xxhash64(*columns), F.lit(_PARTS)))
    found = dealt.groupBy("_slot", "_part").transformWithState(_Distinct(columns), schema, outputMode="Append", timeMode="EventTime")
    return _typed(found, rows.schema)


def stream_changes(changes: DataFrame, folder: str, checkpoint: str):
    """A started stream that appends what changes to a Parquet folder, each batch once, then stops."""
    return (
        changes.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def stream_tables(lines: DataFrame, folder: str, checkpoint: str, **options):
    """A started stream of lines that keeps up the tables and views of a store, then stops.

    Every batch is one run of ``parse_more``: a batch that is repeated after a failure, and lines that come late or
    twice, change nothing, so no state is kept besides the store.
    """

    def fold(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            parse_more(batch, folder, **options)

    return lines.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
