"""Incremental runs: new files of records are read as a stream, each key once, and appended batch by batch.

A batch that is retried is written again under the same number, so that readers of the committed batches see each row
once. What is known of a group of keys is one row of state, from which a timer drops each key when the watermark has
passed its horizon; rows older than the watermark are left out before, so state is bounded by the keys of one horizon.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups of keys by hash. A call of the state takes far longer than a row, so a group's keys share one row of it.
BUCKETS = 4096


class _FirstWithin(StatefulProcessor):
    """The least row of a batch by time and order, of each key, unless one was given less than the horizon before it."""

    def __init__(self, key: str, time: str, order: str, horizon_ms: int, kind: StructType):
        self.key, self.time, self.order, self.horizon, self.kind = key, time, order, horizon_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.given = handle.getValueState("given", f"keys array<{self.kind[self.key].dataType.simpleString()}>, at array<bigint>, timer bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  names of the interface
        held, timer = self._held()
        best: dict = {}
        for row in rows:  # one at a time, so that a key that fills the batch needs no memory
            name, at = row[self.key], _millis(row[self.time])
            if at is not None and (name not in held or at >= held[name] + self.horizon) and (name not in best or (at, row[self.order]) < best[name][0]):
                best[name] = ((at, row[self.order]), row)
        if best:
            self._keep(held | {name: at for name, ((at, _), _) in best.items()}, timer, timerValues)
        for _, row in best.values():
            yield Row(**{n: row[n] for n in self.kind.names})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self._keep(self._held()[0], None, timerValues)
        return iter(())

    def close(self) -> None:
        pass

    def _held(self) -> tuple[dict, int | None]:
        """When each key of the group was given, and the group's timer."""
        state = self.given.get()
        return (dict(zip(state[0], state[1], strict=True)), state[2]) if state else ({}, None)

    def _keep(self, held: dict, timer: int | None, timer_values) -> None:
        """Drops the keys whose horizon the watermark has passed; the timer goes off at the end of the next one's."""
        mark = timer_values.getCurrentWatermarkInMs()
        held = {name: at for name, at in held.items() if at + self.horizon > mark}
        due = min(held.values()) + self.horizon if held else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if held:
            self.given.update(([*held], [*held.values()], due))
        else:
            self.given.clear()


def _millis(at: datetime.datetime | None) -> int | None:
    return None if at is None else int(at.timestamp() * 1000)


def new_records(spark: SparkSession, folder: str, ddl: str, source: str = "json") -> DataFrame:
    """A stream of the records in a folder."""
    return spark.readStream.schema(ddl).format(source).load(folder)


def first_records(stream: DataFrame, key: str = "task_id", time: str = "ts", order: str = "event_id", horizon: datetime.timedelta = datetime.timedelta(days=7), late: str = "1 day") -> DataFrame:
    """The first record of each key: of a batch the one of least ``time`` and ``order``, if none was given within ``horizon`` before it.

    Records without key or time, and those more than ``late`` behind the latest of earlier batches, are left out.
    """
    rows = stream.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    kind = StructType(rows.schema.fields)
    grouped = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS))).groupBy("_bucket")
    return grouped.transformWithState(_FirstWithin(key, time, order, int(horizon.total_seconds() * 1000), kind), kind, "append", "eventTime")


def append_batches(stream: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Each batch, transformed, as a folder batch=N of JSON; stops when all that is there has been read."""

    def write(batch: DataFrame, number: int) -> None:
        (transform(batch) if transform else batch).write.mode("overwrite").json(f"{out}/batch={number}")

    return start(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True), stream.sparkSession)


def start(writer, spark: SparkSession) -> StreamingQuery:
    """Starts a query whose state lies in RocksDB, on disk, as state of one's own must."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.set(name, before)


def counts_by_window(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows of each key and window of event time; a window closes when the watermark has passed it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("begin"), key, "n")
