"""Structured Streaming forms of the event log, outbox, leases and rate limiter."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from siftline import workspace


#: Bytes of files in a micro-batch. The stateful forms sort a key's rows of one micro-batch, so this bounds what they hold.
BATCH_BYTES = 1 << 30


def read_table(spark: SparkSession, path: str, schema: StructType, max_bytes: int = BATCH_BYTES) -> DataFrame:
    """A Parquet table as a stream, be it a folder of files or one file, at most about max_bytes at a time."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes)
    if system.getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def tail(spark: SparkSession, path: str, schema: StructType, cursor: int = 0, sequence: str = "sequence_no", max_bytes: int = BATCH_BYTES) -> DataFrame:
    """Progress events whose sequence number is after the cursor, as files arrive."""
    return read_table(spark, path, schema, max_bytes).where(F.col(sequence) > cursor)


def follow(events: DataFrame, path: str, checkpoint: str, ended: Column, poll: str = "500 milliseconds") -> None:
    """Writes events to path, batch by batch, until a batch holds one that ends the job; that batch is written too.

    Each batch has its own folder below path, written anew if it is repeated, so nothing is
    there twice.
    """
    over = threading.Event()

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if not batch.where(ended).isEmpty():
            over.set()

    query = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=poll).start()
    try:
        while not over.is_set() and not query.awaitTermination(0.1):
            pass
    finally:
        query.stop()


class _Tail(StatefulProcessor):
    """One job's tail: the sequence number that its reader has, while the tail is open."""

    def __init__(self, ends: tuple[str, ...]):
        self.ends = ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "sequence_no long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.cursor.update((int(initialState["cursor"].iloc[0]),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.cursor.exists():
            return
        (cursor,) = self.cursor.get()
        new = pd.concat(list(rows))
        new = new[new["sequence_no"] > cursor].sort_values("sequence_no")
        over = new["event_type"].isin(self.ends).to_numpy()
        if over.any():
            new = new.iloc[: over.argmax() + 1]
            self.cursor.clear()
        elif len(new):
            self.cursor.update((int(new["sequence_no"].iloc[-1]),))
        if len(new):
            yield new[["job_id", "sequence_no", "event_type"]]

    def close(self) -> None:
        pass


def tails(events: DataFrame, cursors: DataFrame, ends: tuple[str, ...] = ("job_completed", "job_failed", "job_cancelled")) -> DataFrame:
    """job_id, sequence_no, event_type: the events of each job in `cursors` (job_id, cursor) after its cursor, up to the one that ends it.

    A job's tail closes with its own last event, while those of others go on; events of jobs
    without a cursor or with a closed tail are passed over, and what is at or before the cursor
    isn't told again. Events of a job come in the order of their numbers, across micro-batches. The state is a number for
    each open tail. Needs the RocksDB state store.
    """
    chosen = events.select("job_id", F.col("sequence_no").cast("long").alias("sequence_no"), "event_type")
    kind = chosen.schema["job_id"].dataType.simpleString()
    start = cursors.select(F.col("job_id").cast(kind).alias("job_id"), F.col("cursor").cast("long").alias("cursor")).groupBy("job_id")
    return chosen.groupBy("job_id").transformWithStateInPandas(
        _Tail(tuple(ends)), f"job_id {kind}, sequence_no long, event_type string", "append", "none", start
    )


def numbered(events: DataFrame) -> DataFrame:
    """job_id, id, sequence_no: each job's events numbered without a gap across micro-batches.

    The state is one counter per job. Within a micro-batch events go by occurred_at, id.
    """

    def number(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["occurred_at", "id"])
        last = state.get[0] if state.exists else 0
        state.update((last + len(rows),))
        yield pd.DataFrame({"job_id": key[0], "id": rows["id"].to_numpy(), "sequence_no": range(last + 1, last + 1 + len(rows))})

    chosen = events.select("job_id", "id", "occurred_at")
    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    out = f"job_id {kinds['job_id']}, id {kinds['id']}, sequence_no long"
    return chosen.groupBy("job_id").applyInPandasWithState(number, out, "last long", "append", GroupStateTimeout.NoTimeout)


def dispatched(outbox: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Commands once per operation_key within the watermark."""
    return outbox.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["operation_key"])


def rate_limited(hits: DataFrame, limit: int, seconds: int) -> DataFrame:
    """key, id, ts, allowed: a sliding window per key over admitted hits; the state holds their times (at most `limit`)."""

    def admit(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        held = list(state.get[0]) if state.exists else []
        allowed = []
        for t in rows["ts"]:
            now = t.value // 1000
            held = [x for x in held if x > now - seconds * 1_000_000]
            allowed.append(len(held) < limit)
            if allowed[-1]:
                held.append(now)
        state.update((held,))
        yield pd.DataFrame({"key": key[0], "id": rows["id"].to_numpy(), "ts": rows["ts"].to_numpy(), "allowed": allowed})

    chosen = hits.select("key", "id", "ts")
    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    out = f"key {kinds['key']}, id {kinds['id']}, ts {kinds['ts']}, allowed boolean"
    return chosen.groupBy("key").applyInPandasWithState(admit, out, "held array<long>", "append", GroupStateTimeout.NoTimeout)


def expiring_leases(leases: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """job_id, expired_at of leases that aren't renewed or released before event time passes their end.

    Input: job_id, at (event time), lease_expires_at (null: released). The state is one end
    per job, dropped when it is released or fires.
    """

    def watch(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (end,) = state.get
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "expired_at": [pd.Timestamp(end, unit="us")]})
            return
        rows = pd.concat(list(batches)).sort_values("at")
        end = rows["lease_expires_at"].iloc[-1]
        if pd.isna(end):
            if state.exists:
                state.remove()
        else:
            state.update((end.value // 1000,))
            state.setTimeoutTimestamp(max(end.value // 1_000_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [], "expired_at": []})

    chosen = leases.select("job_id", "at", "lease_expires_at").withWatermark("at", delay)
    kind = chosen.schema["job_id"].dataType.simpleString()
    return chosen.groupBy("job_id").applyInPandasWithState(
        watch, f"job_id {kind}, expired_at timestamp", "end long", "append", GroupStateTimeout.EventTimeTimeout
    )


def run_available(stream: DataFrame) -> DataFrame:
    """Process all that is there now into a table in the shared folder and return that as a batch table."""
    path = workspace.work_path(stream.sparkSession, "stream")
    write_available(stream, f"{path}/data", f"{path}/checkpoint")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def write_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that is there now into Parquet, exactly once under one checkpoint folder."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
