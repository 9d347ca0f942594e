"""Preferences and statuses kept up to date by Structured Streaming; both end where the batch plans do.

Streams write what has changed, in update mode, as one folder for each micro-batch: a batch that is run again overwrites
its own folder with the same rows, and a reader takes the last row of each key up to the batch it was told of. The files
of a batch appear when its job commits, so that no reader sees half of one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodefinder.operators import preference
from lodefinder.session import fresh_path
from lodefinder.sources import tables


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files. Written as a pattern, as the table may be one file or a folder of them."""
    schema = tables.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/[e]vents.parquet")


class Changes:
    """A folder of changes, one folder for each batch, and the newest state of each key that they lead to."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path, keys

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch. A batch that comes again, after a failure between its write and its commit, changes nothing."""
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, schema, upto: int | None = None) -> DataFrame:
        """The state after all batches, or after batch upto: a snapshot that later batches do not touch."""
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(self.path)
        rows = rows if upto is None else rows.filter(F.col("batch") <= upto)
        others = [c for c in rows.columns if c not in (*self.keys, "batch")]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "batch").alias("last"))
        return last.select(*self.keys, *(F.col(f"last.{c}").alias(c) for c in others))


def run(stream: DataFrame, changes: Changes, marks: str) -> None:
    """Take in all that has come since the last run, whose place the folder marks keeps."""
    query = stream.writeStream.outputMode("update").foreachBatch(changes.write).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()


def drained(stream: DataFrame, spark: SparkSession, name: str, keys: list[str]) -> DataFrame:
    """Run a stream over all there is, and read the state it leaves in the shared folder."""
    changes = Changes(spark, fresh_path(spark, name), keys)
    run(stream, changes, fresh_path(spark, f"{name}-checkpoint"))
    return changes.read(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long")


def weighed_stream(acts: DataFrame, attributes: DataFrame) -> DataFrame:
    """Counters by user, dimension and key from a stream of actions; the attributes are a table."""
    weighed = acts.withColumn("w", preference.weight_of(F.col("action"))).filter("w IS NOT NULL")
    return weighed.join(attributes, "entity_id").groupBy("user_id", "dim", "key").agg(F.sum("w").cast("double").alias("weight"))


def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference counters by user, dimension and key: a stream of actions joined to the static attributes."""
    made = weighed_stream(tables.actions(event_stream(spark, sf_dir)), tables.attributes(spark, sf_dir))
    return drained(made, spark, "counters", ["user_id", "dim", "key"])


class StatusMachine(StatefulProcessor):
    """The status of one user's track: the last save or rejection and the last analysis, whatever order events come in.

    idle_ms is for how long a track without events keeps its state; None keeps it for good. After that its next event
    starts anew, which is what a bounded store can promise.
    """

    def __init__(self, idle_ms: int | None = None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = "hard_action string, hard_ts long, hard_event long, soft_ts long, soft_event long, status string"
        self.state = handle.getValueState("last", schema, self.idle_ms) if self.idle_ms else handle.getValueState("last", schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get() if self.state.exists() else (None,) * 6
        action, hard, soft = before[0], before[1:3], before[3:5]
        for batch in rows:
            for ts, event, what in zip(batch["ts"].tolist(), batch["event_id"].tolist(), batch["action"].tolist(), strict=True):
                if what in ("save", "reject") and (hard[0] is None or (ts, event) > hard):
                    action, hard = what, (ts, event)
                elif what == "analyze" and (soft[0] is None or (ts, event) > soft):
                    soft = (ts, event)
        analysed = soft[0] is not None and (hard[0] is None or soft > hard)
        status = "saved" if action == "save" else "analyzed" if analysed else "rejected" if action == "reject" else "seen"
        self.state.update((action, *hard, *soft, status))
        if status != before[5]:  # only what has changed leaves
            yield pd.DataFrame({"user_id": [key[0]], "entity_id": [key[1]], "status": [status]})

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession):
    """The state store outside the heap, which state machines need, for streams that start meanwhile."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def status_stream(acts: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(user_id, entity_id, status) each time a track gets actions, from a stream of actions with user and track.

    Without idle_ms it is the fold of the batch plan as a streaming aggregation: the two maxima of each track are its
    state. With it, state expires track by track and the machine runs in Python, which costs calls for each track.
    """
    acts = acts.filter("user_id IS NOT NULL AND entity_id IS NOT NULL")
    if not idle_ms:
        return preference.statuses(acts)
    keyed = acts.select("user_id", "entity_id", "action", F.unix_micros("ts").alias("ts"), "event_id")
    return keyed.groupBy("user_id", "entity_id").transformWithStateInPandas(StatusMachine(idle_ms), "user_id long, entity_id long, status string", "Update", "ProcessingTime")


def stream_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses from a stream of actions."""
    with rocks(spark):
        return drained(status_stream(tables.actions(event_stream(spark, sf_dir))), spark, "statuses", ["user_id", "entity_id"])


def windowed_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of each kind by day. Days older than the watermark of one day leave the state; what they came to stays written."""
    acts = tables.actions(event_stream(spark, sf_dir)).withWatermark("ts", "1 day")
    days = acts.groupBy(F.window("ts", "1 day").alias("w"), "action").agg(F.count("*").alias("n"))
    made = days.select(F.col("w.start").cast("date").cast("string").alias("day"), "action", "n")
    return drained(made, spark, "activity", ["day", "action"])


STREAMS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"stream_affinity": stream_counters, "stream_status": stream_statuses, "stream_activity": windowed_activity}
