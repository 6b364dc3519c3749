"""Streams: waiting for all parts of a request, sinks, pacing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "node string, request_id long, n_parts int, num_parts int, status string"
STATE = "parts array<int>, num_parts int"


def awaited(parts: DataFrame, timeout_ms: int = 5000) -> DataFrame:
    """One row for each (node, request_id) once all its parts have come, or `expired` when they haven't within the time.

    parts: (node, request_id, part_id, num_parts). A part that comes twice counts once. The key holds the node, so
    that nested splits wait for one another. State goes as soon as a request is complete or has expired.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, wanted = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, len(held), wanted, "expired")], columns=["node", "request_id", "n_parts", "num_parts", "status"])
            return
        for frame in frames:
            held += [int(p) for p in frame["part_id"].drop_duplicates() if int(p) not in held]
            wanted = max(wanted, int(frame["num_parts"].max()))
        if len(held) >= wanted:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(*key, len(held), wanted, "complete")], columns=["node", "request_id", "n_parts", "num_parts", "status"])
        else:
            state.update((held, wanted))
            state.setTimeoutDuration(timeout_ms)

    return parts.groupBy("node", "request_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


class TrainOnFlush:
    """For foreachBatch over train requests (with a column `flush`): rows are added to a table, and a flush fits a model to all of them.

    A batch that is repeated after a failure replaces what it wrote before. `status` is pending until the first flush, then success.
    """

    def __init__(self, path: str, fit: Callable[[DataFrame], object]) -> None:
        self.path, self.fit, self.model, self.status = path.rstrip("/"), fit, None, "pending"

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.where("not flush").drop("flush").write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        if not batch.where("flush").isEmpty():
            self.model = self.fit(batch.sparkSession.read.parquet(self.path).drop("batch"))
            self.status = "success"


def file_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they come, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append_sink(stream: DataFrame, path: str, checkpoint: str, seconds: int | None = 5):  # noqa: ANN201
    """Appends a stream to Parquet, with a snapshot every so many seconds; None takes what is there and ends."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, event_type, n) by tumbling window of event time."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
