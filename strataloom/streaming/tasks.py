"""The fold of task events as a stream: one state per task, kept with transformWithStateInPandas.

State: status, attempt, token, last sign of life. Late events of an earlier claim are fenced
off; a running task without a sign of life for the lease is put back by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.tasks import LEASE_SECONDS, STATE_OF

OUT = "task_id string, status string, attempt bigint, token string, updated_at timestamp"
_STATE = "status string, attempt bigint, token string, updated_at timestamp"


def fold(rows: list[dict], state: dict | None) -> dict | None:
    """The state of a task after more events, in order."""
    for r in rows:
        event = r["event"]
        if event in ("HEARTBEAT", "PROGRESS", "COMPLETE", "FAIL") and not (state and state["status"] == "RUNNING" and state["token"] == r["token"]):
            continue
        s = state or {"status": None, "attempt": 0, "token": None, "updated_at": None}
        claim = event == "CLAIM"
        state = {"status": STATE_OF[event], "attempt": s["attempt"] + claim, "token": r["token"] if claim else s["token"], "updated_at": r["ts"]}
    return state


class TaskFold(StatefulProcessor):
    """``lease``: put a running task back when it shows no sign of life for so many seconds (0: never)."""

    def __init__(self, lease: int) -> None:
        self.lease = lease

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"]).to_dict("records")
        old = self.state.get() if self.state.exists() else None
        new = fold(events, dict(zip(("status", "attempt", "token", "updated_at"), old, strict=True)) if old else None)
        if new is not None:
            self.state.update((new["status"], int(new["attempt"]), new["token"], new["updated_at"]))
            if self.lease and new["status"] == "RUNNING":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.lease * 1000)
            yield pd.DataFrame({"task_id": [key[0]], **{k: [v] for k, v in new.items()}})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempt, token, at = self.state.get()
        if status == "RUNNING":
            self.state.update(("QUEUED", attempt, token, at))
            yield pd.DataFrame({"task_id": [key[0]], "status": ["QUEUED"], "attempt": [attempt], "token": [token], "updated_at": [at]})

    def close(self) -> None:
        pass


def stateful(events: DataFrame, lease: int = LEASE_SECONDS) -> DataFrame:
    """States after each batch of a stream of task events. Leases need a running clock: use 0 where a stream ends with its input."""
    return events.groupBy("task_id").transformWithStateInPandas(TaskFold(lease), OUT, "Update", "ProcessingTime" if lease else "None")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events of each type in tumbling windows; works on a stream (with its watermark) and on a table alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def run_available(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, transform, mode: str = "append") -> DataFrame:
    """Read the Parquet files of ``source`` as a stream, apply ``transform``, write all that is there, and return it."""
    stream = transform(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink)
