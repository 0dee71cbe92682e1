"""Streams that end in tables: results of tasks under the token of their claim, and one active task for each plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

RESULT = "task_id string, token string, worker_id string, rule_version string, result string, completed_at timestamp, status string, progress_percent int, accepted boolean, batch bigint"


class ResultSink:
    """Writes the results that workers report, for ``foreachBatch``: each batch is a folder of its own that is written anew
    when the batch is repeated, so a restart changes nothing.

    A result is accepted if its token is that of the task's current claim and no earlier batch has accepted one for the
    task; of several in one batch the first in time. All others are kept as rejected. ``claims`` gives the claims that
    hold (task_id, status, token) when a batch is written. What was accepted is JSON text, whatever columns it had."""

    def __init__(self, path: str, claims: Callable[[], DataFrame]) -> None:
        self.path, self.claims = path.rstrip("/"), claims

    def __call__(self, batch: DataFrame, number: int) -> None:
        own = [c for c in batch.columns if c not in ("task_id", "token", "worker_id", "rule_version", "ts")]
        rows = batch.select("task_id", "token", "worker_id", "rule_version", F.to_json(F.struct(*own)).alias("result"), F.col("ts").alias("completed_at"))
        held = self.claims().where("status = 'RUNNING'").select("task_id", F.col("token").alias("_held"))
        before = self._read(batch.sparkSession).where((F.col("batch") < number) & F.col("accepted")).select("task_id", F.lit(True).alias("_done")).distinct()
        rows = rows.join(held, "task_id", "left").join(before, "task_id", "left")
        valid = F.coalesce(F.col("token") == F.col("_held"), F.lit(False)) & F.col("_done").isNull()
        first = F.min(F.when(valid, F.struct("completed_at", "result"))).over(_by_task())
        accepted = valid & (first == F.struct("completed_at", "result"))
        again = F.row_number().over(_by_task().orderBy(F.when(accepted, 0).otherwise(1), "completed_at", "result")) == 1
        rows = rows.withColumn("accepted", F.coalesce(accepted, F.lit(False)) & again)
        done = F.col("accepted")
        rows = rows.select("task_id", "token", "worker_id", "rule_version", "result", "completed_at", F.when(done, "COMPLETED").otherwise("REJECTED").alias("status"), F.when(done, 100).alias("progress_percent"), "accepted")
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def _read(self, spark: SparkSession) -> DataFrame:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.createDataFrame([], RESULT)
        return spark.read.schema(RESULT).parquet(self.path)

    def results(self, spark: SparkSession) -> DataFrame:
        """The accepted result of every task."""
        return self._read(spark).where("accepted").drop("accepted")

    def rejected(self, spark: SparkSession) -> DataFrame:
        """What was reported too late, under an older claim or twice."""
        return self._read(spark).where("NOT accepted").drop("accepted")


def _by_task():
    return Window.partitionBy("task_id")


# --- one active task for each plan ---------------------------------------------------------

ANSWER = "plan_id string, request_id string, task_request string, reused boolean, n_kept bigint"


class OneActive(StatefulProcessor):
    """Answers requests (event SUBMIT) with the plan's active task, or makes them the active one; END ends it.

    Tasks that have ended are kept in a list whose entries expire by themselves after ``keep`` days (None: never), as
    long as results are to be had; each answer tells how many there still are."""

    def __init__(self, keep: int | None) -> None:
        self.keep = keep

    def init(self, handle) -> None:
        ttl = self.keep * 86_400_000 if self.keep else None
        self.active = handle.getValueState("active", "request_id string")
        self.ended = handle.getListState("ended", "request_id string, ts timestamp", ttl) if ttl else handle.getListState("ended", "request_id string, ts timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        events = pd.concat(list(rows)).sort_values(["ts", "request_id"]).to_dict("records")
        now = self.active.get()[0] if self.active.exists() else None
        kept = sum(1 for _ in self.ended.get()) if self.ended.exists() else 0
        for e in events:
            if e["event"] == "END":
                if now == e["request_id"]:
                    self.ended.appendValue((now, e["ts"]))
                    now, kept = None, kept + 1
                continue
            reused = now is not None
            now = now if reused else e["request_id"]
            out.append((key[0], e["request_id"], now, reused, kept))
        if now is None:
            self.active.clear()
        else:
            self.active.update((now,))
        yield pd.DataFrame(out, columns=["plan_id", "request_id", "task_request", "reused", "n_kept"])

    def close(self) -> None:
        pass


def one_active(requests: DataFrame, keep: int | None = 30) -> DataFrame:
    """Answers to a stream of requests (plan_id, request_id, event, ts). Expiry needs a running clock: use None where a stream ends with its input."""
    return requests.groupBy("plan_id").transformWithStateInPandas(OneActive(keep), ANSWER, "Append", "ProcessingTime" if keep else "None")
