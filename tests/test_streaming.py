"""The stream of task events gives what the batch fold gives."""

from pyspark.sql import functions as F

from strataloom.fixtures import Fixture
from strataloom.operators import tasks
from strataloom.plans.tasks import LOG as PATTERN
from strataloom.streaming import tasks as streaming

LOG = Fixture(PATTERN.schema, PATTERN.rows)


def test_fold_equals_batch(spark):
    rows = [{"event": r[2], "token": r[3], "ts": r[4], "event_id": r[1], "task": r[0]} for r in LOG.rows]
    got = {}
    for task in {r["task"] for r in rows}:
        s = streaming.fold([r for r in rows if r["task"] == task], None)
        got[task] = (s["status"], s["attempt"], s["token"])
    batch = tasks.state(LOG.frame(spark).withColumn("ts", F.col("moment").cast("timestamp_ntz"))).collect()
    assert got == {r["task_id"]: (r["status"], r["attempt"], r["token"]) for r in batch}


def test_windows_as_a_stream(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    table = spark.read.parquet(source)
    table.write.parquet(str(tmp_path / "in"))
    stream = streaming.run_available(spark, str(tmp_path / "in"), table.schema, str(tmp_path / "out"), str(tmp_path / "mark"), lambda e: streaming.windowed_counts(e))
    final = {(r["start"], r["event_type"]): r["n"] for r in stream.collect()}
    whole = {(r["start"], r["event_type"]): r["n"] for r in streaming.windowed_counts(spark.read.parquet(source)).collect()}
    assert final and all(whole[k] == n for k, n in final.items())


def test_stateful_stream_ends_in_the_batch_states(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = LOG.frame(spark).select("task_id", "event_id", "event", "token", F.col("moment").cast("timestamp").alias("ts"))
    source = str(tmp_path / "events")
    events.where("event_id <= 5").coalesce(1).write.parquet(source)
    events.where("event_id > 5").coalesce(1).write.mode("append").parquet(source)
    got = {}
    stream = streaming.stateful(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source), lease=0)

    def keep(batch, _):
        got.update({r["task_id"]: (r["status"], r["attempt"], r["token"]) for r in batch.collect()})

    stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    batch = tasks.state(LOG.frame(spark).withColumn("ts", F.col("moment").cast("timestamp_ntz"))).collect()
    assert got == {r["task_id"]: (r["status"], r["attempt"], r["token"]) for r in batch}
