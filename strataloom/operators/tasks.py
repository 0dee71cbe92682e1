"""Task histories as event logs: current state, leases and fencing, pages, retention.

An event has plan_id, task_id, event (ENQUEUE, CLAIM, HEARTBEAT, PROGRESS, COMPLETE, FAIL,
CANCEL, REQUEUE), token and ts; event_id breaks ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The state that each event leads to, how far a stage has come, and the spans of retention in days.
STATE_OF = {"ENQUEUE": "QUEUED", "CLAIM": "RUNNING", "HEARTBEAT": "RUNNING", "PROGRESS": "RUNNING", "COMPLETE": "COMPLETED", "FAIL": "FAILED", "CANCEL": "CANCELLED", "REQUEUE": "QUEUED"}
STAGE_PROGRESS = {"DOWNLOAD": 5, "PARSE": 15, "OCR": 35, "SEGMENT": 75, "PERSIST": 95, "DONE": 100}
RETENTION_DAYS = {"COMPLETED": 30, "FAILED": 7, "CANCELLED": 7}
LEASE_SECONDS = 300


def _lookup(pairs: dict, c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[c]


def from_activity(events: DataFrame) -> DataFrame:
    """The shipped activity table read as a task log: a user is a plan, each run of its events from one ``signup`` or ``purchase`` on a task."""
    kinds = {"signup": "ENQUEUE", "click": "CLAIM", "view": "HEARTBEAT", "purchase": "COMPLETE", "error": "FAIL", "logout": "CANCEL"}
    return events.select(F.col("user_id").alias("plan_id"), "event_id", F.coalesce(_lookup(kinds, F.col("event_type")), F.lit("PROGRESS")).alias("event"), "ts", "value")


def latest(events: DataFrame, key: str = "plan_id") -> DataFrame:
    """The last event of each key."""
    w = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return events.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def page(events: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    """Rows of page ``number`` (from 0), ``size`` (1 to 100) each."""
    if number < 0 or not 1 <= size <= 100:
        raise ValueError("a page has a number of 0 or more and 1 to 100 rows")
    return events.orderBy(*order).offset(number * size).limit(size)


def page_count(n: Column, size: int) -> Column:
    return F.ceil(n / size).cast("bigint")


def fenced(events: DataFrame) -> DataFrame:
    """Events that count: those of a worker only while its claim is the latest and the task has not ended since."""
    w = Window.partitionBy("task_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    claim = F.last(F.when(F.col("event") == "CLAIM", F.col("token")), ignorenulls=True).over(w)
    e = events.withColumn("_claim", claim)
    # An end reported under an older claim is no step: it must not hide the end that the holder reports.
    step = F.col("event").isin("CLAIM", "REQUEUE", "CANCEL") | (F.col("event").isin("COMPLETE", "FAIL") & (F.col("token") == F.col("_claim")))
    last = F.last(F.when(step, F.col("event")), ignorenulls=True).over(w)
    of_worker = F.col("event").isin("HEARTBEAT", "PROGRESS", "COMPLETE", "FAIL")
    return e.withColumn("_ok", ~of_worker | ((F.col("token") == F.col("_claim")) & (last == "CLAIM"))).where("_ok").drop("_ok", "_claim")


def state(events: DataFrame) -> DataFrame:
    """task_id, status, attempt (claims), token of the latest claim and time of the last event that counts."""
    e = fenced(events)
    at = F.struct("ts", "event_id")
    return e.groupBy("task_id").agg(
        _lookup(STATE_OF, F.max_by("event", at)).alias("status"), F.count_if(F.col("event") == "CLAIM").alias("attempt"), F.max_by(F.when(F.col("event") == "CLAIM", F.col("token")), F.when(F.col("event") == "CLAIM", at)).alias("token"), F.max("ts").alias("updated_at")
    )


def stale(events: DataFrame, now: Column, seconds: int = LEASE_SECONDS) -> DataFrame:
    """Running tasks without a sign of life for ``seconds``: they go back to the queue."""
    return state(events).where((F.col("status") == "RUNNING") & (F.timestamp_diff("SECOND", F.col("updated_at"), now) > seconds)).select("task_id", F.lit("REQUEUE").alias("action"))


def gaps(events: DataFrame, seconds: int = LEASE_SECONDS) -> DataFrame:
    """Events after which a plan was silent for longer than ``seconds``, with the seconds to the next one (null for the last)."""
    w = Window.partitionBy("plan_id").orderBy("ts", "event_id")
    nxt = F.lead("ts").over(w)
    silent = F.timestamp_diff("SECOND", F.col("ts"), nxt)
    return events.withColumn("silent", silent).where(F.col("silent").isNull() | (F.col("silent") > seconds))


def enqueue(requests: DataFrame) -> DataFrame:
    """Requests (plan_id, request_id, ts, ends_at) with the task each gets: its own, or that of the active task of the plan (reused).

    A request joins the active task if it comes before that one has ended."""
    w = Window.partitionBy("plan_id").orderBy("ts", "request_id")
    until = F.max("ends_at").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = requests.withColumn("_new", until.isNull() | (F.col("ts") >= until))
    task = F.last(F.when(F.col("_new"), F.col("request_id")), ignorenulls=True).over(w)
    return r.select("plan_id", "request_id", task.alias("task_request"), (~F.col("_new")).alias("reused"))


def may(action: str, status: Column, has_sample: Column) -> Column:
    """Whether a task may be retried, replayed or cancelled."""
    return {"retry": status == "FAILED", "replay": (status == "COMPLETED") & has_sample, "cancel": status.isin("QUEUED", "RUNNING")}[action]


def due(states: DataFrame, now: Column) -> DataFrame:
    """Ended tasks whose span of retention is over."""
    days = _lookup(RETENTION_DAYS, F.col("status"))
    return states.where(days.isNotNull() & (F.timestamp_diff("DAY", F.col("updated_at"), now) > days))


def orphans(files: DataFrame, tasks: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    """Stored files older than ``hours`` that no task refers to."""
    old = files.where(F.timestamp_diff("HOUR", F.col("modified"), now) >= hours)
    return old.join(tasks.select(F.col("source_path").alias("path")).distinct(), "path", "left_anti")


def progress(stage: Column, done: Column, status: Column) -> Column:
    """Percent from the stage and, while pages are read, how many of them are done; 100 only when completed."""
    base = F.coalesce(_lookup(STAGE_PROGRESS, stage), F.lit(0))
    within = F.when(stage == "OCR", F.floor(done * 49)).otherwise(0)
    return F.when(status == "COMPLETED", 100).otherwise(F.least(F.lit(99), F.greatest(F.lit(0), base + within))).cast("int")


#: Days for which the source files of ended tasks are kept: until a completed one need not be run again, until a failed one is looked at.
SOURCE_DAYS = {"COMPLETED": 90, "FAILED": 7, "CANCELLED": 0}


def sources_due(states: DataFrame, now: Column) -> DataFrame:
    """Ended tasks whose source files (``source_path``) can go: those of cancelled tasks at once, of others when their days are over."""
    days = _lookup(SOURCE_DAYS, F.col("status"))
    age = F.timestamp_diff("SECOND", F.col("updated_at"), now)
    return states.where(F.col("source_path").isNotNull() & days.isNotNull() & ((F.col("status") == "CANCELLED") | (age > days * 86_400)))


def active(states: DataFrame) -> DataFrame:
    """The active task of each plan: queued or running, the latest of several."""
    w = Window.partitionBy("plan_id").orderBy(F.col("created_at").desc(), F.col("task_id").desc())
    return states.where(F.col("status").isin("QUEUED", "RUNNING")).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def next_queued(states: DataFrame, by: str) -> DataFrame:
    """The task that has been queued longest, for each value of a column (a worker takes it first)."""
    w = Window.partitionBy(by).orderBy("created_at", "task_id")
    return states.where("status = 'QUEUED'").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def backfilled(rows: DataFrame) -> DataFrame:
    """Tasks of an older schema with stage, progress_percent and attempt, as their status has them, where any of the three is missing."""
    lacks = F.col("stage").isNull() | F.col("progress_percent").isNull() | F.col("attempt").isNull()
    stage = F.when(F.col("status").isin("COMPLETED", "FAILED", "CANCELLED"), F.col("status")).otherwise("QUEUED")
    done = F.when(F.col("status") == "COMPLETED", 100).otherwise(0)
    return rows.withColumns({"stage": F.when(lacks, stage).otherwise(F.col("stage")), "progress_percent": F.when(lacks, done).otherwise(F.col("progress_percent")), "attempt": F.coalesce("attempt", F.lit(0))})
