"""Queries over task histories: on the shipped activity table and on inline logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Pattern
from ..operators import tasks as K
from ..streaming.tasks import windowed_counts
from .register import Register, table

REGISTER = Register()
query = REGISTER.query
NOW = "2026-01-10 12:00:00"

LOG = Pattern(
    "task_id string, event_id long, event string, token string, moment string", of="customer", keys=("task_id", "event_id"), rows=[
        ("t1", 1, "ENQUEUE", None, "2026-01-10 10:00:00"), ("t1", 2, "CLAIM", "a", "2026-01-10 10:01:00"), ("t1", 3, "PROGRESS", "a", "2026-01-10 10:02:00"), ("t1", 4, "REQUEUE", None, "2026-01-10 10:10:00"), ("t1", 5, "CLAIM", "b", "2026-01-10 10:11:00"),
        ("t1", 6, "COMPLETE", "a", "2026-01-10 10:12:00"), ("t1", 7, "COMPLETE", "b", "2026-01-10 10:13:00"), ("t2", 8, "ENQUEUE", None, "2026-01-10 11:00:00"), ("t2", 9, "CLAIM", "c", "2026-01-10 11:00:30"), ("t2", 10, "HEARTBEAT", "c", "2026-01-10 11:40:00"),
        ("t3", 11, "ENQUEUE", None, "2026-01-10 11:58:00"), ("t4", 12, "ENQUEUE", None, "2026-01-01 08:00:00"), ("t4", 13, "CLAIM", "d", "2026-01-01 08:01:00"), ("t4", 14, "FAIL", "d", "2026-01-01 08:05:00"), ("t5", 15, "ENQUEUE", None, "2026-01-10 11:50:00"), ("t5", 16, "CLAIM", "e", "2026-01-10 11:57:00"),
    ],
)


def _log(spark, sf_dir):
    return LOG.frame(spark, sf_dir).withColumn("ts", F.col("moment").cast("timestamp_ntz"))


_LAST = """(SELECT *, lag(CASE WHEN event IN ('CLAIM', 'REQUEUE', 'CANCEL') OR (event IN ('COMPLETE', 'FAIL') AND token = claim) THEN event END IGNORE NULLS) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS last_step
    FROM (SELECT *, lag(CASE WHEN event = 'CLAIM' THEN token END IGNORE NULLS) OVER (PARTITION BY task_id ORDER BY ts, event_id) AS claim FROM (SELECT *, CAST(moment AS TIMESTAMP) AS ts FROM {0})))""".format(LOG.sql())
_COUNTS = f"(SELECT * FROM {_LAST} WHERE event NOT IN ('HEARTBEAT', 'PROGRESS', 'COMPLETE', 'FAIL') OR (token = claim AND last_step = 'CLAIM'))"
_STATE = f"""(SELECT task_id, CASE arg_max(event, event_id) WHEN 'ENQUEUE' THEN 'QUEUED' WHEN 'REQUEUE' THEN 'QUEUED' WHEN 'COMPLETE' THEN 'COMPLETED' WHEN 'FAIL' THEN 'FAILED' WHEN 'CANCEL' THEN 'CANCELLED' ELSE 'RUNNING' END AS status,
    count(*) FILTER (WHERE event = 'CLAIM') AS attempt, arg_max(token, event_id) FILTER (WHERE event = 'CLAIM') AS token, max(ts) AS updated_at FROM {_COUNTS} GROUP BY task_id)"""


@query(f"SELECT task_id, event_id FROM {_COUNTS}")
def task_fencing(spark, sf_dir):
    return K.fenced(_log(spark, sf_dir)).select("task_id", "event_id")


@query(f"SELECT * FROM {_STATE}")
def task_state_fold(spark, sf_dir):
    return K.state(_log(spark, sf_dir))


@query(f"SELECT task_id, 'REQUEUE' AS action FROM {_STATE} WHERE status = 'RUNNING' AND date_diff('second', updated_at, TIMESTAMP '{NOW}') > 300")
def lease_expired(spark, sf_dir):
    return K.stale(_log(spark, sf_dir), F.expr(f"timestamp_ntz'{NOW}'"))


@query(f"SELECT task_id, status FROM {_STATE} WHERE status IN ('FAILED', 'CANCELLED') AND date_diff('day', updated_at, TIMESTAMP '{NOW}') > 7 OR status = 'COMPLETED' AND date_diff('day', updated_at, TIMESTAMP '{NOW}') > 30")
def retention_due(spark, sf_dir):
    return K.due(K.state(_log(spark, sf_dir)), F.expr(f"timestamp_ntz'{NOW}'")).select("task_id", "status")


@query(f"SELECT task_id, status = 'FAILED' AS may_retry, status = 'COMPLETED' AND task_id LIKE 't1-%' AS may_replay, status IN ('QUEUED', 'RUNNING') AS may_cancel FROM {_STATE}")
def task_transitions(spark, sf_dir):
    s = K.state(_log(spark, sf_dir))
    return s.select("task_id", *[K.may(a, F.col("status"), F.startswith("task_id", F.lit("t1-"))).alias(f"may_{a}") for a in ("retry", "replay", "cancel")])


@query("SELECT user_id AS plan_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def task_latest(spark, sf_dir):
    return K.latest(K.from_activity(table(spark, sf_dir, "events"))).select("plan_id", "event_id", "ts")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40")
def task_history_page(spark, sf_dir):
    """A page of a history: the limit is the feature."""
    return K.page(table(spark, sf_dir, "events"), 2, 20, [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id", "ts")


@query("SELECT user_id AS plan_id, count(*) AS n_events, CAST(ceil(count(*) / 20) AS BIGINT) AS n_pages FROM events GROUP BY user_id")
def task_page_counts(spark, sf_dir):
    return K.from_activity(table(spark, sf_dir, "events")).groupBy("plan_id").agg(F.count("*").alias("n_events")).withColumn("n_pages", K.page_count(F.col("n_events"), 20))


@query("SELECT plan_id, event_id, CAST(silent AS BIGINT) AS silent FROM (SELECT user_id AS plan_id, event_id, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000000 AS silent FROM events) WHERE silent IS NULL OR silent > 86400")
def task_silences(spark, sf_dir):
    return K.gaps(K.from_activity(table(spark, sf_dir, "events")), 86_400).select("plan_id", "event_id", "silent")


REQUESTS = Pattern("plan_id string, request_id string, moment string, until string", of="customer", keys=("plan_id", "request_id"), rows=[("p", "r1", "2026-01-01 00:00:00", "2026-01-01 01:00:00"), ("p", "r2", "2026-01-01 00:30:00", None), ("p", "r3", "2026-01-01 02:00:00", "2026-01-01 03:00:00"), ("q", "r4", "2026-01-01 00:10:00", "2026-01-01 00:20:00"), ("p", "r5", "2026-01-01 02:59:00", None)])


@query(
    f"""SELECT plan_id, request_id, max(CASE WHEN fresh THEN request_id END) OVER (PARTITION BY plan_id ORDER BY moment, request_id) AS task_request, NOT fresh AS reused FROM (
      SELECT *, coalesce(moment >= max(until) OVER (PARTITION BY plan_id ORDER BY moment, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS fresh FROM {REQUESTS.sql()})"""
)
def task_active_unique(spark, sf_dir):
    r = REQUESTS.frame(spark, sf_dir).withColumns({"ts": F.col("moment").cast("timestamp_ntz"), "ends_at": F.col("until").cast("timestamp_ntz")})
    return K.enqueue(r)


STAGES = Pattern("id long, stage string, done double, status string", [(1, "DOWNLOAD", 0.0, "RUNNING"), (2, "OCR", 0.5, "RUNNING"), (3, "OCR", 1.0, "RUNNING"), (4, "PERSIST", 0.0, "RUNNING"), (5, "DONE", 1.0, "COMPLETED"), (6, "DONE", 1.0, "RUNNING"), (7, "X", 0.0, "QUEUED")])


@query(f"SELECT id, CAST(CASE WHEN status = 'COMPLETED' THEN 100 ELSE least(99, CASE stage WHEN 'DOWNLOAD' THEN 5 WHEN 'PARSE' THEN 15 WHEN 'OCR' THEN 35 + floor(done * 49) WHEN 'SEGMENT' THEN 75 WHEN 'PERSIST' THEN 95 WHEN 'DONE' THEN 100 ELSE 0 END) END AS INTEGER) AS percent FROM {STAGES.sql()}")
def stage_progress(spark, sf_dir):
    return STAGES.frame(spark, sf_dir).select("id", K.progress(F.col("stage"), F.col("done"), F.col("status")).alias("percent"))


REFERENCES = Pattern("source_path string", [("a.bin",)], of="customer")
FILES = Pattern("path string, moment string", of="customer", rows=[("a.bin", "2026-01-10 09:00:00"), ("b.bin", "2026-01-10 09:00:00"), ("c.bin", "2026-01-10 11:59:00")])


@query(f"SELECT path FROM {FILES.sql()} WHERE path NOT IN (SELECT source_path FROM {REFERENCES.sql()}) AND date_diff('minute', CAST(moment AS TIMESTAMP), TIMESTAMP '{NOW}') >= 60")
def orphan_files(spark, sf_dir):
    files = FILES.frame(spark, sf_dir).withColumn("modified", F.col("moment").cast("timestamp_ntz"))
    return K.orphans(files, REFERENCES.frame(spark, sf_dir), F.expr(f"timestamp_ntz'{NOW}'")).select("path")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n")
