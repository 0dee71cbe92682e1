"""Queries over managed results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Pattern
from ..operators import manage as M
from .register import Register, table

REGISTER = Register()
query = REGISTER.query

BEFORE = Pattern("result_id long, result string", [(1, '{"title": "a", "n": ◆, "actionGroups": [{"key": "rescue", "responsibilities": "x ◇", "pages": [1, 2]}, {"key": "old", "name": "o"}], "same": {"k": "◇"}, "gone": {"p": {"q": 1}}}')], thin=False)
AFTER = Pattern("result_id long, result string", [(1, '{"title": "a", "n": "◇", "actionGroups": [{"key": "rescue", "responsibilities": "y ◇", "pages": [1, 2]}, {"key": "new", "name": "n"}], "same": {"k": "◇"}, "list": [1, ◆]}')], thin=False)
CHANGES = Pattern(
    "id long, path string, change_type string, before string, after string",
    [
        (1, "n", "MODIFIED", "◆", '"◇"'), (1, "actionGroups.rescue.responsibilities", "MODIFIED", '"x ◇"', '"y ◇"'), (1, "actionGroups.old", "REMOVED", None, None), (1, "actionGroups.new", "ADDED", None, None),
        (1, "gone", "REMOVED", None, None), (1, "list", "ADDED", None, "[1,◆]"),
    ], thin=False,
)


@query(f"SELECT * FROM {CHANGES.sql()}")
def json_keyed_diff(spark, sf_dir):
    return M.difference(BEFORE.frame(spark, sf_dir), AFTER.frame(spark, sf_dir))


@query("SELECT doc_id, length(text) > 2000 AS cut, CASE WHEN length(text) > 2000 THEN substr(text, 1, 1997) || '...' ELSE text END AS shown FROM documents")
def export_clip(spark, sf_dir):
    from ..functions.text import clip

    return table(spark, sf_dir, "documents").select("doc_id", (F.length("text") > 2000).alias("cut"), clip(F.col("text"), 2000, "...").alias("shown"))


_ITEMS = "(SELECT doc_id, CASE WHEN quality = 1 THEN 'quality' ELSE 'junk' END AS item FROM labels UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1)"
_SEEN = "(SELECT doc_id, CASE WHEN n_chars >= 600 THEN 'quality' ELSE 'junk' END AS item FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))"


@query(
    f"""SELECT doc_id, required, matched, coalesce(missing, '') AS missing, coalesce(unexpected, '') AS unexpected, CASE WHEN required = 0 THEN 100.0 ELSE round(matched * 100.0 / required, 2) END AS percent FROM (
      SELECT doc_id, count(e.item) AS required, count(CASE WHEN e.item = a.item THEN 1 END) AS matched, string_agg(CASE WHEN a.item IS NULL THEN e.item END, ',' ORDER BY e.item) AS missing, string_agg(CASE WHEN e.item IS NULL THEN a.item END, ',' ORDER BY a.item) AS unexpected
      FROM (SELECT DISTINCT * FROM {_ITEMS}) e FULL OUTER JOIN (SELECT DISTINCT * FROM {_SEEN}) a USING (doc_id, item) GROUP BY doc_id)"""
)
def structure_coverage(spark, sf_dir):
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    expected = labels.select("doc_id", F.when(F.col("quality") == 1, "quality").otherwise("junk").alias("item")).union(labels.where("toxic = 1").select("doc_id", F.lit("toxic")))
    actual = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.when(F.col("n_chars") >= 600, "quality").otherwise("junk").alias("item"))
    return M.coverage(expected, actual)


@query("SELECT event_id AS review_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS revision_number FROM events")
def review_revision_number(spark, sf_dir):
    reviews = table(spark, sf_dir, "events").select(F.col("event_id").alias("review_id"), F.col("user_id").alias("task_id"), F.col("ts").alias("created_at"))
    return M.number_reviews(reviews).select("review_id", "revision_number")


@query("SELECT event_id AS sample_id, CASE WHEN lead(ts) OVER w IS NULL THEN 'ACTIVE' ELSE 'ARCHIVED' END AS status, lead(ts) OVER w AS archived_at FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def active_sample(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("task_id"), F.col("ts").alias("created_at"))
    return M.active_samples(samples).select("sample_id", "status", "archived_at")


@query("SELECT o_orderkey AS task_id, max(event_id) AS sample_id FROM orders JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1) ON user_id = o_custkey GROUP BY o_orderkey")
def replay_evaluation(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("task_id"), F.col("ts").alias("created_at"))
    replays = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("retry_of_task_id"))
    return M.evaluations(replays, samples).select("task_id", "sample_id")


@query(
    """SELECT c_custkey AS plan_id, c_name AS plan_name, TRUE AS catalogued FROM customer WHERE c_acctbal >= 0
    UNION ALL SELECT o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'order-' || o_orderkey END, FALSE FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)"""
)
def catalog_with_fallback(spark, sf_dir):
    catalog = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("plan_id"), F.col("c_name").alias("plan_name"))
    name = F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise(F.concat(F.lit("order-"), F.col("o_orderkey"), F.lit(".docx")))
    tasks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("updated_at"), name.alias("file_name"))
    return M.catalogue(catalog, tasks)


@query("SELECT plan_id, plan_name FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY fresh DESC, updated_at DESC) AS k FROM (SELECT c_custkey AS plan_id, c_name AS plan_name, TIMESTAMP '1990-01-01' AS updated_at, 0 AS fresh FROM customer UNION ALL SELECT o_custkey, 'order-' || max(o_orderkey), max(o_orderdate), 1 FROM orders GROUP BY o_custkey)) WHERE k = 1")
def catalog_upsert(spark, sf_dir):
    catalog = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("plan_id"), F.col("c_name").alias("plan_name"), F.expr("timestamp_ntz'1990-01-01 00:00:00'").alias("updated_at"))
    changes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("plan_id")).agg(F.concat(F.lit("order-"), F.max("o_orderkey")).alias("plan_name"), F.max("o_orderdate").alias("updated_at"))
    return M.upsert(catalog, changes).select("plan_id", "plan_name")


IDS = Pattern("v string", keys=(), rows=[("plan-◇",), ("a" * 65,), ("bad ◇",), ("x/y:z@w",), ("",)])


@query(f"SELECT v, regexp_full_match(v, '[A-Za-z0-9._-]{{1,64}}') AS valid, CASE WHEN regexp_full_match(v, '[A-Za-z0-9._:@/-]{{1,128}}') THEN v ELSE '-' END AS audited FROM {IDS.sql()}")
def request_checks(spark, sf_dir):
    return IDS.frame(spark, sf_dir).select("v", M.valid_plan_id(F.col("v")).alias("valid"), M.audit_value(F.col("v")).alias("audited"))
