"""Queries over checks, lookups and small rules, on shipped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Pattern
from ..functions import text as T
from ..operators import extras as X
from ..operators import intake
from ..operators import manage as M
from ..operators import rules as R
from ..operators import tasks as K
from .blocks import _sql_normalize
from .register import Register, table
from .sections import PART_RULES, part_rules

REGISTER = Register()
query = REGISTER.query
LAST = "1998-01-01 00:00:00"

UPLOADS = Pattern("file_name string, size long, content_type string", [("◇.PNG", 10, "image/png"), ("◇.jpeg", 0, "image/jpeg"), ("◇.pdf", 5, "image/png"), ("a.webp", 10_485_761, "image/webp"), ("a.tif", 10_485_760, "image/tiff"), ("◇.bmp", 3, "text/plain"), ("b.gif", 7, None)], of="pages", keys=("size",))


@query(f"SELECT file_name, size, CASE WHEN size = 0 THEN 'EMPTY_FILE' WHEN size > 10485760 THEN 'FILE_TOO_LARGE' WHEN NOT starts_with(coalesce(content_type, ''), 'image/') OR NOT regexp_matches(lower(file_name), '[.](jpg|jpeg|png|bmp|tif|tiff|webp)$') THEN 'UNSUPPORTED_IMAGE_TYPE' ELSE 'OK' END AS verdict FROM {UPLOADS.sql()}")
def image_uploads(spark, sf_dir):
    return UPLOADS.frame(spark, sf_dir).select("file_name", "size", intake.image_verdict(F.col("file_name"), F.col("size"), F.col("content_type")).alias("verdict"))


@query("SELECT doc_id, CASE WHEN length(text) > 32767 THEN substr(text, 1, 32764) || '...' ELSE text END AS before, CASE WHEN length(text) > 16000 THEN substr(text || text, 1, 32764) || CASE WHEN length(text) * 2 > 32767 THEN '...' ELSE substr(text || text, 32765) END ELSE text || text END AS after FROM documents")
def change_export(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("MODIFIED").alias("change_type"), F.col("text").alias("before"), F.concat("text", "text").alias("after"))
    return M.export_rows(docs).select(F.col("path").cast("bigint").alias("doc_id"), "before", "after")


@query(
    """SELECT conv_id, turn FROM (SELECT *, max(CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, run ORDER BY turn ROWS UNBOUNDED PRECEDING) AS seen FROM (
      SELECT *, sum(turned) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, CASE WHEN page <> lag(page, 1, -1) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS turned FROM (SELECT *, turn // 3 % 2 AS page FROM conversations)))) WHERE seen = 0 OR role = 'assistant' AND turn % 3 = 2"""
)
def page_run_marks(spark, sf_dir):
    """Turns as blocks of pages of three: what follows a mark on its page is left out, on the next page it counts again."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_idx"), (F.floor(F.col("turn") / 3) % 2).alias("page"), "text", ((F.col("role") == "assistant") & (F.col("turn") % 3 == 2)).alias("is_table"))
    return intake.drop_after_mark(turns, F.lower("text").contains("the")).select(F.col("doc_id").alias("conv_id"), F.col("block_idx").alias("turn"))


HEADS = Pattern("id long, text string", [(k, t) for k, t in enumerate(("一级响应", "一级响应：", "二级应急响应 ◇", "附则", "后期处置 ◇", "第一章 ◇", "一、◇", "1 ◇", "1.1 ◇", "1.2.3、◇", "◇", "", None, "Ⅲ级响应", "1" * 81, "注：◇", "以上包括本数", "以下不 包括本数，◇", "以上应急包括◇本数"))])
_TAILS = ("附则", "后期处置")


@query(
    f"""SELECT id, CASE WHEN trim(coalesce(text, '')) = '' OR length(text) > 80 THEN 0 WHEN length(n) <= 16 AND n IN ('一级响应', '二级应急响应', 'III级响应') THEN 3 WHEN regexp_matches(n, '附则|后期处置') THEN 2 WHEN regexp_matches(text, '^第[〇零一二三四五六七八九十百千万0-9]+[章节篇条]') THEN 1
      WHEN regexp_matches(text, '^[一二三四五六七八九十]+[、.]') THEN 2 WHEN regexp_matches(text, '^\\d+(\\.\\d+){{0,3}}[、.\\s]') THEN CASE WHEN contains(text, '.') THEN 3 ELSE 2 END ELSE 0 END AS level,
      regexp_matches(p, '^注[：:]') OR (contains(p, '以上') AND contains(p, '包括本数')) OR (contains(p, '以下') AND contains(p, '不包括本数')) AS note
    FROM (SELECT *, {_sql_normalize("text")} AS n, replace(regexp_replace(coalesce(text, ''), '\\s+', '', 'g'), '应急', '') AS p FROM {HEADS.sql()})"""
)
def segment_headings(spark, sf_dir):
    c = F.col("text")
    return HEADS.frame(spark, sf_dir).select("id", T.segment_heading_level(c, ("一级响应", "二级应急响应", "III级响应"), _TAILS).alias("level"), T.is_page_note(c).alias("note"))


ALIASES = Pattern("id long, text string, alias string", [(0, "特别重大响应◇", "重大响应"), (1, "◇重大响应", "重大响应"), (2, "II级响应 ◇", "I级响应"), (3, "◇ I级响应", "I级响应"), (4, "VI级响应", "I级响应"), (5, "IV级应急响应", "IV级应急响应"), (6, "一级响应◇", "一级响应"), (7, "（Ⅱ级）响应", "II级响应"), (8, "◇", "◇")])


@query(f"SELECT id, NOT (alias = '重大响应' AND contains(n, '特别重大响应')) AND CASE WHEN regexp_full_match(a, '(I{{1,3}}|IV)级(应急)?响应') THEN regexp_matches(n, '(^|[^IV])' || a || '($|[^IV])') ELSE contains(n, a) END AS fits FROM (SELECT *, {_sql_normalize('text')} AS n, {_sql_normalize('alias')} AS a FROM {ALIASES.sql()})")
def alias_fits(spark, sf_dir):
    return ALIASES.frame(spark, sf_dir).select("id", T.fits_alias(T.normalize(F.col("text")), T.normalize(F.col("alias"))).alias("fits"))


@query(
    f"""WITH r AS (SELECT * FROM {PART_RULES} WHERE enabled), g AS (SELECT * FROM r WHERE rule_type IN ('RESPONSE', 'WARNING', 'SECTION', 'MARKER'))
    SELECT 'COMMAND_CODES' AS problem, CAST(NULL AS VARCHAR) AS subject FROM r WHERE rule_type = 'COMMAND' HAVING count(DISTINCT rule_code) > 1
    UNION ALL SELECT 'CODE_NAMES', rule_type || '/' || rule_code FROM g GROUP BY rule_type, rule_code HAVING count(DISTINCT canonical_name) > 1
    UNION ALL SELECT 'NAME_CODES', rule_type || '/' || canonical_name FROM g WHERE rule_type IN ('RESPONSE', 'WARNING') GROUP BY rule_type, canonical_name HAVING count(DISTINCT rule_code) > 1
    UNION ALL SELECT 'GROUP_REQUIRED', t FROM (SELECT unnest(['COMMAND', 'RESPONSE', 'TAIL']) AS t) WHERE t NOT IN (SELECT rule_type FROM r)"""
)
def rule_snapshot_problems(spark, sf_dir):
    return R.snapshot_problems(part_rules(spark, sf_dir))


def _states(spark, sf_dir):
    """Orders as tasks of customers."""
    status = F.when(F.col("o_orderkey") % 7 == 0, "CANCELLED").when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "P", "RUNNING").when(F.col("o_orderkey") % 3 == 0, "QUEUED").otherwise("COMPLETED")
    path = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("task-"), "o_orderkey", F.lit(".bin")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("plan_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"), path.alias("source_path"), "o_orderpriority")


_STATES = "(SELECT o_orderkey AS task_id, o_custkey AS plan_id, CASE WHEN o_orderkey % 7 = 0 THEN 'CANCELLED' WHEN o_orderstatus = 'F' THEN 'FAILED' WHEN o_orderstatus = 'P' THEN 'RUNNING' WHEN o_orderkey % 3 = 0 THEN 'QUEUED' ELSE 'COMPLETED' END AS status, o_orderdate AS made, CASE WHEN o_orderkey % 4 <> 0 THEN 'task-' || o_orderkey || '.bin' END AS source_path, o_orderpriority FROM orders)"


@query(f"SELECT task_id, source_path FROM {_STATES} WHERE source_path IS NOT NULL AND (status = 'CANCELLED' OR date_diff('second', made, TIMESTAMP '{LAST}') > CASE status WHEN 'COMPLETED' THEN 90 WHEN 'FAILED' THEN 7 END * 86400)")
def sources_due(spark, sf_dir):
    return K.sources_due(_states(spark, sf_dir), F.expr(f"timestamp_ntz'{LAST}'")).select("task_id", "source_path")


@query(f"SELECT plan_id, arg_max(task_id, (made, task_id)) AS task_id FROM {_STATES} WHERE status IN ('QUEUED', 'RUNNING') GROUP BY plan_id")
def active_tasks(spark, sf_dir):
    return K.active(_states(spark, sf_dir)).select("plan_id", "task_id")


@query(f"SELECT o_orderpriority, arg_min(task_id, (made, task_id)) AS task_id FROM {_STATES} WHERE status = 'QUEUED' GROUP BY o_orderpriority")
def next_queued(spark, sf_dir):
    return K.next_queued(_states(spark, sf_dir), "o_orderpriority").select("o_orderpriority", "task_id")


_OLD = f"(SELECT task_id, status, CASE WHEN task_id % 5 <> 0 THEN 'OCR' END AS stage, CASE WHEN task_id % 6 <> 0 THEN CAST(task_id % 90 AS INTEGER) END AS progress_percent, CASE WHEN task_id % 8 <> 0 THEN CAST(task_id % 3 AS INTEGER) END AS attempt FROM {_STATES})"


@query(
    f"""SELECT task_id, CASE WHEN lacks THEN CASE WHEN status IN ('COMPLETED', 'FAILED', 'CANCELLED') THEN status ELSE 'QUEUED' END ELSE stage END AS stage, CASE WHEN lacks THEN CASE WHEN status = 'COMPLETED' THEN 100 ELSE 0 END ELSE progress_percent END AS progress_percent, coalesce(attempt, 0) AS attempt
    FROM (SELECT *, stage IS NULL OR progress_percent IS NULL OR attempt IS NULL AS lacks FROM {_OLD})"""
)
def tasks_backfilled(spark, sf_dir):
    t = F.col("task_id")
    old = _states(spark, sf_dir).select("task_id", "status", F.when(t % 5 != 0, "OCR").alias("stage"), F.when(t % 6 != 0, (t % 90).cast("int")).alias("progress_percent"), F.when(t % 8 != 0, (t % 3).cast("int")).alias("attempt"))
    return K.backfilled(old).select("task_id", "stage", "progress_percent", "attempt")


FAILURES = Pattern("id long, code string, message string", [(0, "◇_NOT_FOUND", None), (1, "PLAN_ALREADY_EXISTS", "◇"), (2, "FILE_TOO_LARGE", None), (3, "INTERNAL_ERROR", None), (4, "INVALID_REQUEST", "◇ ?"), (5, "UNSUPPORTED_◇", None), (6, "◇", None)])
_STATUS = "CASE WHEN ends_with(code, '_NOT_FOUND') THEN 404 WHEN ends_with(code, '_ALREADY_EXISTS') THEN 409 WHEN code IN ('FILE_TOO_LARGE', 'DOCUMENT_TOO_LARGE') THEN 413 WHEN starts_with(code, 'UNSUPPORTED') THEN 415 WHEN code = 'INTERNAL_ERROR' THEN 500 ELSE 400 END"


@query(
    f"""SELECT id, '{{"time":"t","status":' || s || ',"error":"' || CASE s WHEN 404 THEN 'Not Found' WHEN 409 THEN 'Conflict' WHEN 413 THEN 'Payload Too Large' WHEN 415 THEN 'Unsupported Media Type' WHEN 500 THEN 'Internal Server Error' ELSE 'Bad Request' END || '","code":"' || code || '"'
      || coalesce(',"message":"' || coalesce(message, CASE code WHEN 'FILE_TOO_LARGE' THEN '上传文件大小超过限制。' WHEN 'INVALID_REQUEST' THEN '请求参数不完整。' WHEN 'INTERNAL_ERROR' THEN '服务处理失败。' END) || '"', '') || ',"path":"/x"}}' AS body FROM (SELECT *, {_STATUS} AS s FROM {FAILURES.sql()})"""
)
def error_bodies(spark, sf_dir):
    return FAILURES.frame(spark, sf_dir).select("id", X.error_body(F.col("code"), F.lit("/x"), F.lit("t"), F.col("message")).alias("body"))


CREATES = Pattern("plan_id string, request_id long, name string, code string, category string, department string, version string", [("new", 1, "◇", "c", " ", None, "v"), ("new", 2, "again", None, None, None, None), ("bad id", 3, "x", None, None, None, None), ("blank", 4, "  ", None, None, None, None), ("old", 5, " ◇ ", None, "k", "d", "")], of="customer", keys=("plan_id", "request_id"))


@query(
    f"""WITH q AS {CREATES.sql()}, v AS (SELECT *, regexp_full_match(plan_id, '[A-Za-z0-9._-]{{1,64}}') AND trim(name) <> '' AS ok FROM q), f AS (SELECT *, min(request_id) FILTER (WHERE ok) OVER (PARTITION BY plan_id) AS first FROM v),
      o AS (SELECT *, CASE WHEN NOT ok THEN 'INVALID_REQUEST' WHEN plan_id IN (SELECT 'old-' || c_custkey FROM customer WHERE c_acctbal >= 0) OR request_id <> first THEN 'PLAN_ALREADY_EXISTS' ELSE 'CREATED' END AS outcome FROM f)
    SELECT plan_id, request_id, outcome, CASE WHEN outcome = 'CREATED' THEN coalesce(nullif(trim(code), ''), plan_id) END AS plan_code, CASE WHEN outcome = 'CREATED' THEN trim(name) END AS plan_name, CASE WHEN outcome = 'CREATED' THEN coalesce(nullif(trim(category), ''), '未分类') END AS category,
      CASE WHEN outcome = 'CREATED' THEN coalesce(nullif(trim(department), ''), '未配置') END AS responsible_department, CASE WHEN outcome = 'CREATED' THEN coalesce(nullif(trim(version), ''), '未标注') END AS version_label FROM o"""
)
def catalog_create(spark, sf_dir):
    catalog = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.concat(F.lit("old-"), "c_custkey").alias("plan_id"))
    return M.created(catalog, CREATES.frame(spark, sf_dir))


REQUESTED = Pattern("template string, url string", [("member_◇", "https://◇.example.org/a b"), ("bad code", "HTTP://x/◇"), ("a" * 65, "ftp://x/"), ("", "https:///nohost"), ("◇", "https://x.org?q=◇")], of="pages", keys=())


@query(f"SELECT template, url, regexp_full_match(template, '[A-Za-z0-9_-]{{1,64}}') AS valid_code, regexp_full_match(url, '(?i:https?)://[^\\s/?#]+\\S*') AS valid_url FROM {REQUESTED.sql()}")
def template_requests(spark, sf_dir):
    return REQUESTED.frame(spark, sf_dir).select("template", "url", M.valid_template_code(F.col("template")).alias("valid_code"), M.valid_url(F.col("url")).alias("valid_url"))
