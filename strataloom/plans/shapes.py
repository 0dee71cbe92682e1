"""Queries over the small shapes, on the shipped tables where they have such columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Pattern
from ..operators import rules as R
from ..operators import shapes as S
from ..tables import written
from .blocks import SQL_BLOCKS
from .register import Register, table
from .sections import PART_RULES, SEED, _blocks, part_rules

REGISTER = Register()
query = REGISTER.query


@query("SELECT o_custkey AS batch_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS item_idx, o_orderkey AS item FROM orders")
def image_batch(spark, sf_dir):
    batches = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("batch_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("items"))
    return S.batch_items(batches, "items")


@query("SELECT vec_id, round(CASE WHEN label % 3 = 0 THEN CAST(label AS DOUBLE) ELSE list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding) END, 6) AS confidence FROM embeddings")
def char_confidence(spark, sf_dir):
    scores = F.when(F.col("label") % 3 == 0, F.array().cast("array<float>")).otherwise(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.char_confidence(scores, F.col("label").cast("double")), 6).alias("confidence"))


@query(
    "SELECT vec_id, list_min(x) AS x_min, list_min(y) AS y_min, list_max(x) AS x_max, list_max(y) AS y_max FROM (SELECT vec_id, list_transform(embedding[1:4], lambda v: CAST(round(v * 1000) AS INTEGER)) AS x, list_transform(embedding[5:8], lambda v: CAST(round(v * 1000) AS INTEGER)) AS y FROM embeddings)"
)
def box_bounds(spark, sf_dir):
    at = lambda v: (v * F.lit(1000).cast("float")).cast("double")  # in single precision, as the components are; halves go away from zero
    whole = lambda v: (F.signum(at(v)) * F.floor(F.abs(at(v)) + 0.5)).cast("int")
    points = F.zip_with(F.slice("embedding", 1, 4), F.slice("embedding", 5, 4), lambda x, y: F.struct(whole(x).alias("x"), whole(y).alias("y")))
    return table(spark, sf_dir, "embeddings").select("vec_id", S.bounds(points).alias("b")).select("vec_id", "b.*")


_AHEAD = ", ".join(f"min(CASE WHEN heading_level > 0 THEN block_idx END) OVER (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) AS next_{n}" for n in (1, 3, 5, 20, 30, 80))


@query(f"SELECT doc_id, block_idx, {_AHEAD} FROM {SQL_BLOCKS}")
def look_ahead(spark, sf_dir):
    rows = _blocks(spark, sf_dir).select("doc_id", "block_idx", "heading_level")
    for n in (1, 3, 5, 20, 30, 80):
        rows = S.next_within(rows, "doc_id", "block_idx", F.col("heading_level") > 0, n, f"next_{n}")
    return rows.drop("heading_level")


ANCHORS = Pattern(
    "image_id long, level int, line_idx int, text string, x_min double, y_min double, x_max double, y_max double",
    [
        *[(1, k, k, f"{k}级", 100.0, 900.0 - 200 * k, 120.0, 960.0 - 200 * k) for k in (1, 2, 3, 4)], (1, 1, 9, "1级 响应", 0.0, 0.0, 500.0, 20.0), (1, 2, 8, "2级", 0.0, 0.0, 500.0, 20.0),
        *[(2, k, k, f"{k}级", 700.0, 200.0 * k, 720.0, 200.0 * k + 60) for k in (1, 2, 3)], *[(3, k, k, f"{k}级", 700.0, 30.0 * k, 720.0, 30.0 * k + 60) for k in (1, 2, 3, 4)],
        *[(4, k, k, f"{k}级", 100.0 * k, 200.0 * k, 100.0 * k + 20, 200.0 * k + 60) for k in (1, 2, 3, 4)], *[(5, k, k, f"{k}级", 700.0, 200.0 * k, 800.0, 200.0 * k + 60) for k in (1, 2, 3, 4)], *[(6, k, k, f"{k}级", 650.0, 200.0 * k, 670.0, 200.0 * k + 60) for k in (1, 2, 3, 4)],
    ],
)
PAGES = Pattern("image_id long, width double, height double", [(k, 800.0, 1000.0) for k in range(1, 8)])
_SHORTEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, level ORDER BY length(regexp_replace(text, '\\s+', '', 'g')), line_idx) AS k FROM {ANCHORS.sql()}) WHERE k = 1)"


@query(f"SELECT image_id, level, line_idx, text FROM {_SHORTEST}")
def shortest_anchor(spark, sf_dir):
    return S.level_anchors(ANCHORS.frame(spark, sf_dir)).select("image_id", "level", "line_idx", "text")


@query(
    f"""WITH a AS (SELECT s.*, width, height, (x_min + x_max) / 2 AS mx, (y_min + y_max) / 2 AS my, avg((x_min + x_max) / 2) OVER (PARTITION BY s.image_id) <= width / 2 AS clockwise FROM {_SHORTEST} s JOIN {PAGES.sql()} p ON p.image_id = s.image_id),
      b AS (SELECT *, CASE WHEN clockwise THEN height - my ELSE my END AS u, CASE WHEN clockwise THEN mx ELSE width - mx END AS v FROM a), c AS (SELECT *, u - lag(u) OVER (PARTITION BY image_id ORDER BY u) AS gap FROM b),
      t AS (SELECT image_id, any_value(clockwise) AS clockwise, count(*) = 4 AND count(*) FILTER (WHERE y_max - y_min > 1.5 * (x_max - x_min)) >= 3 AND max(u) - min(u) >= 0.45 * any_value(height) AND min(gap) >= 0.08 * any_value(height) AND max(v) - min(v) <= 0.12 * any_value(width) AS is_table FROM c GROUP BY image_id)
    SELECT p.image_id, coalesce(is_table, FALSE) AS is_table, clockwise FROM {PAGES.sql()} p LEFT JOIN t ON t.image_id = p.image_id"""
)
def sideways_table(spark, sf_dir):
    return S.sideways(S.level_anchors(ANCHORS.frame(spark, sf_dir)), PAGES.frame(spark, sf_dir))


@query(f"SELECT rule_type, rule_code, alias, enabled, CAST(row_number() OVER (PARTITION BY rule_type ORDER BY group_order, rule_code, alias_order, alias) AS INTEGER) AS place FROM {PART_RULES}")
def rule_definitions(spark, sf_dir):
    return S.numbered_rules(part_rules(spark, sf_dir)).select("rule_type", "rule_code", "alias", "enabled", "place")


@query(
    f"""WITH d AS (SELECT DISTINCT doc_id FROM {SQL_BLOCKS}), f AS (SELECT doc_id, 'level_' || (doc_id % 4 + 1) AS key, CASE WHEN doc_id % 5 = 0 THEN 'MISSING' ELSE 'EXTRACTED' END AS status, CASE WHEN doc_id % 2 = 0 THEN 'CONTEXT_FALLBACK' ELSE 'HEADING' END AS matched_by FROM d),
      c AS (SELECT DISTINCT rule_code FROM {SEED.sql()} WHERE enabled AND rule_type IN ('RESPONSE', 'WARNING'))
    SELECT d.doc_id, rule_code, CASE WHEN status IS NULL OR status = 'MISSING' THEN 'MISSING' WHEN matched_by = 'CONTEXT_FALLBACK' THEN 'FALLBACK' ELSE 'MATCHED' END AS disposition FROM d, c LEFT JOIN f ON f.doc_id = d.doc_id AND f.key = rule_code"""
)
def rule_outcomes(spark, sf_dir):
    docs = _blocks(spark, sf_dir).select("doc_id").distinct()
    found = docs.select("doc_id", F.concat(F.lit("level_"), F.col("doc_id") % 4 + 1).alias("key"), F.when(F.col("doc_id") % 5 == 0, "MISSING").otherwise("EXTRACTED").alias("status"), F.when(F.col("doc_id") % 2 == 0, "CONTEXT_FALLBACK").otherwise("HEADING").alias("matched_by"))
    return S.rule_outcomes(R.rules_table(spark), found)


@query(
    "SELECT event_id, array_to_string(list_sort(list_distinct(list_concat(json_keys(props), coalesce(json_keys(CASE WHEN event_id % 3 = 0 THEN '{\"a\":1,\"k\":2}' WHEN event_id % 3 = 1 THEN '{\"z\":1}' END), [])))), ',') AS keys FROM events"
)
def diff_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    other = F.when(F.col("event_id") % 3 == 0, '{"a":1,"k":2}').when(F.col("event_id") % 3 == 1, '{"z":1}')
    as_map = lambda c: F.from_json(c, "map<string,string>")
    return e.select("event_id", F.array_join(S.all_keys(as_map(F.col("props")), as_map(other)), ",").alias("keys"))


@query("SELECT event_id, CASE WHEN json_extract(props, '$.k') IS NULL THEN '{}' ELSE '{\"k\":' || json_extract_string(props, '$.k') || '}' END AS body FROM events")
def typed_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.typed(F.col("props"), "k int, absent string").alias("body"))


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g'), '^ +| +$', '', 'g')) AS clean_sha256 FROM documents")
def pdf_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(S.pdf_clean(F.col("text")).cast("binary"), 256).alias("clean_sha256"))


HEADS = Pattern("id long, text string", [(k, t) for k, t in enumerate(("第一章 ◇总则", "一、目的", "1 范围◇", "1.1 目的", "1.2.3、方法", "2.机构", "正文。", "", None, "第3章", "1" * 90, "十、附则", "3．全角", "1.1.1.1.1 深"))])


@query(
    f"SELECT id, CASE WHEN trim(coalesce(text, '')) = '' OR length(text) > 80 THEN 0 WHEN regexp_matches(text, '^第[一二三四五六七八九十]+[章节篇]') THEN 1 WHEN regexp_matches(text, '^([一二三四五六七八九十]+[、.]|\\d+(?:\\.\\d+){{0,3}}[、.\\s]).{{1,80}}$') THEN CASE WHEN regexp_matches(text, '^\\d+\\.\\d+') THEN 2 ELSE 1 END ELSE 0 END AS level FROM {HEADS.sql()}"
)
def pdf_headings(spark, sf_dir):
    return HEADS.frame(spark, sf_dir).select("id", S.pdf_heading_level(F.col("text")).alias("level"))


@query("SELECT 'lineitem' AS stage, count(*) AS n_rows, round(sum(l_quantity), 2) AS quantity, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem")
def stage_metrics(spark, sf_dir):
    rows, seen = S.measured(table(spark, sf_dir, "lineitem"), "lineitem", n_rows=F.count(F.lit(1)), quantity=F.sum("l_quantity"), returned=F.count_if(F.col("l_returnflag") == "R"))
    written(rows.select("l_orderkey", "l_quantity", "l_returnflag"), "lineitem")
    m = seen.get
    return spark.createDataFrame([("lineitem", m["n_rows"], round(m["quantity"], 2), m["returned"])], "stage string, n_rows long, quantity double, returned long")


@query("SELECT o_orderkey AS plan_id, place FROM (SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey) AS INTEGER) AS place FROM orders) WHERE place <= 100")
def catalog_page(spark, sf_dir):
    """The first page of the catalogue: a limit is what a page is."""
    first = table(spark, sf_dir, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderpriority", "o_orderkey").limit(100)
    return first.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("at"), "o_orderpriority", "o_orderkey"))).alias("rows")).select(F.posexplode("rows").alias("place", "r")).select(F.col("r.o_orderkey").alias("plan_id"), (F.col("place") + 1).alias("place"))
