"""Queries over response levels and action groups, on inline texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import Pattern
from ..functions import text as T
from ..operators import levels as L
from ..operators import measures as M
from ..operators import response as R
from ..operators import rules
from ..tables import written
from .blocks import _sql_normalize
from .register import Register

REGISTER = Register()
query = REGISTER.query

TEXTS = Pattern(
    "doc_id long, block_idx int, page int, heading_level int, text string",
    [
        (1, 0, 1, 1, "1 总则"), (1, 1, 1, 2, "一级响应"), (1, 2, 1, 0, "启动条件"), (1, 3, 2, 0, "发生特别重大◇事故，死亡三十人以上"), (1, 4, 2, 0, "响应措施"), (1, 5, 2, 0, "组织开展◇全面救援"),
        (1, 6, 2, 2, "二级响应"), (1, 7, 3, 0, "预计达到橙色标准"), (1, 8, 3, 0, "派出专家指导"), (1, 9, 3, 0, "加强会商调度"), (1, 10, 3, 1, "后期处置"), (1, 11, 3, 0, "总结评估"),
        (2, 0, 1, 0, "应对特别重大◇地质灾害时，启动一级应急响应。"), (2, 1, 1, 0, "针对重大地质灾害，启动二级响应；"), (2, 2, 1, 0, "特别重大◇地质灾害为I级，主要指死亡三十人以上的灾害。"), (2, 3, 1, 0, "重大地质灾害为II级，是指死亡十人以上的灾害。"),
        (2, 4, 1, 0, "处置较大◇险情，必要时启动三级响应。"), (2, 5, 1, 0, "一般险情应急响应为第Ⅳ级。"), (2, 6, 2, 0, "响应分为一、二、三级响应"),
        (3, 0, 4, 0, "综合协调组：由◇应急局牵头，主要负责信息汇总。"), (3, 1, 9, 0, "（2）医疗救护组"), (3, 2, 9, 0, "指挥部下设抢险救援、医疗救护和后勤保障等工作组"), (3, 3, 9, 0, "综合协调组：负责对外联络。"), (3, 4, 9, 0, "普通一句话"),
    ],
)


def _frame(spark, sf_dir):
    return TEXTS.frame(spark, sf_dir)


_NORM = _sql_normalize("text")
_ORD = "CASE upper(trim(replace({0}, '级', ''))) WHEN '一' THEN 1 WHEN '1' THEN 1 WHEN 'I' THEN 1 WHEN '二' THEN 2 WHEN '2' THEN 2 WHEN 'II' THEN 2 WHEN '三' THEN 3 WHEN '3' THEN 3 WHEN 'III' THEN 3 WHEN '四' THEN 4 WHEN '4' THEN 4 WHEN 'IV' THEN 4 ELSE 0 END"
_TOK = "(IV|III|II|I|[一二三四1-4])"


TOKENS = Pattern("token string", [(t,) for t in ("一级", "Ⅱ", "iii", "4级", " I级 ", "五级", "", "◆级", "◇级")], keys=())


@query("SELECT token, CAST(" + _ORD.format("replace(replace(replace(replace(token, 'Ⅰ', 'I'), 'Ⅱ', 'II'), 'Ⅲ', 'III'), 'Ⅳ', 'IV')") + f" AS INTEGER) AS ordinal FROM {TOKENS.sql()}")
def level_ordinals(spark, sf_dir):
    tokens = TOKENS.frame(spark, sf_dir)
    return tokens.select("token", T.level_ordinal(F.col("token")).alias("ordinal"))


@query(
    f"""SELECT doc_id, block_idx, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS targets FROM (SELECT DISTINCT doc_id, block_idx, {_ORD.format("t")} AS o FROM (
      SELECT doc_id, block_idx, unnest(regexp_extract_all(s, '{_TOK}级', 1)) AS t FROM (SELECT doc_id, block_idx, unnest(regexp_extract_all({_NORM}, '(?:启动|实施|进入|发布).{{0,40}}?(?:响应|预警)')) AS s FROM {TEXTS.sql()}))) WHERE o > 0 GROUP BY doc_id, block_idx"""
)
def activation_targets(spark, sf_dir):
    return _frame(spark, sf_dir).select("doc_id", "block_idx", F.array_join(T.activation_targets(F.col("text")).cast("array<string>"), ",").alias("targets")).where("targets <> ''")


@query(
    f"""SELECT doc_id, block_idx, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS levels FROM (SELECT DISTINCT doc_id, block_idx, {_ORD.format("t")} AS o FROM (
      SELECT doc_id, block_idx, unnest(regexp_extract_all(n, '{_TOK}级\\p{{Han}}{{0,12}}(?:响应|反应)', 1)) AS t FROM (SELECT *, {_NORM} AS n FROM {TEXTS.sql()})
      UNION ALL SELECT doc_id, block_idx, unnest(regexp_split_to_array(s, '[、,，/和及与]')) FROM (SELECT doc_id, block_idx, unnest(regexp_extract_all({_NORM}, '({_TOK}(?:级)?(?:[、,，/和及与]{_TOK}(?:级)?)+)(?:共[一二三四1-4]级)?(?:应急)?(?:响应|反应)', 1)) AS s FROM {TEXTS.sql()}))) WHERE o > 0 GROUP BY doc_id, block_idx"""
)
def level_mentions(spark, sf_dir):
    return _frame(spark, sf_dir).select("doc_id", "block_idx", F.array_join(L.mentions(F.col("text")).cast("array<string>"), ",").alias("levels")).where("levels <> ''")


_CLAUSES = f"(SELECT doc_id, block_idx, {_sql_normalize('clause')} AS n FROM (SELECT doc_id, block_idx, unnest(regexp_extract_all(text, '[^。；;\\r\\n]+[。；;]?')) AS clause FROM {TEXTS.sql()}))"
_FWD = "(?:应对|针对|处置)(.{2,80}?)(?:时)?[，,]?(?:启动|实施|进入)(.{0,40}?)(?:应急)?(?:响应|反应)"
_INV = f"(.{{2,80}}?)(?:应急)?(?:响应|反应)(?:等级)?为(?:第)?{_TOK}级"
_SQL_BRIDGES = f"""(SELECT * FROM (
    SELECT doc_id, block_idx, regexp_replace(regexp_extract(n, '{_FWD}', 1), '^[，,。；;]+|[，,。；;]+$', '', 'g') AS subject, CAST({_ORD.format(f"regexp_extract(regexp_extract(n, '{_FWD}'), '{_TOK}级', 1)")} AS INTEGER) AS ordinal
    FROM {_CLAUSES} WHERE regexp_matches(n, '{_FWD}') AND NOT regexp_matches(n, '{T.ADJUSTMENTS}|视情')
    UNION ALL SELECT doc_id, block_idx, regexp_replace(regexp_extract(n, '{_INV}', 1), '^\\d+(\\.\\d+){{0,4}}[、.]?', ''), CAST({_ORD.format(f"regexp_extract(n, '{_INV}', 2)")} AS INTEGER)
    FROM {_CLAUSES} WHERE regexp_matches(n, '{_INV}') AND NOT regexp_matches(n, '{T.ADJUSTMENTS}|视情')) WHERE length(subject) >= 2 AND ordinal > 0)"""
_CLS = f"^(.{{2,80}}?)(?:划分为|确定为|为){_TOK}级(?:，|,)?(?:主要指|是指|包括|指)?(.*)$"
_SQL_CLASSES = f"(SELECT doc_id, block_idx, regexp_extract(n, '{_CLS}', 1) AS label, CAST({_ORD.format(f'''regexp_extract(n, '{_CLS}', 2)''')} AS INTEGER) AS ordinal, regexp_extract(n, '{_CLS}', 3) AS threshold FROM {_CLAUSES} WHERE regexp_matches(n, '{_CLS}') AND n NOT LIKE '%响应%')"


@query(f"SELECT * FROM {_SQL_BRIDGES}")
def bridge_extract(spark, sf_dir):
    return L.bridges(_frame(spark, sf_dir))


@query(f"SELECT * FROM {_SQL_CLASSES}")
def classification_definitions(spark, sf_dir):
    return L.classifications(_frame(spark, sf_dir))


@query(
    f"""SELECT doc_id, block_idx, subject, ordinal, CASE WHEN score > 0 THEN label END AS label, CASE WHEN score > 0 THEN threshold END AS threshold, CASE WHEN score > 0 THEN score END AS score FROM (
      SELECT b.*, c.label, c.threshold, CAST(CASE WHEN contains(c.label, b.subject) AND b.subject NOT LIKE '%特别重大%' AND b.subject LIKE '%重大%' AND c.label LIKE '%特别重大%' THEN -1
        WHEN contains(c.label, b.subject) THEN 200 + length(b.subject) ELSE -1 END AS INTEGER) AS score,
        row_number() OVER (PARTITION BY b.doc_id, b.block_idx, b.subject, b.ordinal ORDER BY CASE WHEN contains(c.label, b.subject) AND NOT (b.subject NOT LIKE '%特别重大%' AND b.subject LIKE '%重大%' AND c.label LIKE '%特别重大%') THEN 0 ELSE 1 END, c.block_idx) AS k
      FROM {_SQL_BRIDGES} b LEFT JOIN {_SQL_CLASSES} c USING (doc_id)) WHERE k = 1"""
)
def classification_best_match(spark, sf_dir):
    blocks = _frame(spark, sf_dir)
    return L.best_classification(L.bridges(blocks), L.classifications(blocks))


TAILS = list(rules.aliases("TAIL")["response_tail"])
KNOWN = R.levels(rules.aliases("RESPONSE", "WARNING"))
MARKERS = rules.aliases("MARKER")


def _plan(spark, sf_dir):
    return _frame(spark, sf_dir).withColumn("is_table", F.lit(False))


@query()
def level_window_classify(spark, sf_dir):
    """What every block of a level's window is; tested by golden cases."""
    known = written(R.described(_plan(spark, sf_dir), TAILS, KNOWN, MARKERS), "described")
    anchors = written(R.mentions(known, KNOWN).where("role = 'ANCHOR'"), "anchors")
    return R.classified(R.windows(known, anchors)).select("doc_id", "key", "block_idx", "kind", "structured", "text")


@query()
def level_segments(spark, sf_dir):
    """Eight rows a document; tested by golden cases."""
    return R.segments(_plan(spark, sf_dir), TAILS, KNOWN, MARKERS).withColumn("inherits", F.array_join("inherits", ","))


@query()
def level_complaints(spark, sf_dir):
    return R.complaints(R.segments(_plan(spark, sf_dir), TAILS, KNOWN, MARKERS))


MEASURES = Pattern(
    "doc_id long, ordinal int, conditions string, measures string",
    [(1, 1, "c1", "全面救援◇\n在二级响应措施基础上加强"), (1, 2, "c2", "派出专家\n在Ⅲ级响应的基础上调度"), (1, 3, None, "会商"), (1, 4, None, None), (2, 1, "x", "在二级响应基础上甲"), (2, 2, "y", "在一级响应基础上乙")],
)


@query(
    f"""SELECT DISTINCT doc_id, ordinal, CAST({_ORD.format("t")} AS INTEGER) AS source FROM (SELECT doc_id, ordinal, unnest(regexp_extract_all({_sql_normalize("measures")}, '{_TOK}级(?:应急)?响应.{{0,20}}基础上', 1)) AS t FROM {MEASURES.sql()}) WHERE {_ORD.format("t")} NOT IN (0, ordinal)"""
)
def measure_inheritance(spark, sf_dir):
    return L.inheritance(MEASURES.frame(spark, sf_dir))


@query(
    f"""WITH RECURSIVE m AS {MEASURES.sql()}, link AS (SELECT DISTINCT doc_id, ordinal, CAST({_ORD.format("t")} AS INTEGER) AS source FROM (SELECT doc_id, ordinal, unnest(regexp_extract_all({_sql_normalize("measures")}, '{_TOK}级(?:应急)?响应.{{0,20}}基础上', 1)) AS t FROM m)),
      walk AS (SELECT doc_id, ordinal, source, 1 AS depth FROM link WHERE source <> ordinal UNION ALL SELECT w.doc_id, w.ordinal, l.source, w.depth + 1 FROM walk w JOIN link l ON l.doc_id = w.doc_id AND l.ordinal = w.source WHERE l.source <> w.ordinal AND w.depth < 3),
      parts AS (SELECT doc_id, ordinal, source, max(depth) AS depth FROM walk GROUP BY ALL UNION ALL SELECT doc_id, ordinal, ordinal, 0 FROM m),
      lines AS (SELECT p.doc_id, p.ordinal, depth, source, unnest(string_split(measures, chr(10))) AS line, unnest(range(len(string_split(measures, chr(10))))) AS i FROM parts p JOIN m ON m.doc_id = p.doc_id AND m.ordinal = p.source WHERE measures IS NOT NULL)
    SELECT doc_id, ordinal, string_agg(line, chr(10) ORDER BY depth DESC, source, i) AS effective FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ordinal, line ORDER BY depth DESC, source, i) AS k FROM lines) WHERE k = 1 GROUP BY doc_id, ordinal"""
)
def effective_measures(spark, sf_dir):
    levels = MEASURES.frame(spark, sf_dir)
    return L.effective_measures(levels, L.inheritance(levels))


COMMONS = Pattern(
    "doc_id long, block_idx int, page int, heading_level int, text string",
    [
        (1, 0, 5, 1, "应急响应"), (1, 1, 5, 2, "5.1 一级响应"), (1, 2, 5, 0, "启动条件"), (1, 3, 5, 0, "发生特别重大◇险情。"), (1, 4, 5, 0, "响应措施"), (1, 5, 5, 0, "调度◇救援队伍。"), (1, 6, 5, 2, "5.2 二级响应"), (1, 7, 5, 0, "派出◇工作人员。"),
        (1, 8, 6, 2, "5.3 共同响应措施"), (1, 9, 6, 0, "及时发布◇信息。"), (1, 10, 6, 0, "开展损失评估。"), (1, 11, 6, 3, "5.3.1 响应程序"), (1, 12, 6, 0, "报告◇。"), (1, 13, 6, 0, "三级响应另行通知。"), (1, 14, 6, 0, "通报。"), (1, 15, 6, 1, "6 附则"), (1, 16, 7, 1, "7 处置措施"), (1, 17, 7, 0, "无。"),
    ],
)
_TITLE = "regexp_replace(regexp_replace(n, '^\\d+(\\.\\d+){0,4}[、.]?', ''), '^[一二三四五六七八九十]+[、.]', '')"


@query(
    f"""WITH t AS (SELECT *, {_TITLE} AS title, regexp_matches(n, '[一二三四]级响应') AS names, regexp_matches(n, '{"|".join(TAILS)}') OR n IN ('一级响应', '二级响应', '三级响应', '四级响应') AS bound FROM (SELECT *, {_sql_normalize("text")} AS n FROM {COMMONS.sql()})),
      m AS (SELECT * FROM t WHERE NOT names AND (heading_level > 0 OR regexp_matches(n, '^((启动|响应|发布)?条件|响应措施|应急措施|处置措施|协调措施)$')) AND ((length(title) <= 30 AND NOT regexp_matches(title, '[，,。！？!?]')
          AND (regexp_matches(title, '(共同|共性)(响应|应急|处置)?(措施|行动|程序)$|一般程序|基本程序|响应程序|应急处置') OR (heading_level BETWEEN 1 AND 2 AND regexp_matches(title, '(响应|处置)措施$')))) OR (heading_level BETWEEN 1 AND 2 AND regexp_matches(n, '响应行动|反应行动')))),
      x AS (SELECT t.doc_id, m.block_idx AS start, t.block_idx, t.text, max(CASE WHEN t.names OR t.bound OR (t.heading_level > 0 AND t.heading_level <= CASE WHEN m.heading_level > 0 THEN m.heading_level ELSE 3 END) THEN 1 ELSE 0 END) OVER (PARTITION BY t.doc_id, m.block_idx ORDER BY t.block_idx) AS over
        FROM m JOIN t ON t.doc_id = m.doc_id AND t.block_idx > m.block_idx AND t.block_idx < m.block_idx + 30),
      y AS (SELECT *, max(CASE WHEN regexp_matches(text, '{T.RESPONSE_ACTIONS}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, start) AS active FROM x WHERE over = 0)
    SELECT doc_id, 'EMERGENCY' AS category, start, block_idx, text FROM y WHERE active = 1"""
)
def common_measures(spark, sf_dir):
    """The blocks that all response levels of a plan share."""
    b = R.described(COMMONS.frame(spark, sf_dir).withColumn("is_table", F.lit(False)), TAILS, KNOWN, MARKERS)
    b = written(b.select("doc_id", "block_idx", "text", "norm", "heading", "heading_level", "tail", "keys", "nearest"), "described")  # read for starts and for texts
    responses = tuple(a for v in KNOWN if v.category == "EMERGENCY" for a in v.aliases)
    return M.common_blocks(b, responses, {c: R._compatible(c) for c in ("WARNING", "EMERGENCY")})


GROUPS = Pattern("name string", [("综合协调组",), ("综合 协调组：",), ("医疗救护组",), ("◇组",), ("（◇ 一）组。",)], keys=())


@query(f"SELECT name, 'action_group_' || substr(sha256(regexp_replace(name, '[\\s:：。；;（）()、，,]', '', 'g')), 1, 16) AS group_key FROM {GROUPS.sql()}")
def action_group_key(spark, sf_dir):
    return GROUPS.frame(spark, sf_dir).select("name", T.group_key(F.col("name")).alias("group_key"))


@query()
def action_groups(spark, sf_dir):
    return L.action_groups(_frame(spark, sf_dir))
