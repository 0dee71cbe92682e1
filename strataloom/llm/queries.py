"""The registered queries of the training-data operators: thin callers that read a table,
apply the operator and derive the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplanes, cascade, forest, jaccard, jumphash, lattice, maincontent, merkle, runindex, secretscan, trie, warc, winnow
from .common import materialise, scratch_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(_read(spark, sf_dir, "pages"), path)
    records = materialise(warc.read_records(spark, path), "records")  # archives are parsed once
    return warc.pages_of(warc.assemble(records))


def op2_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.remove_repeats(_read(spark, sf_dir, "documents"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.digest(winnow.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by count and checksum, and what decoding them gives back."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    back = lattice.decode(lattice.encode(_read(spark, sf_dir, "documents"), model), model)
    return back.select("doc_id", "n_pieces", "ids_crc32", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return cascade.judge(_read(spark, sf_dir, "documents"), always=base)


def op6_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jumphash.shard_documents(_read(spark, sf_dir, "documents"), 40)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(_read(spark, sf_dir, "documents"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(named(base).cast("binary"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_read(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maincontent.main_text(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op10_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents, path = _read(spark, sf_dir, "documents"), scratch_path(spark, "ids")
    bitplanes.write_ids(documents, public_tokenizers.path("byte_bpe_50k.json"), path)
    return bitplanes.read_ids(spark, path, documents.schema["doc_id"].dataType.simpleString(), with_ids=False)


def op11_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forest.valid(_read(spark, sf_dir, "embeddings"))
    return forest.nearest(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(*trie.rebuilt(trie.turns_of(_read(spark, sf_dir, "conversations")))).drop("opens", "closes")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc_transactions, op2_run_index, op3_winnowing, op4_sentencepiece, op5_quality_cascade, op6_jump_hash, op7_secret_scan, op8_ngram_jaccard, op9_main_text, op10_bit_planes, op11_projection_forest, op12_prefix_trie, op13_merkle_manifest)}

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"

_STEP = "list_reduce([xor({0}, {1}), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"


def crc32_sql(number: str) -> str:
    """CRC-32 of the decimal digits of a number, folded bit by bit."""
    codes = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {_STEP.format('c', 'b')}), 4294967295)"


#: SQL where it can express a query; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op1_warc_transactions": """SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN least_id < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN least_id < page_id THEN least_id END AS refers_to
      FROM (SELECT page_id, h, CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS least_id FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))""",
    "op3_winnowing": f"""WITH d AS (SELECT doc_id, {_TERMS} AS l FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TERMS} AS l FROM benchmark),
      w AS (SELECT DISTINCT item, n, array_to_string(list_slice(l, i, i + n - 1), ' ') AS g FROM (SELECT item, l, least(10, len(l)) AS n, unnest(range(1, len(l) - least(10, len(l)) + 2)) AS i FROM b WHERE len(l) > 0)),
      s AS (SELECT DISTINCT n FROM w),
      x AS (SELECT doc_id, n, i, array_to_string(list_slice(l, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, l, n, unnest(range(1, len(l) - n + 2)) AS i FROM d, s WHERE len(l) >= n)),
      h AS (SELECT doc_id, item, x.n, i FROM x JOIN w ON x.n = w.n AND x.g = w.g),
      p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
      t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
      SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op5_quality_cascade": f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS l, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols FROM documents),
      g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS times FROM (SELECT doc_id, i, array_to_string(list_slice(l, i, i + 7), ' ') AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) - 6)) AS i FROM d WHERE len(l) >= 8))),
      r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM g WHERE times > 1) GROUP BY doc_id),
      f AS (SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(length(array_to_string(l, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(lines) AS n_lines FROM d LEFT JOIN r USING (doc_id))
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 25 * n_words OR (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines) OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept FROM f""",
    "op8_ngram_jaccard": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_ASCII_LOWER)} AS l FROM documents),
      s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(l, i, i + least(5, len(l)) - 1), ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - least(5, len(l)) + 2)) AS i FROM d WHERE len(l) > 0)),
      c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
      p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
      e AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
      r AS (SELECT doc_id, doc_id AS o FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.o = e.a)
      SELECT d.doc_id, coalesce(any_value(c.n), 0) AS n_shingles, min(r.o) AS component_id FROM d LEFT JOIN c USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op12_prefix_trie": f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
      n AS (SELECT conv_id, count(*) AS total FROM t GROUP BY conv_id),
      c AS (SELECT n.conv_id, n.conv_id - n.conv_id % 5 AS p, {crc32_sql("n.conv_id")} % 9 AS h FROM n),
      r AS (SELECT c.conv_id, i + 1 AS d, k, bytes FROM c JOIN t ON t.conv_id = c.p WHERE i < h
        UNION ALL SELECT c.conv_id, i - h + least(h, coalesce(b.total, 0)) + 1, k, bytes FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN n b ON b.conv_id = c.p WHERE i >= h),
      m AS (SELECT conv_id, d, bytes, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS node FROM r),
      v AS (SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, left(node, length(node) - 64) AS parent, any_value(bytes) AS bytes FROM m GROUP BY node, d
        UNION ALL SELECT '', 0, min(conv_id), count(*), NULL, 0 FROM n HAVING count(*) > 0),
      ch AS (SELECT parent AS node, count(*) AS n FROM v GROUP BY parent),
      x AS (SELECT v.*, coalesce(ch.n, 0) AS n_children FROM v LEFT JOIN ch USING (node)),
      sub AS (SELECT a.node, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved FROM x a JOIN x b ON starts_with(b.node, a.node) GROUP BY a.node),
      e AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT n.conv_id, coalesce(max_by(m.node, m.d), '') AS node FROM n LEFT JOIN m USING (conv_id) GROUP BY n.conv_id) GROUP BY node)
      SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
      FROM x JOIN sub USING (node) LEFT JOIN v p ON p.node = x.parent LEFT JOIN e ON e.node = x.node""",
    "op13_merkle_manifest": f"""WITH RECURSIVE f AS (SELECT doc_id, source, text, concat({", ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))}) AS head FROM documents),
      d AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(t) || ':' || t, '-')) AS found
        FROM (SELECT *, CASE WHEN {crc32_sql("doc_id")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS t FROM f)),
      n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i FROM d),
      s AS (SELECT source, 0 AS lev, list(leaf ORDER BY i) AS l FROM n GROUP BY source
        UNION ALL SELECT source, lev + 1, list_transform(range(0, (len(l) + 2) // 3), lambda k: sha256(array_to_string(list_slice(l, 3 * k + 1, 3 * k + 3), ''))) FROM s WHERE len(l) > 1),
      top AS (SELECT source, l[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS si FROM s WHERE len(l) = 1),
      u AS (SELECT 0 AS lev, list(subroot ORDER BY si) AS l FROM top
        UNION ALL SELECT lev + 1, list_transform(range(0, (len(l) + 2) // 3), lambda k: sha256(array_to_string(list_slice(l, 3 * k + 1, 3 * k + 3), ''))) FROM u WHERE len(l) > 1),
      steps AS (SELECT n.doc_id, n.i, s.lev, list_slice(l, 3 * ((i // power) // 3) + 1, i // power) AS lft, list_slice(l, i // power + 2, 3 * ((i // power) // 3) + 3) AS rgt
        FROM (SELECT *, CAST(pow(3, lev) AS BIGINT) AS power FROM s WHERE len(l) > 1) s JOIN n ON n.source IS NOT DISTINCT FROM s.source
        UNION ALL SELECT n.doc_id, n.i, 1000 + lev, list_slice(l, 3 * ((si // power) // 3) + 1, si // power), list_slice(l, si // power + 2, 3 * ((si // power) // 3) + 3)
        FROM (SELECT *, CAST(pow(3, lev) AS BIGINT) AS power FROM u WHERE len(l) > 1) u, top JOIN n ON n.source IS NOT DISTINCT FROM top.source),
      p AS (SELECT doc_id, list(struct_pack(a := array_to_string(lft, ''), b := array_to_string(rgt, '')) ORDER BY lev) AS path FROM steps GROUP BY doc_id),
      o AS (SELECT n.doc_id, leaf, subroot, (SELECT l[1] FROM u WHERE len(l) = 1) AS root, coalesce(path, []) AS path, found FROM n JOIN top ON n.source IS NOT DISTINCT FROM top.source LEFT JOIN p USING (doc_id))
      SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.a || x.b), '')) AS proof_sha256,
        list_reduce(list_prepend(found, list_transform(path, lambda x: x.a || '|' || x.b)), lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2))) AS folded_root, folded_root = root AS verified FROM o""",
}
