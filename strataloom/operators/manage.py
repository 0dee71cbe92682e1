"""Results under management: keyed differences, coverage, reviews, samples, catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

def nesting(c: Column) -> Column:
    """How many containers of a JSON text lie within each other at most; those in strings do not count."""
    marks = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\.", ""), '"[^"]*"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, mark: Column) -> Column:
        now = at["now"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(F.split(marks, ""), start, step, lambda at: at["most"])


def flatten(results: DataFrame, id_column: str = "result_id", json: str = "result") -> DataFrame:
    """(id, path, value) of every value of a JSON result, containers with null values: fields by name, elements of keyed lists by their ``key``; other lists are values. As many levels as the deepest result has; one job finds how many."""
    depth = results.select(F.max(nesting(F.col(json)))).first()[0] or 0
    v = results.select(F.col(id_column).alias("id"), F.parse_json(json).alias("v"), F.lit("").alias("path"))
    out = None
    for _ in range(depth + 1):
        kind = F.schema_of_variant("v")
        held = v.withColumn("kind", kind)
        keyed = F.try_variant_get("v", "$", "array<variant>")
        keys = F.transform(keyed, lambda e: F.try_variant_get(e, "$.key", "string"))
        is_keyed = F.col("kind").startswith("ARRAY") & F.coalesce(F.forall(keys, lambda k: k.isNotNull()) & (F.size(F.array_distinct(keys)) == F.size(keys)), F.lit(False))
        held = held.withColumn("is_keyed", is_keyed).withColumn("is_map", F.col("kind").startswith("OBJECT"))
        values = held.select("id", "path", F.when(F.col("is_map") | F.col("is_keyed"), F.lit(None).cast("string")).otherwise(F.to_json("v")).alias("value"), (F.col("is_map") | F.col("is_keyed")).alias("container"))
        out = values if out is None else out.unionByName(values)
        child = lambda name: F.when(F.col("path") == "", name).otherwise(F.concat(F.col("path"), F.lit("."), name))
        entry = lambda k, x: F.struct(k.alias("k"), x.alias("v"))
        fields = F.transform(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), lambda e: entry(e["key"], e["value"]))
        items = F.transform(keyed, lambda e: entry(F.try_variant_get(e, "$.key", "string"), e))
        inner = held.select("id", "path", F.explode(F.when(F.col("is_map"), fields).when(F.col("is_keyed"), items)).alias("e"))
        v = inner.select("id", F.col("e.v").alias("v"), child(F.col("e.k")).alias("path")).where("v is not null")
    return out


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, path, change_type, before, after): ADDED, REMOVED or MODIFIED values between the results with one id, which is unique on each side. A subtree that is there on one side only is one change, at its top."""
    b, a = (flatten(df).select("id", "path", F.col("value").alias(n), F.col("container").alias("c_" + n)) for df, n in ((before, "before"), (after, "after")))
    both = b.join(a, ["id", "path"], "full_outer")
    has_b, has_a = F.col("c_before").isNotNull(), F.col("c_after").isNotNull()
    kind = F.when(~has_b, "ADDED").when(~has_a, "REMOVED").when((F.col("c_before") != F.col("c_after")) | ~F.col("before").eqNullSafe(F.col("after")), "MODIFIED")
    changed = both.withColumn("change_type", kind).where("change_type is not null")
    tops = changed.where(F.col("change_type").isin("ADDED", "REMOVED") | (F.col("c_before") != F.col("c_after"))).select(F.col("id").alias("_id"), F.col("path").alias("_top"))
    below = changed.join(tops, F.expr("id = _id and path <> _top and (_top = '' or startswith(path, concat(_top, '.')))"), "left_anti")
    return below.select("id", F.when(F.col("path") == "", "$").otherwise(F.col("path")).alias("path"), "change_type", "before", "after")


def export_rows(changes: DataFrame) -> DataFrame:
    """Changes as rows of a sheet: values of at most 32,767 characters, those cut ending in three dots."""
    return changes.select("path", "change_type", *[T.clip(F.col(c), 32_767, "...").alias(c) for c in ("before", "after")])


def coverage(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per doc_id: required, matched, missing and unexpected items, and the percentage matched (two digits, half up; 100 if none is required). Both sides: doc_id, item."""
    e, a = (df.select("doc_id", "item").distinct().withColumn(n, F.lit(True)) for df, n in ((expected, "e"), (actual, "a")))
    both = e.join(a, ["doc_id", "item"], "full_outer")
    names = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("item")))), ",")
    has_e, has_a = F.col("e").isNotNull(), F.col("a").isNotNull()
    out = both.groupBy("doc_id").agg(F.count_if(has_e).alias("required"), F.count_if(has_e & has_a).alias("matched"), names(has_e & ~has_a).alias("missing"), names(~has_e & has_a).alias("unexpected"))
    percent = F.when(F.col("required") == 0, F.lit(100.0)).otherwise(F.round(F.col("matched") * 100.0 / F.col("required"), 2))
    return out.withColumn("percent", percent)


def number_reviews(reviews: DataFrame) -> DataFrame:
    """Reviews with their revision number within the task."""
    return reviews.withColumn("revision_number", F.row_number().over(Window.partitionBy("task_id").orderBy("created_at", "review_id")))


def active_samples(samples: DataFrame) -> DataFrame:
    """Samples with their status: the newest of a task is ACTIVE, those before it ARCHIVED since its creation."""
    w = Window.partitionBy("task_id").orderBy("created_at", "sample_id")
    nxt = F.lead("created_at").over(w)
    return samples.withColumn("archived_at", nxt).withColumn("status", F.when(nxt.isNull(), "ACTIVE").otherwise("ARCHIVED"))


def evaluations(replays: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per replayed task with the active sample of the task it repeats; replays of tasks without one are left out."""
    active = active_samples(samples).where("status = 'ACTIVE'").select(F.col("task_id").alias("retry_of_task_id"), "sample_id")
    return replays.join(active, "retry_of_task_id").dropDuplicates(["task_id"])


def catalogue(catalog: DataFrame, tasks: DataFrame) -> DataFrame:
    """Catalogued plans, and for plans that only tasks know one row from their latest task."""
    w = Window.partitionBy("plan_id").orderBy(F.col("updated_at").desc(), F.col("task_id").desc())
    last = tasks.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    fallback = last.join(catalog, "plan_id", "left_anti").select("plan_id", T.or_default(F.regexp_replace("file_name", r"\.[^.]*$", ""), F.col("plan_id").cast("string")).alias("plan_name"), F.lit(False).alias("catalogued"))
    return catalog.select("plan_id", "plan_name", F.lit(True).alias("catalogued")).unionByName(fallback)


def upsert(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """The catalogue after changes: the last row of each plan, a change winning over what was there."""
    rows = catalog.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("plan_id").orderBy(F.col("_new").desc(), F.col("updated_at").desc())
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")


def valid_plan_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9._-]{1,64}$")


def audit_value(c: Column) -> Column:
    """A header's value for the audit log: a dash if it is absent, too long or holds other characters."""
    return F.when(c.rlike(r"^[A-Za-z0-9._:@/-]{1,128}$"), c).otherwise("-")


def valid_template_code(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9_-]{1,64}$")


def valid_url(c: Column) -> Column:
    """An address of the web, with a host."""
    return c.rlike(r"^(?i:https?)://[^\s/?#]+\S*$")


def created(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """What became of requests (plan_id, request_id, name, code, category, department, version) for new entries: CREATED with the entry's
    values, blank ones replaced, INVALID_REQUEST without a valid plan_id or a name, PLAN_ALREADY_EXISTS where the catalogue or an earlier request has the plan."""
    valid = valid_plan_id(F.coalesce("plan_id", F.lit(""))) & (F.trim(F.coalesce("name", F.lit(""))) != "")
    there = catalog.select("plan_id", F.lit(True).alias("_there")).distinct()
    first = F.min(F.when(valid, F.col("request_id"))).over(Window.partitionBy("plan_id"))
    rows = requests.withColumn("_valid", valid).withColumn("_first", first).join(there, "plan_id", "left")
    outcome = F.when(~F.col("_valid"), "INVALID_REQUEST").when(F.col("_there") | (F.col("request_id") != F.col("_first")), "PLAN_ALREADY_EXISTS").otherwise("CREATED")
    values = {"plan_code": T.or_default(F.col("code"), F.col("plan_id")), "plan_name": F.trim("name"), "category": T.or_default(F.col("category"), F.lit("未分类")), "responsible_department": T.or_default(F.col("department"), F.lit("未配置")), "version_label": T.or_default(F.col("version"), F.lit("未标注"))}
    rows = rows.withColumn("outcome", outcome)
    return rows.select("plan_id", "request_id", "outcome", *[F.when(F.col("outcome") == "CREATED", v).alias(k) for k, v in values.items()])
