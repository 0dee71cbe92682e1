"""Fields of a template from the positioned lines of an image, as one fold a field.

An image's lines become one array in reading order; each field of the template that the image asks
for meets it in a row, so what is held is an image, however many there are. Templates are
configuration of bounded size. A value grows line by line: to the right of its label, or below
it, then along wrapped lines; known labels, gaps and the field's number of rows end it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import small
from . import layout as L

# Shares of the larger height within which two lines are one row; pixels by which a wrapped line may begin
# off its value, and by which a label may stand left of it; how far from its label a licence number may stand.
ROW_SHARE = 0.75
WRAP = 120
LABEL_COLUMN = 220
NUMBER_UP_DOWN = 80
# Labels that bound the region of an unlabelled company name, and labels that may not be part of it.
NUMBER_LABELS = ("编号", "许可证编号", "证书编号")
PRINCIPAL_LABELS = ("主要负责人", "法定代表人", "负责人")
NOT_NAMES = ("编号", "主要负责人", "单位地址", "经济类型", "有效期", "发证机关", "发证日期")
NAME_RIGHT = 500
#: Separators that labels are matched without.
_SEPARATORS = r"[\s:：]"

LINE = "struct<text:string,confidence:double,x_min:double,y_min:double,x_max:double,y_max:double>"


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), _SEPARATORS, "")


def image_lines(lines: DataFrame) -> DataFrame:
    """image_id and ``lines``: its lines that are not blank, by top and left edge. A line without a box stands 30 pixels a line further down."""
    at = F.col("line_idx") * 30.0
    box = F.col("x_min").isNotNull()
    line = F.struct("text", "confidence", *[F.when(box, F.col(c)).otherwise(other).alias(c) for c, other in (("x_min", F.lit(0.0)), ("y_min", at), ("x_max", F.lit(0.0)), ("y_max", at + 20.0))])
    filled = lines.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("line", line)
    ordered = F.sort_array(F.collect_list(F.struct(F.col("line.y_min").alias("y"), F.col("line.x_min").alias("x"), "line_idx", "line")))
    return filled.groupBy("image_id").agg(F.transform(ordered, lambda o: o["line"]).alias("lines"))


def _height(v: Column) -> Column:
    return F.greatest(v["y_max"] - v["y_min"], F.lit(1.0))


def same_row(a: Column, b: Column) -> Column:
    return F.abs((a["y_min"] + a["y_max"]) / 2 - (b["y_min"] + b["y_max"]) / 2) <= F.greatest(_height(a), _height(b)) * ROW_SHARE


def first_label(lines: Column, labels: Column) -> Column:
    """(place, label, inline) of the first line that holds a label, labels in order within a line; null if none does."""

    plain = F.filter(F.transform(labels, lambda l: F.struct(_plain(l).alias("plain"), l.alias("label"))), lambda l: l["plain"] != "")

    def within(norm: Column, place: Column, known: Column) -> Column:
        found = F.filter(F.transform(known, lambda l: F.struct(F.instr(norm, l["plain"]).alias("at"), l.alias("of"))), lambda h: h["at"] > 0)
        return F.transform(found, lambda h: F.struct(place.alias("place"), h["of"]["label"].alias("label"), F.substring(norm, h["at"] + F.length(h["of"]["plain"]), F.length(norm)).alias("inline")))

    return T.let(plain, lambda known: F.get(F.flatten(F.transform(lines, lambda line, place: T.let(_plain(line["text"]), lambda norm: within(norm, place, known)))), F.lit(0)))


def _first_stop(text: Column, stops: Column) -> Column:
    """How many characters, separators aside, stand before the first stop label; null without one."""
    return T.let(_plain(text), lambda norm: F.array_min(F.filter(F.transform(stops, lambda s: F.instr(norm, s) - 1), lambda i: i >= 0)))


def prefix(text: Column, n: Column) -> Column:
    """The text up to its n-th character that is no separator, and separators after it."""
    return F.coalesce(F.regexp_substr(text, F.concat(F.lit(rf"^(?:{_SEPARATORS}*[^\s:：]){{"), n.cast("string"), F.lit(rf"}}{_SEPARATORS}*"))), F.lit(""))


def _state(values: Column, stopped: Column, edge: Column) -> Column:
    return F.struct(values.alias("values"), stopped.alias("stopped"), edge.cast("double").alias("edge"))


def _add(state: Column, line: Column, stops: Column, most: Column, edge: Column) -> Column:
    """The state with the line taken up, cut at a stop label; stopped by one, or by a row too many."""
    values = state["values"]
    rows = F.aggregate(values, F.array().cast(f"array<{LINE}>"), lambda held, v: F.when(F.exists(held, lambda r: same_row(r, v)), held).otherwise(F.concat(held, F.array(v))))
    full = (most > 0) & (F.size(values) > 0) & ~F.exists(values, lambda v: same_row(v, line)) & (F.size(rows) >= most)

    def taken(cut: Column) -> Column:
        kept = F.struct(cut["text"].alias("text"), *[line[c].alias(c) for c in ("confidence", "x_min", "y_min", "x_max", "y_max")])
        return _state(F.when(cut["text"] != "", F.concat(values, F.array(kept))).otherwise(values), cut["stop"].isNotNull(), edge)

    cut = T.let(_first_stop(line["text"], stops), lambda stop: F.struct(stop.alias("stop"), F.trim(F.when(stop.isNull(), line["text"]).otherwise(prefix(line["text"], stop))).alias("text")))
    return F.when(full, _state(values, F.lit(True), state["edge"])).otherwise(T.let(cut, taken))


def _known(line: Column, stops: Column) -> Column:
    return T.let(_plain(line["text"]), lambda norm: F.exists(stops, lambda s: norm.contains(s)))


def _right(state: Column, lines: Column, anchor: Column, place: Column, stops: Column, most: Column) -> Column:
    near = F.filter(F.transform(lines, lambda v, i: F.struct(v["x_min"].alias("x"), i.alias("i"), v.alias("line"))), lambda o: (o["i"] != place) & same_row(o["line"], anchor) & (o["x"] >= anchor["x_max"] - L.OVERLAP))
    on_row = F.array_max(F.transform(F.filter(state["values"], lambda v: same_row(v, anchor)), lambda v: v["x_max"]))

    def step(s: Column, o: Column) -> Column:
        line = o["line"]
        further = F.greatest(s["edge"], line["x_max"])
        return F.when(s["stopped"] | F.array_contains(s["values"], line), s).when(line["x_min"] - s["edge"] > L.RIGHT_GAP, _state(s["values"], F.lit(True), s["edge"])).otherwise(_add(s, line, stops, most, further))

    return F.aggregate(F.sort_array(near), _state(state["values"], state["stopped"], F.coalesce(on_row, anchor["x_max"])), step)


def _gap(anchor: Column) -> Column:
    return F.greatest(_height(anchor) * L.LINE_GAP_HEIGHTS, F.lit(L.LINE_GAP))


def _below(state: Column, lines: Column, anchor: Column, stops: Column, most: Column) -> Column:
    def step(s: Column, line: Column) -> Column:
        ends = _known(line, stops) | (line["y_min"] - s["edge"] > _gap(anchor))
        return F.when(s["stopped"], s).when(ends, _state(s["values"], F.lit(True), s["edge"])).otherwise(_add(s, line, stops, most, F.greatest(s["edge"], line["y_max"])))

    return F.aggregate(F.filter(lines, lambda v: v["y_min"] > anchor["y_min"]), _state(state["values"], state["stopped"], anchor["y_max"]), step)


def _wrapped(state: Column, lines: Column, anchor: Column, stops: Column, most: Column) -> Column:
    begin = F.coalesce(F.array_min(F.transform(state["values"], lambda v: v["x_min"])), anchor["x_max"])
    bottom = F.coalesce(F.array_max(F.transform(state["values"], lambda v: v["y_max"])), anchor["y_max"])

    def step(s: Column, line: Column) -> Column:
        done = _state(s["values"], F.lit(True), s["edge"])
        inside = line["x_min"] >= begin - L.OVERLAP
        return (
            F.when(s["stopped"] | F.array_contains(s["values"], line), s)
            .when(_known(line, stops), F.when(inside | (begin - line["x_max"] <= LABEL_COLUMN), done).otherwise(s))
            .when(line["y_min"] - s["edge"] > _gap(anchor), done)
            .when(inside & (F.abs(line["x_min"] - begin) <= WRAP), _add(s, line, stops, most, F.greatest(s["edge"], line["y_max"])))
            .otherwise(s)
        )

    return F.aggregate(F.filter(lines, lambda v: v["y_min"] > anchor["y_min"]), _state(state["values"], state["stopped"], bottom), step)


def _value(values: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(F.array_join(F.transform(values, lambda v: v["text"]), ""), r"\s+", ""), "^[：:]+", ""), F.lit(""))


def _confidence(values: Column) -> Column:
    """The mean of those there are, 0 without any; null for no value."""
    known = F.filter(F.transform(values, lambda v: v["confidence"]), lambda c: c.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.size(known)
    return F.when(F.size(values) == 0, F.lit(None)).when(F.size(known) == 0, 0.0).otherwise(F.round(mean, 6))


def extract(images: DataFrame, lines: DataFrame, fields: DataFrame) -> DataFrame:
    """image_id, template_code, field, value, confidence, label and ``lines`` (those the value came from) of every field of an image's template.

    images: image_id, template_code. fields: as ``templates.effective`` gives them."""
    labels = fields.groupBy("template_code").agg(F.array_distinct(F.flatten(F.collect_list("labels"))).alias("every"))
    asked = fields.join(labels, "template_code")
    plain = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), _plain), lambda s: s != "")
    asked = asked.withColumn("stops", F.array_except(F.array_union(plain(F.col("every")), plain(F.col("stop_labels"))), plain(F.col("labels"))))
    rows = images.select("image_id", "template_code").join(image_lines(lines), "image_id", "left").join(small(asked), "template_code")
    rows = rows.withColumn("lines", F.coalesce("lines", F.array().cast(f"array<{LINE}>"))).withColumn("hit", first_label(F.col("lines"), F.col("labels")))
    line, stops, most, place = F.col("lines"), F.col("stops"), F.coalesce("max_lines", F.lit(0)), F.col("hit.place")
    anchor = F.get("lines", "hit.place")
    rows = rows.withColumn("anchor", anchor)
    anchor = F.col("anchor")
    none = _state(F.array().cast(f"array<{LINE}>"), F.lit(False), F.lit(0.0))
    inline = F.struct(F.col("hit.inline").alias("text"), *[anchor[c].alias(c) for c in ("confidence", "x_min", "y_min", "x_max", "y_max")])
    has_inline = F.trim(F.col("hit.inline")) != ""
    right = F.lower("direction") == "right"
    # Each step is a column of its own, so that none is computed twice.
    rows = rows.withColumn("s0", F.when(has_inline, _add(none, inline, stops, most, F.lit(0.0))).otherwise(none))
    on = F.when(F.col("s0.stopped") | (has_inline & ~right), F.col("s0")).when(F.lower("direction") == "below", _below(F.col("s0"), line, anchor, stops, most)).otherwise(_right(F.col("s0"), line, anchor, place, stops, most))
    rows = rows.withColumn("s1", on)
    rows = rows.withColumn("s2", F.when(F.coalesce("merge_wrapped", F.lit(False)) & ~F.col("s1.stopped"), _wrapped(F.col("s1"), line, anchor, stops, most)).otherwise(F.col("s1")))
    values = F.when(F.col("hit").isNull(), none["values"]).otherwise(F.col("s2.values"))
    return rows.select("image_id", "template_code", "processor", "field", _value(values).alias("value"), _confidence(values).alias("confidence"), F.when(F.size(values) > 0, F.col("hit.label")).alias("label"), F.transform(values, lambda v: v["text"]).alias("sources"), "pattern", "min_confidence", "lines")


def _near_number(lines: Column) -> Column:
    """The lines right of a number's label and not far above or below it, from left to right; null without the label."""
    hit = first_label(lines, F.array(*[F.lit(x) for x in NUMBER_LABELS]))

    def of(anchor: Column, place: Column) -> Column:
        middle = lambda v: (v["y_min"] + v["y_max"]) / 2
        near = F.filter(
            F.transform(lines, lambda v, i: F.struct(v["x_min"].alias("x"), i.alias("i"), v.alias("line"))),
            lambda o: (o["i"] != place) & (o["x"] >= anchor["x_max"] - L.OVERLAP) & (F.abs(middle(o["line"]) - middle(anchor)) <= NUMBER_UP_DOWN) & (o["x"] - anchor["x_max"] <= 2 * L.RIGHT_GAP),
        )
        return F.transform(F.sort_array(near), lambda o: o["line"])

    return T.let(hit, lambda h: F.when(h.isNotNull(), of(F.get(lines, h["place"]), h["place"])))


def _unlabelled_name(lines: Column) -> Column:
    """The lines between the labels of the number and of the principal."""
    labels = lambda names: F.array(*[F.lit(x) for x in names])
    place = lambda names: first_label(lines, labels(names))["place"]

    def of(ends: Column) -> Column:
        top, low = F.get(lines, ends["top"]), F.get(lines, ends["low"])
        inside = F.filter(
            lines,
            lambda v: (v["y_min"] > top["y_max"]) & (v["y_max"] < low["y_min"] + _height(low)) & (v["x_min"] < low["x_max"] + NAME_RIGHT) & ~_known(v, labels(NOT_NAMES)),
        )
        return F.when(ends["top"].isNotNull() & ends["low"].isNotNull() & (F.size(inside) > 0), inside)

    return T.let(F.struct(place(NUMBER_LABELS).alias("top"), place(PRINCIPAL_LABELS).alias("low")), of)


def finish(extracted: DataFrame) -> DataFrame:
    """image_id, template_code, field, value, confidence, label and status of every field.

    Templates of the safety-licence processor (named so, or that of the template) try harder: an empty licence number is looked for in
    all text, near its label and in all text run together, an empty company name between its neighbours' labels; then values are repaired."""
    licence = (F.lower("template_code") == "safety_license") | (F.lower(F.coalesce("processor", F.lit(""))) == "safety-license")
    lost = licence & (F.coalesce("value", F.lit("")) == "")
    run = lambda c: F.array_join(F.transform(c, lambda v: v["text"]), "")
    rows = extracted.withColumn("name_lines", F.when(lost & (F.col("field") == "enterpriseName"), _unlabelled_name(F.col("lines"))))
    rows = rows.withColumn("near", F.when(lost & (F.col("field") == "licenseNumber"), _near_number(F.col("lines")))).withColumn("whole", F.when(lost & (F.col("field") == "licenseNumber"), L.licence_number(run(F.col("lines")))))
    near = F.when(F.col("whole").isNull(), L.licence_number(run(F.col("near"))))
    rows = rows.withColumn("confidence", F.when(F.col("name_lines").isNotNull(), _confidence(F.col("name_lines"))).when(near.isNotNull(), _confidence(F.col("near"))).otherwise(F.col("confidence")))
    rows = rows.withColumn("value", F.coalesce(F.when(F.col("name_lines").isNotNull(), _value(F.col("name_lines"))), F.col("whole"), near, F.col("value")))
    field, value = F.col("field"), F.col("value")
    repaired = (
        F.when(field == "licenseNumber", L.licence_number(value))
        .when(field == "enterpriseName", L.company_name(value))
        .when(field == "validPeriod", L.date_range(value))
        .when(field == "issueDate", L.single_date(L.repair_date(value)))
    )
    rows = rows.withColumn("value", F.when(licence, F.coalesce(F.nullif(repaired, F.lit("")), value)).otherwise(value))
    return rows.select("image_id", "template_code", "field", "value", "confidence", "label", L.field_status(F.col("value"), F.col("confidence"), F.col("pattern"), F.col("min_confidence")).alias("status"))
