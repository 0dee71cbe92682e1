"""Field extraction against a plain version, line by line, on the registered images and on random ones."""

import random
import re

import pytest

from strataloom.operators import fields as X
from strataloom.operators import templates
from strataloom.fixtures import Fixture
from strataloom.plans import fields as P

PLAIN = re.compile(r"[\s:：]")


def plain(text):
    return PLAIN.sub("", text or "")


def same_row(a, b):
    height = max(a["y1"] - a["y0"], b["y1"] - b["y0"], 1)
    return abs((a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2) <= 0.75 * height


class Field:
    def __init__(self, lines, labels, stops, most):
        self.lines, self.labels, self.stops, self.most = lines, labels, stops, most
        self.values, self.stopped = [], False

    def add(self, line):
        rows = []
        for v in self.values:
            if not any(same_row(r, v) for r in rows):
                rows.append(v)
        if self.most > 0 and self.values and not any(same_row(v, line) for v in self.values) and len(rows) >= self.most:
            self.stopped = True
            return
        at = min((plain(line["text"]).index(s) for s in self.stops if s in plain(line["text"])), default=None)
        text = line["text"]
        if at is not None:
            out, n = "", 0
            for c in text:
                if not PLAIN.match(c):
                    if n == at:
                        break
                    n += 1
                out += c
            text, self.stopped = out, True
        if text.strip():
            self.values.append(line | {"text": text.strip()})

    def known(self, line):
        return any(s in plain(line["text"]) for s in self.stops)

    def right(self, anchor):
        edge = max((v["x1"] for v in self.values if same_row(v, anchor)), default=anchor["x1"])
        for line in sorted((x for x in self.lines if x is not anchor and same_row(x, anchor) and x["x0"] >= anchor["x1"] - 20), key=lambda x: x["x0"]):
            if self.stopped:
                return
            if line["x0"] - edge > 320:
                self.stopped = True
                return
            self.add(line)
            edge = max(edge, line["x1"])

    def below(self, anchor):
        edge = anchor["y1"]
        for line in self.lines:
            if line["y0"] > anchor["y0"] and not self.stopped:
                if self.known(line) or line["y0"] - edge > max(2.5 * max(anchor["y1"] - anchor["y0"], 1), 80):
                    self.stopped = True
                    return
                self.add(line)
                if not self.stopped:
                    edge = max(edge, line["y1"])

    def wrapped(self, anchor):
        begin = min((v["x0"] for v in self.values), default=anchor["x1"])
        edge = max((v["y1"] for v in self.values), default=anchor["y1"])
        for line in self.lines:
            if line["y0"] <= anchor["y0"] or line in self.values:
                continue
            if self.known(line):
                if line["x0"] >= begin - 20 or begin - line["x1"] <= 220:
                    return
                continue
            if line["y0"] - edge > max(2.5 * max(anchor["y1"] - anchor["y0"], 1), 80):
                return
            if line["x0"] >= begin - 20 and abs(line["x0"] - begin) <= 120:
                self.add(line)
                if self.stopped:
                    return
                edge = max(edge, line["y1"])


def extracted(lines, template, field):
    labels, stops = field["labels"], {plain(x) for f in template for x in f["labels"]} | {plain(x) for x in field["stop_labels"] or ()}
    stops -= {plain(x) for x in labels}
    hit = next(((line, label) for line in lines for label in labels if plain(label) in plain(line["text"])), None)
    if hit is None:
        return None, None, None
    anchor, label = hit
    run = Field(lines, labels, stops, field["max_lines"])
    inline = plain(anchor["text"]).split(plain(label), 1)[1]
    if inline:
        run.add(anchor | {"text": inline})
        if not run.stopped and field["direction"] == "right":
            run.right(anchor)
    elif field["direction"] == "below":
        run.below(anchor)
    else:
        run.right(anchor)
    if field["merge_wrapped"] and not run.stopped:
        run.wrapped(anchor)
    if not run.values:
        return None, None, None
    value = re.sub("^[:：]+", "", re.sub(r"\s+", "", "".join(v["text"] for v in run.values))) or None
    known = [v["confidence"] for v in run.values if v["confidence"] is not None]
    return value, round(sum(known) / len(known), 6) if known else 0.0, label


def ordered(rows):
    out = []
    for _, at, text, confidence, *box in sorted(rows, key=lambda r: r[1]):
        if text and text.strip():
            x0, y0, x1, y1 = box if box[0] is not None else (0.0, at * 30.0, 0.0, at * 30.0 + 20)
            out.append({"text": text, "confidence": confidence, "x0": x0, "y0": y0, "x1": x1, "y1": y1})
    return sorted(out, key=lambda v: (v["y0"], v["x0"]))


def compare(spark, images, rows):
    asked = templates.effective(P.TEMPLATES.frame(spark), templates.configured(spark))
    by_code = {}
    for f in asked.collect():
        by_code.setdefault(f["template_code"], []).append(f.asDict())
    table = spark.createDataFrame(rows, P.LINES.schema)
    got = {(r["image_id"], r["field"]): (r["value"], r["confidence"], r["label"]) for r in X.extract(spark.createDataFrame(images, P.IMAGES.schema), table, asked).collect()}
    want = {}
    for image, code in images:
        lines = ordered([r for r in rows if r[0] == image])
        for f in by_code.get(code, ()):
            want[image, f["field"]] = extracted(lines, by_code[code], f)
    assert got == want


def test_registered_images(spark):
    compare(spark, P.IMAGES.rows, P.LINES.rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_images(spark, seed):
    rnd = random.Random(seed)
    words = ["企业名称", "单位名称：", "有效期", "编号", "姓名", "备注", "甲", "乙丙", "2020年", " ", "许可范围", "负责人", "主要负责人", "x", "：", "类型", "地址"]
    images, rows = [], []
    for image in range(40):
        images.append((image, rnd.choice(["safety_license", "member", "trade"])))
        for k in range(rnd.randint(0, 9)):
            x, y = rnd.randrange(0, 900, 30) * 1.0, rnd.randrange(0, 400, 12) + k / 16
            box = (x, y, x + rnd.randrange(20, 300, 20), y + rnd.choice([20.0, 30.0, 45.0])) if rnd.random() > 0.1 else (None,) * 4
            rows.append((image, k, "".join(rnd.choices(words, k=rnd.randint(1, 4))), rnd.choice([None, 0.5, 0.9]), *box))
    compare(spark, images, rows)


def test_fallbacks_and_repairs(spark):
    plain_rows = lambda rows: [tuple(v.replace("◇", "") if isinstance(v, str) else v for v in r) for r in rows]
    images, lines = (Fixture(x.schema, plain_rows(x.rows)).frame(spark) for x in (P.IMAGES, P.LINES))
    found = X.finish(X.extract(images, lines, templates.effective(P.TEMPLATES.frame(spark), templates.configured(spark))))
    rows = {(r["image_id"], r["field"]): (r["value"], r["status"]) for r in found.collect()}
    assert rows[1, "enterpriseName"][0] == "某某化工有限公司" and rows[1, "validPeriod"][0] == "2020年01月02日至2023年01月01日"
    assert rows[1, "issueDate"] == ("2020年02月03日", "EXTRACTED") and rows[1, "licenseNumber"][0] == "(苏)WH安许证字[2019]1234号"
    assert rows[2, "enterpriseName"][0] == "无标签公司" and rows[2, "licenseNumber"][0] == "(浙)AB安许证字[2020]2号"
    assert rows[1, "creditCode"] == (None, "MISSING") and rows[5, "name"] == (None, "MISSING")
    assert rows[3, "remark"] == ("第一行第二行", "EXTRACTED") and rows[4, "enterpriseName"] == ("丙公司", "LOW_CONFIDENCE")
