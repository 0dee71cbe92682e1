"""Results under tokens, one active task for each plan, parts of web archives."""

import base64
import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataloom.sources import mime
from strataloom.streaming import results

T0 = dt.datetime(2026, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


SCHEMA = "task_id string, token string, worker_id string, rule_version string, ts timestamp, levels array<string>, n int"


def test_results_are_written_once_and_under_the_current_token(spark, tmp_path):
    held = spark.createDataFrame([("a", "RUNNING", "t2"), ("b", "RUNNING", "u1"), ("c", "QUEUED", "v1"), ("d", "RUNNING", "w1")], "task_id string, status string, token string")
    sink = results.ResultSink(str(tmp_path / "out"), lambda: held)
    one = spark.createDataFrame([("a", "t1", "w", "r", at(1), ["x"], 1), ("a", "t2", "w", "r", at(2), ["y"], 2), ("a", "t2", "w", "r", at(2), ["y"], 2), ("b", "u1", "w", "r", at(3), None, None), ("c", "v1", "w", "r", at(4), [], 0), ("e", None, "w", "r", at(5), [], 0)], SCHEMA)
    two = spark.createDataFrame([("b", "u1", "w", "r", at(9), ["late"], 9), ("d", "w1", "w", "r", at(8), ["z"], 3)], SCHEMA)
    sink(one, 0)
    sink(one, 0)  # a repeated batch replaces itself
    sink(two, 1)
    sink(one, 0)
    got = {r["task_id"]: (r["result"], r["status"], r["progress_percent"]) for r in sink.results(spark).collect()}
    assert got == {"a": ('{"levels":["y"],"n":2}', "COMPLETED", 100), "b": ("{}", "COMPLETED", 100), "d": ('{"levels":["z"],"n":3}', "COMPLETED", 100)}
    assert sorted((r["task_id"], r["token"]) for r in sink.rejected(spark).collect() if r["token"]) == [("a", "t1"), ("a", "t2"), ("b", "u1"), ("c", "v1")]


def test_a_stream_of_results_survives_a_restart(spark, tmp_path):
    held = spark.createDataFrame([(f"k{i}", "RUNNING", "t") for i in range(6)], "task_id string, status string, token string")
    rows = spark.createDataFrame([(f"k{i % 6}", "t" if i < 6 else "old", "w", "r", at(i), [], i) for i in range(12)], SCHEMA)
    rows.where("n < 4").coalesce(1).write.parquet(str(tmp_path / "in"))
    sink = results.ResultSink(str(tmp_path / "out"), lambda: held)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()

    run()
    rows.where("n >= 4").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()
    assert sink.results(spark).count() == 6 and sink.rejected(spark).count() == 6


def answers(rows):
    """Plainly: each request with its plan's active task."""
    active, out = {}, {}
    for plan, request, event, _ in sorted(rows, key=lambda r: (r[3], r[1])):
        if event == "END":
            if active.get(plan) == request:
                del active[plan]
        else:
            out[request] = (active.setdefault(plan, request), active[plan] != request)
    return out


def test_one_active_task_a_plan(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("p", "r1", "SUBMIT", at(0)), ("p", "r2", "SUBMIT", at(1)), ("q", "s1", "SUBMIT", at(1)), ("p", "r1", "END", at(2)), ("p", "r3", "SUBMIT", at(3)), ("p", "r2", "END", at(4)), ("p", "r4", "SUBMIT", at(5)), ("q", "s1", "END", at(6)), ("q", "s2", "SUBMIT", at(7))]
    schema = "plan_id string, request_id string, event string, ts timestamp"
    for k, cut in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(cut, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = results.one_active(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), keep=None)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["request_id"]: (r["task_request"], r["reused"]) for r in got} == answers(rows) and len(got) == 6
    assert {r["request_id"]: r["n_kept"] for r in got}["r3"] == 1


def test_ended_tasks_expire_by_state_ttl():
    class Cell:
        def __init__(self):
            self.rows = []

        exists = lambda self: bool(self.rows)
        get = lambda self: self.rows[-1] if self.one else iter(self.rows)

        def update(self, row):
            self.rows = [row]

        appendValue = lambda self, row: self.rows.append(row)

        def clear(self):
            self.rows = []

    seen = {}

    class Handle:
        def getValueState(self, name, schema):
            seen[name] = (c := Cell(), None)
            c.one = True
            return c

        def getListState(self, name, schema, ttl=None):
            seen[name] = (c := Cell(), ttl)
            c.one = False
            return c

    p = results.OneActive(30)
    p.init(Handle())
    assert seen["ended"][1] == 30 * 86_400_000
    frame = pd.DataFrame([("p", "r1", "SUBMIT", at(0)), ("p", "r1", "END", at(1)), ("p", "r2", "SUBMIT", at(2))], columns=["plan_id", "request_id", "event", "ts"])
    out = pd.concat(p.handleInputRows(("p",), iter([frame]), None))
    assert out["n_kept"].tolist() == [0, 1] and out["task_request"].tolist() == ["r1", "r2"]
    p.close()


def archive(*parts, boundary="b 1", close=True):
    out = f'MIME-Version: 1.0\r\nContent-Type: multipart/related;\r\n\tboundary="{boundary}"\r\n\r\npreamble\r\n'
    for kind, encoding, body in parts:
        out += f"--{boundary}\r\nContent-Type: {kind}\r\nContent-Transfer-Encoding: {encoding}\r\n\r\n{body}\r\n"
    return (out + (f"--{boundary}--\r\n" if close else "")).encode("latin-1")


def coded(text):
    return base64.b64encode(text.encode()).decode()


def test_parts_of_archives(spark, tmp_path):
    files = {
        "a.mht": archive(("image/png", "base64", "AAAA"), ("text/html; charset=utf-8", "base64", coded("<p>ä</p>")), ("text/plain", "quoted-printable", "x=3Dy")),
        "open.mht": archive(("text/plain; charset=none", "7bit", "plain"), close=False),
        "none.mht": b"MIME-Version: 1.0\r\nContent-Type: text/html\r\n\r\nno parts",
        "many.mht": archive(*[("image/png", "base64", "AA")] * 128, ("text/plain", "7bit", "over")),
        "most.mht": archive(*[("image/png", "base64", "AA")] * 127, ("text/plain", "7bit", "last")),
        "empty.mht": b"",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    mime.register(spark)
    read = spark.read.format("mime_parts").load(str(tmp_path))
    got = {}
    for r in read.collect():
        got.setdefault(r["path"].rpartition("/")[2], []).append((r["part"], r["content_type"], (r["text"] or "").strip() or None, r["error_code"]))
    failed = [(None, None, None, "DOCUMENT_PARSE_FAILED")]
    assert got == {
        "a.mht": [(1, "text/html", "<p>ä</p>", None), (2, "text/plain", "x=y", None)], "open.mht": [(0, "text/plain", "plain", None)], "none.mht": failed, "many.mht": failed, "most.mht": [(127, "text/plain", "last", None)], "empty.mht": failed,
    }
    html = read.where(F.col("content_type") == "text/html")
    assert [r["part"] for r in html.collect()] == [1]


def test_filters_and_limits_of_the_reader(monkeypatch):
    lines = archive(("text/html", "base64", "!!"), ("text/plain", "7bit", "x" * 50)).splitlines(keepends=True)
    assert [(n, t.strip()) for n, _, t in mime.parts(iter(lines), "text/plain")] == [(1, "x" * 50)]
    monkeypatch.setattr(mime, "MAX_DECODED", 40)
    with pytest.raises(ValueError):
        list(mime.parts(iter(lines)))
    assert list(mime.parts(iter(lines), "text/html"))[0][0] == 0
    reader = mime._Reader("/nowhere")
    from pyspark.sql.datasource import EqualTo

    assert len(list(reader.pushFilters([EqualTo(("content_type",), "text/html"), EqualTo(("path",), "/x")]))) == 2 and (reader.wanted, reader.only) == ("text/html", "/x")
