"""Recorded replies: reading them as a data source, and what a client makes of them."""

import json

from evidentia.sources import replies as R


def result(x):
    return json.dumps({"result": x})


CALLS = {
    "1": [(200, 1.0, result({"content": [{"text": '{"x": 1}'}]}))],
    "2": [(503, 1.0, ""), (200, 1.0, "event: m\r\ndata: " + result({"structuredContent": {"result": [1, 2]}}) + "\r\n\r\n")],
    "3": [(404, 1.0, "no"), (200, 1.0, result({}))],
    "4": [(200, 1.0, json.dumps({"error": None}))],
    "5": [(200, 1.0, result({"isError": True, "content": [{"text": "bad"}]}))],
    "6": [(200, 99.0, result({})), (None, 1.0, None), (502, 1.0, "")],
    "7": [(200, 1.0, "<html>")],
    "8": [(200, 1.0, result({"content": [], "z": 1}))],
    "9": [(200, 1.0, json.dumps({"id": 1}))],
    "10": [(200, 1.0, result({"structuredContent": {"result": None}, "content": [{"text": "other"}]}))],
    "11": [(200, 1.0, result({"content": [{"type": "image"}]}))],
    "12": [(503, 1.0, "")],
}


def log(spark, tmp_path, calls=CALLS, tool="a b/é"):
    rows = [(tool, key, i, *x) for key, own in calls.items() for i, x in enumerate(own)] + [("other", "1", 0, 200, 1.0, result({"content": [{"text": "plain"}]}))]
    attempts = spark.createDataFrame(rows, R.FIELDS)
    path = f"file://{tmp_path}/log"
    R.recorded(attempts, path)
    return attempts, path


def test_every_record_is_read_once(spark, tmp_path):
    attempts, path = log(spark, tmp_path)
    (tmp_path / "log" / "torn.json").write_text('{"tool": "late", "key": "k", "seconds": 2.5}\n\n{"tool": "la')
    for size in (1, 70, 333, R.SPLIT):
        found = R.replies(spark, path, splitBytes=size)
        rows = sorted(map(tuple, found.where("tool != 'late'").collect()), key=repr)
        assert rows == sorted(map(tuple, attempts.collect()), key=repr)
        assert [tuple(r) for r in found.where("tool = 'late'").collect()] == [("late", "k", 0, None, 2.5, None)]


def test_filters_reach_the_reader(spark, tmp_path):
    attempts, path = log(spark, tmp_path)
    found = R.replies(spark, path)
    for where in ("tool = 'other'", "key in ('1', '2')", "tool = 'a b/é' and key = '2' and attempt > 0", "tool = 'none'", "key is null"):
        assert sorted(map(tuple, found.where(where).collect()), key=repr) == sorted(map(tuple, attempts.where(where).collect()), key=repr)
    plan = found.where("tool = 'other' and attempt >= 0")._jdf.queryExecution().executedPlan().toString()
    assert "attempt" in plan.split("Filter")[1].split("\n")[0] and "= other" not in plan.split("BatchScan")[0]
    reader = R.RepliesReader(path, R.SPLIT)
    assert list(reader.pushFilters([R.EqualTo(("tool",), "other"), R.EqualTo(("status",), 200)])) == [R.EqualTo(("status",), 200)]
    assert {p.tool for p in reader.partitions()} == {"other"}
    empty = tmp_path / "empty"
    empty.mkdir()
    assert R.replies(spark, str(empty)).count() == 0


def test_what_a_client_gets(spark, tmp_path):
    _, path = log(spark, tmp_path)
    found = R.replies(spark, path).where("tool != 'other'")
    got = {r["key"]: (r["outcome"], r["payload"], r["tries"], r["spent"]) for r in R.answers(found).collect()}
    assert got == {
        "1": ("answered", '{"x": 1}', 1, 1.0), "2": ("answered", "[1,2]", 2, 3.5), "3": ("refused", None, 1, 1.0), "4": ("error", None, 1, 1.0), "5": ("tool_error", None, 1, 1.0),
        "6": ("busy", None, 3, 66.5), "7": ("unreadable", None, 1, 1.0), "8": ("answered", '{"content":[],"z":1}', 1, 1.0), "9": ("answered", "{}", 1, 1.0),
        "10": ("answered", "null", 1, 1.0), "11": ("answered", "", 1, 1.0), "12": ("busy", None, 1, 2.5),  # the pause before an attempt that the log does not have
    }
    short = {r["key"]: (r["outcome"], r["tries"], r["spent"]) for r in R.answers(found, total=2.4).collect()}
    assert short["2"] == ("busy", 1, 1.0) and short["6"] == ("late", 1, 2.4) and short["1"] == ("answered", 1, 1.0)


def test_documents_of_services(spark, tmp_path):
    bodies = {
        "good": {"results": [], "items": [{"title": 5, "content": "c", "page": 7, "score": "0.25", "url": "u"}, {"text": "t"}]},
        "bad score": {"results": [{"text": "t", "score": "high"}]}, "null score": {"results": [{"text": "t", "score": None}]},
        "no list": {"hits": [{"text": "t"}]}, "not objects": {"results": ["t"]}, "array": [{"text": "t"}],
    }
    calls = {k: [(200, 1.0, json.dumps(v, indent=1))] for k, v in bodies.items()} | {"down": [(500, 1.0, '{"results": [{"text": "t"}]}')], "slow": [(200, 9.0, '{"results": [{"text": "t"}]}')]}
    _, path = log(spark, tmp_path, calls, "guide")
    answered = R.answers(R.replies(spark, path), total=8.0, retries=1, wrapped=False)
    got = sorted(tuple(r) for r in R.documents(answered, {"guide": {"locator": [("page", "p. ")]}}).collect())
    assert got == [("guide", "good", 1, "5", "c", "u", "p. 7", 0.25), ("guide", "good", 2, "", "t", None, None, 0.0)]
    asked = spark.createDataFrame([("good",), ("down",), ("never asked",)], "query string")
    assert dict(map(tuple, R.top_text(asked, R.documents(answered, {"guide": {}}, 1), "guide").collect())) == {"good": "c", "down": "", "never asked": ""}


def test_listing(spark, tmp_path):
    tools = [{"name": "x", "description": "d", "inputSchema": {"type": "object"}}, {"name": "y"}]
    _, path = log(spark, tmp_path, {"": [(200, 1.0, "data: " + result({"tools": tools}))]}, "tools/list")
    answered = R.answers(R.replies(spark, path))
    assert sorted(map(tuple, R.tool_list(answered).collect())) == [("x", "d", '{"type":"object"}'), ("y", None, None)]
    assert R.tool_list(answered.where("tool = 'other'")).count() == 0
