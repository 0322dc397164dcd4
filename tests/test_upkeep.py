"""Replies, benchmark files, vectors and triggers, by hand."""

import json

from pyspark.sql import functions as F

from recollect.operators import upkeep
from recollect.sources import payloads


def test_replies_of_every_shape(spark):
    bodies = [
        '["plain", {"text": "t", "content_type": "note", "timestamp": "2024-01-01"}, {"content": ""}, 7, null]', '{"conversations": [], "data": ["{brace"]}',
        '{"results": [{"content": "", "message": "m"}]}', '{"error": "none"}', "no json", "", None, "[]",
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    got = {(r["k"], r["i"]): (r["content"], r["content_type"], r["timestamp"]) for r in payloads.items(df, "k", "body").collect()}
    assert got == {(0, 0): ("plain", "conversation", None), (0, 1): ("t", "note", "2024-01-01"), (1, 0): ("{brace", "conversation", None), (2, 0): ("m", "conversation", None)}


def test_benchmark_files(spark):
    talk = {
        "speaker_a": "A", "session_1_date_time": "1 May", "session_10": [{"dia_id": "x", "speaker": "B", "text": " hi ", "img_url": ["u"]}], "session_2": "no list",
        "session_1": [{"dia_id": "D1:2", "speaker": "A", "text": "two"}, {"dia_id": "D1:3", "text": "  "}, {"text": "no id"}],
    }
    qa = [{"question": "a", "answer": 7, "category": 2, "evidence": ["D1:2", ["D1:3"]]}, {"question": "b", "category": 5}, {"question": "c", "answer": "x", "adversarial_answer": "y", "evidence": "D1:1"}, {"question": " "}]
    df = spark.createDataFrame([(1, json.dumps(talk), json.dumps(qa)), (2, "{}", "[]"), (3, None, None)], "k int, talk string, qa string")
    turns = {(r["session"], tuple(r["place"]), r["speaker"], r["text"], r["session_date"], r["has_image"]) for r in payloads.session_turns(df, "k", "talk").collect()}
    assert turns == {(1, (1, 2), "A", "two", "1 May", False), (10, (10, 0), "B", "hi", "", True)}
    asked = {r["question"]: (r["answer"], r["category"], r["evidence"]) for r in payloads.questions(df, "k", "qa").collect()}
    assert asked == {"a": ("7", 2, ["D1:2", "D1:3"]), "b": ("not mentioned", 5, []), "c": ("y", 0, ["D1:1"])}


def test_reindex_and_pending(spark):
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", [3.0])], "node string, vector array<double>")
    changed = spark.createDataFrame([("b", "four"), ("c", None), ("d", "x")], "node string, text string")
    found = upkeep.reindex(vectors, changed, lambda t: F.array(F.length(t).cast("double")))
    assert {(r["node"], r["vector"][0]) for r in found.collect()} == {("a", 1.0), ("b", 4.0), ("d", 1.0)}
    nodes = spark.createDataFrame([(n,) for n in "zyxab"], "node string")
    assert [r["node"] for r in upkeep.pending(nodes, vectors, 2).collect()] == ["x", "y"]


def test_due_and_payload(spark):
    log = spark.createDataFrame([("a", i) for i in range(1, 12)] + [("b", 1)], "k string, i int")
    assert sorted(r["i"] for r in upkeep.due(log, "k", ["i"], 4, 2).collect()) == [2, 6, 10]
    assert sorted(r["i"] for r in upkeep.due(log, "k", ["i"], 5).collect()) == [5, 10]
    results = spark.createDataFrame([("q", 2, "n2"), ("q", 1, "n1")], "query string, rank int, node string")
    assert json.loads(upkeep.payload(results, "node").first()["payload"]) == {"query": "q", "results": [{"node": "n1"}, {"node": "n2"}]}
    assert [(r["node"], r["was_used"]) for r in upkeep.signals(results, F.lit(1)).orderBy("node").collect()] == [("n1", False), ("n2", False)]
