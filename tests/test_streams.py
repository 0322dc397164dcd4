"""Keyed state, paged sources, forget order, trie of words, and evaluations that go on, each against a plain version."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from recollect.operators import evaluate, extract, graph, lifecycle, resume, upkeep
from recollect.sources import paged
from recollect.streaming import ingest, state


def rows_of(spark, path, schema):
    return [tuple(r) for r in spark.read.schema(schema).parquet(path).collect()]


def test_counters_survive_a_restart(spark, sf, tmp_path):
    """Events in three deliveries, the stream stopped between them: each trigger comes once, and all of them do."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "ts").withColumn("user_id", F.col("user_id") % 3)
    cuts = events.select(F.expr("percentile(event_id, array(0.3, 0.6))")).first()[0]
    (tmp_path / "in").mkdir()
    order = events.orderBy("event_id")
    parts = [order.where(F.col("event_id") <= cuts[0]), order.where((F.col("event_id") > cuts[0]) & (F.col("event_id") <= cuts[1])), order.where(F.col("event_id") > cuts[1])]
    stream = state.with_state_store(spark).readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.append(state.due(stream, "user_id", ["event_id"], 50, 20), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = sorted(rows_of(spark, f"{tmp_path}/out", events.schema))
    assert got == sorted(map(tuple, upkeep.due(events, "user_id", ["event_id"], 50, 20).collect())) and len(got) > 10


def test_queue_leaves_by_size_and_by_time(spark, tmp_path):
    """Full batches leave at once, the rest by the timer; after a restart nothing comes twice."""
    schema = "shard int, node string"
    (tmp_path / "in").mkdir()
    stream = state.with_state_store(spark).readStream.schema(schema).parquet(f"{tmp_path}/in")
    put = lambda names: spark.createDataFrame([(i % 2, n) for i, n in enumerate(names)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def until(count, seconds):
        work = state.drained(stream, batch=10, seconds=seconds).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="300 milliseconds").start()
        try:
            for _ in range(120):
                time.sleep(0.5)
                if (tmp_path / "out" / "_spark_metadata").exists() and len(found := rows_of(spark, f"{tmp_path}/out", schema)) >= count:
                    return found
        finally:
            work.stop()
        raise AssertionError("the queue did not leave")

    put([f"a{i:02}" for i in range(50)])
    first = until(40, 3600)
    assert len(first) == len(set(first)) == 40
    put(["b0", "b1"])
    assert len(rows_of(spark, f"{tmp_path}/out", schema)) == 40
    put([f"c{i:02}" for i in range(8)])
    second = until(60, 3600)
    assert sorted(n for _, n in second) == sorted([f"a{i:02}" for i in range(50)] + ["b0", "b1"] + [f"c{i:02}" for i in range(8)])


def test_queue_is_drained_by_its_timer(spark, tmp_path):
    schema = "shard int, node string"
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(0, "x"), (1, "y"), (1, "z")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = state.with_state_store(spark).readStream.schema(schema).parquet(f"{tmp_path}/in")
    work = state.drained(stream, batch=10, seconds=1).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if (tmp_path / "out" / "_spark_metadata").exists() and len(got := rows_of(spark, f"{tmp_path}/out", schema)) >= 3:
                break
    finally:
        work.stop()
    assert sorted(got) == [(0, "x"), (1, "y"), (1, "z")]


REPLIES = [{"conversations": [{"content": "one", "timestamp": "2024-01-01"}, "two", {"text": "three", "content_type": "note"}, {"content": ""}, 7]}, [], [{"message": "four", "source_id": "own"}], {"data": [{"text": "five"}]}, {"nothing": 1}]


def test_pages_read_and_followed(spark, tmp_path):
    """read and readStream of one folder agree; a stream that is started again reads the new pages alone."""
    folder = tmp_path / "pages"
    folder.mkdir()
    put = lambda i: (folder / f"{i}.json").write_text(json.dumps(REPLIES[i]))
    spark.dataSource.register(paged.Replies)
    put(0)
    put(1)
    put(3)  # not seen before page 2 is there
    follow = lambda: ingest.append(spark.readStream.format("replies").option("path", str(folder)).load(), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    follow()
    read = lambda: sorted(tuple(r) for r in spark.read.format("replies").option("path", str(folder)).load().collect())
    stored = lambda: sorted(rows_of(spark, f"{tmp_path}/out", paged.SCHEMA))
    assert read() == stored() and [r[3] for r in read()] == ["one", "two", "three"]
    put(2)
    put(4)
    follow()
    assert read() == stored() and [r[3] for r in read()] == ["one", "two", "three", "four", "five"]
    assert read()[3] == (2, 0, "own", "four", "conversation", None) and read()[0][2] == "api:0:0"
    follow()
    assert len(stored()) == 5
    assert spark.read.format("replies").option("path", f"{tmp_path}/none").load().count() == 0


def peeled(edges, ids):
    below = {}
    for child, parent in edges:
        below.setdefault(parent, set()).add(child)
    found, stack = set(ids), list(ids)
    while stack:
        for c in below.get(stack.pop(), ()):
            if c not in found:
                found.add(c)
                stack.append(c)
    left, out, layer = set(found), set(), 0
    while left:
        leaves = {n for n in left if not below.get(n, set()) & left}
        out |= {(n, layer, not leaves) for n in leaves or left}
        left = left - leaves if leaves else set()
        layer += 1
    return out


CHAIN = [(f"c{i + 1}", f"c{i}") for i in range(9)]
DIAMOND = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("e", "a")]
CYCLE = [("x", "a"), ("y", "x"), ("x", "y"), ("leaf", "y"), ("b", "a"), ("self", "b"), ("self", "self")]


@pytest.mark.parametrize("edges, ids", [(CHAIN, ["c3"]), (DIAMOND, ["a"]), (DIAMOND, ["b", "c"]), (CYCLE, ["a"]), (CYCLE, ["leaf"]), (CHAIN + DIAMOND, ["c0", "d"]), (CHAIN, [])])
def test_forget_order(spark, edges, ids):
    frame = spark.createDataFrame([(s, t, "derived_from") for s, t in edges] + [("q", ids[0] if ids else "c0", "mentioned_by")], "source string, target string, edge_type string")
    got, layers = lifecycle.forget_order(frame, spark.createDataFrame([(i,) for i in ids], "node string"))
    rows = {tuple(r) for r in got.collect()}
    assert rows == peeled(edges, ids) and layers == len({x for _, x, _ in rows})


def test_truncated_lineage(spark):
    frame = spark.createDataFrame([(s, t, "derived_from") for s, t in CHAIN + CYCLE], "source string, target string, edge_type string")
    ids = spark.createDataFrame([(n, n) for n in ("c2", "c3", "c4", "leaf")], "query string, node string")
    assert {tuple(r) for r in graph.truncated(frame, ids, 3).collect()} == {("c2", False), ("c3", False), ("c4", True), ("leaf", False)}


def test_words_walk_the_trie(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(12)}"
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 40)))) for i in range(150)] + [(900, "long " + "tail " * 49 + "end"), (901, None), (902, "")]
    labels = [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["long " + "tail " * 49 + "end", "abc", "tail tail nothing"]
    names = [(f"L{i}", label) for i, label in enumerate(labels)] + [("twice", labels[0])]
    got = extract.mentions(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(names, "name string, norm string"), "id", "text", "name", "norm").collect()
    assert sorted(map(tuple, got)) == sorted((i, n) for i, t in texts if t is not None for n, label in names if len(label) >= 4 and f" {label} " in f" {t} ")
    none = spark.createDataFrame([], "name string, norm string")
    assert extract.mentions(spark.createDataFrame(texts, "id long, text string"), none, "id", "text", "name", "norm").count() == 0


def test_trie_rows_follow_matched_beginnings(spark, monkeypatch):
    """One label of fifty words: what is written beyond the labels' first words is a row for each place that matched so far."""
    written = []
    real = extract.materialize
    monkeypatch.setattr(extract, "materialize", lambda df, name: (written.append((name, got := real(df, name))), got)[1])
    texts = spark.createDataFrame([(i, "plain words without any start " * 200) for i in range(40)] + [(99, "begin one two three")], "id long, text string")
    names = spark.createDataFrame([("L", "begin " + " ".join(f"x{i}" for i in range(49))), ("M", "begin one two")], "name string, norm string")
    assert [tuple(r) for r in extract.mentions(texts, names, "id", "text", "name", "norm").collect()] == [(99, "M")]
    assert all(df.count() <= 3 for name, df in written if name != "trie")


def test_evaluation_goes_on_after_half(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{i % 20}", i, "ab"[i % 2]) for i in range(200)], "key string, value int, category string")
    asked = []

    def compute(part, fails=False):
        asked.append({r["key"] for r in part.select("key").distinct().collect()})
        if fails and len(asked) > 2:
            raise RuntimeError("cut")
        return part.select("key", "category", (F.col("value") * 1.0).alias("f1"))

    schema = "key string, category string, f1 double"
    cut = resume.Evaluation(str(tmp_path), {"a": 1, "b": 2}, "key", schema, lambda part: compute(part, True))
    with pytest.raises(RuntimeError):
        cut.run(rows, parts=4)
    done = asked[0] | asked[1]
    again = resume.Evaluation(str(tmp_path), {"b": 2, "a": 1}, "key", schema, compute)
    asked.clear()
    assert again.run(rows) == 20 - len(done) and asked == [{f"k{i}" for i in range(20)} - done] and done
    assert sorted(map(tuple, again.results(rows).collect())) == sorted((r["key"], r["category"], r["value"] * 1.0) for r in rows.collect())
    assert again.run(rows) == 0
    changed = rows.withColumn("value", F.when(F.col("key") == "k3", F.col("value") + 1000).otherwise(F.col("value")))
    assert again.run(changed) == 1 and again.results(changed).count() == 200 and again.results(changed).where("key = 'k3'").agg(F.min("f1")).first()[0] >= 1000
    assert resume.Evaluation(str(tmp_path), {"a": 2}, "key", schema, compute).run(rows) == 20
    assert evaluate.aggregate(again.results(rows).withColumns({"recall": F.lit(0.5), "reciprocal_rank": F.lit(1.0), "n_gold": F.lit(1)}), "category").count() == 2


def test_one_counter_serves_several_tasks_over_two_runs(spark, tmp_path):
    """Both tasks of one stream that is stopped and goes on, as ``upkeep.due`` finds them in the whole log."""
    log = spark.range(400).selectExpr("id % 3 AS k", "CASE WHEN id % 50 > 0 THEN (id * 7) % 400 + id DIV 200 * 400 END AS at", "id AS i")
    state.with_state_store(spark)
    for part in (0, 1):
        log.where(f"i DIV 200 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
        found = state.due_tasks(stream, "k", ["at", "i"], [("a", 10, 10), ("b", 50, 20)])
        ingest.append(found, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = sorted((r["task"], r["i"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    seen = {}
    expect = []
    for r in sorted(log.collect(), key=lambda r: (r["i"] // 200, r["at"] is None, r["at"] or 0, r["i"])):
        n = seen[r["k"]] = seen.get(r["k"], 0) + 1
        expect += [(t, r["i"]) for t, every, first in (("a", 10, 10), ("b", 50, 20)) if n >= first and (n - first) % every == 0]
    assert got == sorted(expect) and len(got) > 40
