"""Jobs that must not end early: chains, matches and shares beyond a former bound."""

import os
import random
import time

from recollect import session
from recollect.operators import graph, leiden, recall
from recollect.plans.catalogue import QUERIES
from recollect.session import materialize


def test_preview_names_descendants_of_any_distance(spark, tmp_path):
    """A chain of 23 orders; then a ring of 19 with a chord and a tail, against a plain walk."""
    spark.range(1, 24).selectExpr("id AS o_orderkey", "1L AS o_custkey", "timestamp'2024-01-01' + make_dt_interval(CAST(id AS INT)) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r["query"]: r["descendants"] for r in QUERIES["forget_preview"](spark, str(tmp_path)).collect()} == {f"o{i}": 23 - i for i in range(1, 23)}
    pairs = [(i, (i + 1) % 19) for i in range(19)] + [(0, 7)] + [(i, i + 1) for i in range(30, 45)] + [(18, 30)]
    expect = {}
    for start in (0, 5, 31):
        seen, front, hop = {start: 0}, [start], 0
        while front:
            hop += 1
            front = [b for b in dict.fromkeys(y for x in front for a, y in pairs if a == x) if b not in seen]
            seen |= dict.fromkeys(front, hop)
        expect |= {(start, n): h for n, h in seen.items() if h}
    edges = spark.createDataFrame([(str(b), str(a), "derived_from") for a, b in pairs], "source string, target string, edge_type string")
    got = graph.forget_preview(edges, spark.createDataFrame([(n, str(n)) for n in (0, 5, 31)], "query long, node string")).select("query", F.col("node").cast("long").alias("node"), "hops").collect()
    assert {(r["query"], r["node"]): r["hops"] for r in got} == expect and len(got) == len(expect) and max(expect.values()) > 20


def test_a_name_without_equal_label_is_held_by_every_near_label(spark):
    """Labels of two types, copies by their first node; then a share that is reached only with the label before the name."""
    nodes = spark.createDataFrame([("a1", "topic", "cold plate"), ("a2", "topic", "Cold-Plate"), ("a3", "topic", "old plate"), ("a4", "topic", "bold plate"), ("e1", "entity", "cold plates"), ("e2", "entity", "warm plates"), ("z", "context", "cold plat")], "node string, node_type string, label string")
    named = spark.createDataFrame([(1, "cold plats", "topic"), (2, "cold plate", "topic"), (3, "cold plate", "fact")], "query long, label string, node_type string")
    got = sorted(tuple(r) for r in recall.entity_anchors(nodes, named, least=None).collect())
    assert got == [(1, "a1", False), (1, "a3", False), (1, "a4", False), (1, "e1", False), (2, "a1", True), (3, "a1", False), (3, "a3", False), (3, "a4", False), (3, "e1", False)]
    nodes = spark.createDataFrame([("l", "topic", "cbbcabadc"), ("m", "topic", "ddaacaddbc")], "node string, node_type string, label string")
    named = spark.createDataFrame([(1, "bbcbacdbc", "topic"), (2, "adddadaaddcbc", "topic")], "query long, label string, node_type string")
    assert sorted(tuple(r) for r in recall.entity_anchors(nodes, named).collect()) == [(1, "l", False), (2, "m", False)]
    turned = [named.selectExpr("concat('n', query) AS node", "node_type", "label"), nodes.selectExpr("ascii(node) AS query", "label", "node_type")]
    assert recall.entity_anchors(*turned).count() == 0


def test_a_node_moves_to_where_it_gains_most_and_stays_for_no_more(spark):
    """Made-up choices against a plain loop: equal gains, nodes that are alone, several rows of a community."""
    rng, rows, expect = random.Random(9), [], {}
    for v in range(200):
        own, own_n, k = rng.randrange(30), rng.randrange(1, 4), rng.randrange(1, 6) / 2
        size = {c: (rng.randrange(1, 9) / 2 + k * (c == own), own_n if c == own else rng.randrange(1, 3)) for c in range(30)}
        near = [(c, rng.randrange(1, 4) / 2) for c in (rng.randrange(30) for _ in range(rng.randrange(8)))]
        rows += [(v, own, *size[own], 0.0, k), *((v, c, *size[c], w, None) for c, w in near)]
        gains = {c: round(sum(w for d, w in near if d == c) - k * (size[c][0] - k * (c == own)) / 40, 9) for c in {own, *(c for c, _ in near)}}
        best = min((-g, c != own, c) for c, g in gains.items() if c == own or not (size[c][1] == own_n == 1 and c > own))
        expect[v] = (k, own, best[2], best[1])
    table = spark.createDataFrame(rng.sample(rows, len(rows)), "node long, community long, all double, n long, w double, k double").repartition(3, "node")
    chosen = table.mapInArrow(leiden._choices(40.0), "node long, k double, own long, community long, moves boolean")
    assert {r["node"]: tuple(r)[1:] for r in chosen.collect()} == expect and 40 < sum(m for *_, m in expect.values()) < 200


def test_a_round_of_moves_sorts_no_choices_by_struct(spark, monkeypatch):
    pairs = [(f"v{i % 40}", f"v{(i * 7 + i // 40) % 40}", 1.0) for i in range(400)]
    adj = materialize(graph.adjacency(spark.createDataFrame([p for p in pairs if p[0] != p[1]], "source string, target string, weight double")), "adjacency")
    plans, write = [], leiden.materialize
    monkeypatch.setattr(leiden, "materialize", lambda df, name: (name == "communities" and plans.append(df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    assert leiden.leiden(adj, small=adj.count() - 1, rounds=2).count() == 40
    assert len(plans) >= 2 and not any("SortAggregate" in p for p in plans)


def test_rounds_of_labels_leave_no_files_behind(spark, tmp_path, monkeypatch):
    """A chain on which a label moves a step a round: one table of labels stays, nothing shuffled stays, and tables not written by the job are kept."""
    edges = spark.range(30).selectExpr("format_string('n%02d', id) AS source", "format_string('n%02d', id + 1) AS target", "1.0D AS weight")
    names, adjacent = graph.coded(edges)
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    shuffled = lambda: {f for _, _, fs in os.walk(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]) for f in fs if f.startswith("shuffle_")}
    before = shuffled()
    got = graph.communities(adjacent, dealt=True)
    assert [f.split("-")[0] for f in os.listdir(tmp_path)] == ["labels"]
    for _ in range(50):  # files are deleted by the executors, soon after
        if not (left := shuffled() - before):
            break
        time.sleep(0.2)
    assert not left
    assert {r["community"] for r in got.collect()} == {adjacent.agg({"src": "min"}).first()[0]}
    spark.range(3).write.parquet(f"{tmp_path}/given")
    session.discard(spark.read.parquet(f"{tmp_path}/given"))
    assert spark.read.parquet(f"{tmp_path}/given").count() == 3


def test_a_last_step_in_parts_reaches_what_a_whole_one_does(spark, monkeypatch):
    """Nine queries on a random graph, the last step for four at a time; no step then makes rows of all their strengths."""
    rng = random.Random(3)
    edges = [(f"v{rng.randrange(60)}", f"v{rng.randrange(60)}", rng.randrange(1, 10) / 10) for _ in range(150)]
    adjacent = graph.strengths(spark.createDataFrame(edges, "source string, target string, weight double"))
    anchors = spark.createDataFrame([(q, f"v{q * 5}") for q in range(9)], "query long, node string")
    whole = sorted(map(tuple, graph.walk(adjacent, anchors, 3).collect()))
    steps, write = [], graph.materialize
    monkeypatch.setattr(graph, "NARROW", 4)
    monkeypatch.setattr(graph, "LARGE", 0)
    monkeypatch.setattr(graph, "materialize", lambda df, name: steps.append(name) or write(df, name))
    assert sorted(map(tuple, graph.walk(adjacent, anchors, 3).collect())) == whole and len(whole) > 200
    assert steps.count("level") == 3 + 3
