"""Work that must not grow faster than the rows: the most rows that any step of a job makes."""

import random

from pyspark.sql import functions as F

from recollect.operators import graph, leiden, lifecycle, mutate, recall, substrings
from recollect.plans.catalogue import QUERIES
from recollect.session import materialize


def total_of(spark, metric: str, run) -> int:
    """The sum of a metric over all steps of the jobs of ``run``."""
    sc, store = spark.sparkContext._jsc.sc(), spark._jsparkSession.sharedState().statusStore()
    sc.listenerBus().waitUntilEmpty()
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    run()
    sc.listenerBus().waitUntilEmpty()
    total, every = 0, store.executionsList()
    for e in (every.apply(i) for i in range(every.size())):
        if e.executionId() not in before:
            values = store.executionMetrics(e.executionId())
            for i in {m.accumulatorId() for m in (e.metrics().apply(i) for i in range(e.metrics().size())) if m.name() == metric}:
                total += int(values.apply(i).replace(",", "")) if values.contains(i) else 0
    return total


def most_rows(spark, run) -> int:
    """The most rows that one step of the jobs of ``run`` put out."""
    sc, store = spark.sparkContext._jsc.sc(), spark._jsparkSession.sharedState().statusStore()
    sc.listenerBus().waitUntilEmpty()
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    run()
    sc.listenerBus().waitUntilEmpty()
    most, every = 0, store.executionsList()
    for e in (every.apply(i) for i in range(every.size())):
        if e.executionId() not in before:
            values = store.executionMetrics(e.executionId())
            for m in (e.metrics().apply(i) for i in range(e.metrics().size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_names_of_a_common_label_do_not_meet_all_its_nodes(spark):
    nodes = spark.range(600).select(F.format_string("p%04d", "id").alias("node"), F.lit("topic").alias("node_type"), F.when(F.col("id") % 2 == 0, "Old Ring").otherwise("hot bolt").alias("label"))
    named = spark.range(600).select(F.col("id").alias("query"), F.when(F.col("id") % 2 == 0, "old ring").otherwise("hot boltz").alias("label"), F.lit("topic").alias("node_type"))
    got = []
    most = most_rows(spark, lambda: got.extend(recall.entity_anchors(nodes, named, least=None).collect()))
    assert {(r["query"], r["node"], r["exact"]) for r in got} == {(i, f"p{i % 2:04d}", i % 2 == 0) for i in range(600)} and len(got) == 600
    assert most <= 5000


def test_a_walk_makes_a_row_an_edge_not_one_a_query(spark):
    """Thirty queries that all reach all of a small dense graph with parallel edges, against a plain walk."""
    rng = random.Random(4)
    edges = [(rng.randrange(40), rng.randrange(40), rng.randrange(1, 10) / 10) for _ in range(300)]
    near = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})[y] = max(w, near.get(x, {}).get(y, 0.0))
    expect = {}
    for q in range(30):
        front, seen = {q: 1.0}, {q: (0, 1.0)}
        for hop in (1, 2, 3):
            step = {}
            for x, s in front.items():
                for y, w in near.get(x, {}).items():
                    step[y] = max(step.get(y, 0.0), s * w)
            front = {y: s for y, s in step.items() if y not in seen}
            seen |= {y: (hop, s) for y, s in front.items()}
        expect |= {(q, str(x)): v for x, v in seen.items()}
    table = spark.createDataFrame([(str(a), str(b), w) for a, b, w in edges], "source string, target string, weight double")
    anchors = spark.createDataFrame([(q, str(q)) for q in range(30)], "query long, node string")
    got = []
    most = most_rows(spark, lambda: got.extend(graph.walk(graph.strengths(table), anchors, 3).collect()))
    assert {(r["query"], r["node"]): (r["hops"], r["strength"]) for r in got} == expect and len(got) == len(expect)
    assert most <= 2 * len(expect)


def test_recall_gives_a_node_of_two_communities_once_and_breaks_ties_by_id(spark):
    nodes = spark.range(90).selectExpr("format_string('m%02d', id) AS node", "'fact' AS node_type", "timestamp'2024-01-01' AS created_at", "0L AS access_count", "1.0D AS confidence", *[f"CAST(NULL AS TIMESTAMP) AS {c}" for c in ("valid_from", "valid_until", "invalidated_at")])
    edges = spark.range(1, 90).selectExpr("'m00' AS source", "format_string('m%02d', id) AS target", "1.0D AS weight")
    anchors = spark.createDataFrame([("q", "m00"), ("r", "m00")], "query string, node string")
    members = spark.createDataFrame([("m00", "a"), ("m00", "b"), ("m50", "a"), ("m50", "b")], "node string, community string")
    got = recall.recall(nodes, edges, anchors, F.lit("2024-02-01").cast("timestamp"), top=5, members=members).collect()
    assert sorted((r["query"], r["rank"], r["node"]) for r in got) == [(q, i + 1, n) for q in "qr" for i, n in enumerate(["m00", "m50", "m01", "m02", "m03"])]


def test_lineage_reads_no_earlier_level_again(spark, monkeypatch):
    """A ring with a short cut: nearest distances, and no join of a level with those before it."""
    pairs = [(i, (i + 1) % 6) for i in range(6)] + [(0, 3)]
    edges = spark.createDataFrame([(f"r{a}", f"r{b}", "derived_from") for a, b in pairs], "source string, target string, edge_type string")
    plans, write = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    got = {r["node"]: r["hops"] for r in graph.lineage(edges, spark.createDataFrame([("q", "r0")], "query string, node string"), 10).collect()}
    assert got == {"r1": 1, "r3": 1, "r2": 2, "r4": 2, "r5": 3}
    assert not any("LeftAnti" in p for p in plans)


def test_confidence_needs_no_merged_edges(spark, sf, monkeypatch):
    monkeypatch.setattr(graph, "adjacency", lambda *a, **k: 1 / 0)
    assert QUERIES["propagate_confidence"](spark, sf).count() > 0


def test_label_votes_that_are_equal_but_for_rounding_go_to_the_least(spark):
    """0.1 + 0.2 for b is no more than 0.3 for a."""
    pairs = [("x", "a", 0.3), ("x", "b", 0.1), ("x", "b", 0.2)]
    both = spark.createDataFrame(pairs + [(b, a, w) for a, b, w in pairs] + [("b", "c", 0.9), ("c", "b", 0.9)], "src string, dst string, strength double")
    got = {r["node"]: r["community"] for r in graph.communities(both).collect()}
    assert got == {"a": "a", "x": "a", "b": "b", "c": "b"}


def test_ids_of_a_coded_graph_are_in_the_order_of_its_nodes(spark):
    edges = spark.range(300).selectExpr("concat('o', id) AS source", "concat('c', id % 7) AS target", "0.5D AS weight", "1.0D AS confidence")
    names, adjacent = graph.coded(edges)
    told = [r["node"] for r in names.orderBy("id").collect()]
    assert told == sorted(told) and len(told) == 307
    got = {(r["src"], r["dst"], r["strength"]) for r in graph.named(adjacent, names, "src", "dst").collect()}
    assert got == {(r["src"], r["dst"], r["strength"]) for r in graph.adjacency(edges).collect()}


def test_marking_used_edges_sorts_none(spark):
    edges = spark.range(200).selectExpr("concat('e', id) AS edge_id", "concat('o', id % 9) AS source", "concat('p', id % 20) AS target", "id % 10 / 10.0D AS weight")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        marked = lifecycle.mark_used(edges, spark.createDataFrame([("p3",), ("p3",), ("o1",)], "node string"))
        assert "SortMergeJoin" not in marked._jdf.queryExecution().executedPlan().toString()
        got = {r["edge_id"]: r["weight"] for r in marked.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(got) == 200 and got == {f"e{i}": min(1.0, i % 10 / 10 + 0.05) if i % 20 == 3 or i % 9 == 1 else i % 10 / 10 for i in range(200)}


def test_gold_of_a_common_label_is_counted_not_paired(spark, tmp_path):
    spark.range(1000).selectExpr("id AS vec_id", "array(CAST(1 + id % 17 AS FLOAT), CAST(1 + id % 5 AS FLOAT)) AS embedding", "CAST(id = 50 AS INT) AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = []
    most = most_rows(spark, lambda: got.extend(QUERIES["retrieval_quality"](spark, str(tmp_path)).collect()))
    assert {r["query"]: r["n_gold"] for r in got} == {i: 0 if i == 50 else 998 for i in range(0, 1000, 50)}
    assert {(r["recall"], r["reciprocal_rank"], r["ndcg"]) for r in got if r["query"] == 50} == {(1.0, 1.0, 1.0)}
    assert most <= 3000


def test_newest_texts_of_words_are_kept_before_they_are_shuffled(spark):
    """Against a plain search: many and few words, inside of others, with spaces, over pieces with line breaks, of equal and of no age."""
    rng = random.Random(7)
    rows = [(f"d{i:03d}", None if i % 40 == 0 else i // 3, " ".join(rng.choice(["abc", "bcd\nzz", "ß☃x", "a", "", "query" + str(i % 7)]) for _ in range(8))) for i in range(300)]
    texts = spark.createDataFrame([*rows, ("none", 5, None)], "node string, at long, text string").repartition(3)
    many = ["abc", "bc", "b", "d\nz", "☃", "c a", "y3", "nowhere", "", *[f"query{i}" for i in range(7)], "zz", "ß", "x", "er", "bcd"]
    for words in (many, many[:5]):
        got = []
        most = most_rows(spark, lambda: got.extend(substrings.newest(texts, spark.createDataFrame([(w,) for w in words], "word string"), 4).collect()))  # noqa: B023
        expect = [(w, *r[:2]) for w in words if w for r in sorted((r for r in rows if w in r[2]), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[:4]]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, expect))
        assert len(words) == 5 or most <= 400


def test_coarsening_moves_an_edge_once_a_round(spark):
    """A random graph that one level settles: rows shuffled in it, a directed edge."""
    rng = random.Random(6)
    pairs = {(rng.randrange(250), rng.randrange(250)) for _ in range(4000)}
    edges = spark.createDataFrame([(f"v{a}", f"v{b}", 1.0) for a, b in pairs if a != b], "source string, target string, weight double")
    adj = materialize(graph.adjacency(edges), "adjacency")
    many, got = adj.count(), []
    moved = total_of(spark, "shuffle records written", lambda: got.extend(leiden.leiden(adj, small=many - 1, rounds=4).collect()))
    assert len(got) == len({r["node"] for r in got}) == 250
    assert moved <= 7.2 * many


def test_edges_of_whole_classes_are_made_without_being_moved(spark, tmp_path):
    """Customers and suppliers of two nations, against a plain double loop: the rows shuffled grow with the nodes, not with the edges."""
    spark.range(1, 601).selectExpr("id AS c_custkey", "CAST(id % 2 AS INT) AS c_nationkey", "CASE WHEN id % 51 > 0 THEN id * 20 - 1000.0D END AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 301).selectExpr("id AS s_suppkey", "CASE WHEN id % 41 > 0 THEN CAST(id % 2 AS INT) END AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    expect = {f"c{c}-s{s}": min(1.0, max(0.0, (c * 20 - 1000) / 5000)) if c % 51 else 0.0 for c in range(1, 601) for s in range(1, 301) if s % 41 and c % 2 == s % 2 and c % 10 and s % 10 and (c + s) % 3}
    got = []
    moved = total_of(spark, "shuffle records written", lambda: got.extend(QUERIES["connect_nodes"](spark, str(tmp_path)).collect()))
    assert len(got) == len(expect) > 40_000 and {r["edge_id"]: r["weight"] for r in got} == expect
    assert moved <= 10 * 900


def test_classes_that_share_nodes_give_an_edge_once(spark, monkeypatch):
    """Nodes of up to three classes, twice in some, absent ends, no weight, many small tiles; an edge linked by one pair of classes is not new by another."""
    monkeypatch.setattr(mutate, "TILE", (3, 2))
    rng = random.Random(5)
    sources = [(f"a{i}", rng.choice(["x", "y", "z", None]), None if i % 9 == 0 else i / 20) for i in range(40) for _ in range(rng.randrange(4))]
    targets = [(f"b{i}", rng.choice(["u", "v", "w", None])) for i in range(30) for _ in range(rng.randrange(4))]
    wanted, linked = [("x", "u"), ("x", "v"), ("y", "v"), ("z", "w"), ("y", "w"), ("x", "u")], [("y", "v"), ("z", "u")]
    there = {f"a{i}" for i in range(40) if i % 7} | {f"b{i}" for i in range(30) if i % 5}
    pairs = lambda classes: {(a, b): w for a, p, w in sources for b, q in targets if (p, q) in classes}
    expect = {(a, b, min(1.0, w or 0.0)) for (a, b), w in pairs(wanted).items() if a in there and b in there and (a, b) not in pairs(linked)}
    frame = lambda rows, *names: spark.createDataFrame(rows, ", ".join(f"{n} {'double' if n == 'weight' else 'string'}" for n in names))
    nodes, classes = frame([(n,) for n in there] * 2, "node"), ("source_class", "target_class")
    made = mutate.connect_classes(nodes, frame(linked, *classes), frame(wanted, *classes), frame(sources, "source", "source_class", "weight"), frame(targets, "target", "target_class"))
    got = [(r["source"], r["target"], r["weight"]) for r in made.collect()]
    assert set(got) == expect and len(got) == len(expect) > 100
    assert any((a, b) in pairs(linked) for a, b in pairs(wanted) if a in there and b in there and {q for n, q in targets if n == b} > {"v"})
