"""Substrings, vectors, alike conversations, communities and the walk on bitmaps, each against a plain version."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import alike, graph, leiden, mutate, resolve, substrings, vectors
from recollect.plans.catalogue import QUERIES
from tests.test_growth import most_rows


def test_substrings_equal_all_pairs(spark):
    rng = random.Random(4)
    texts = [(f"n{i}", "".join(rng.choice("abcdé 😀") for _ in range(rng.randint(0, 60)))) for i in range(300)] + [("null", None), ("empty", ""), ("long", "ab" * 40_000 + "needle in it")]
    words = ["a", "é", "ab", "b c", "abc", "dcba", "éab a", "needle", "zz", "zzzz", "", "ab" * 50, "😀"]
    frame, asked = spark.createDataFrame(texts, "node string, text string"), spark.createDataFrame([(w,) for w in words], "word string")
    expect = sorted((w, n) for w in words if w for n, t in texts if t and w in t)
    assert sorted(map(tuple, substrings.search(frame, asked).collect())) == expect
    assert sorted(map(tuple, substrings.search(frame, asked, substrings.postings(frame)).collect())) == expect
    plan = substrings.search(frame, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in substrings.search(frame, asked)._jdf.queryExecution().executedPlan().toString() and "Cross" not in plan
    assert substrings.search(frame, asked.limit(0)).count() == 0 and substrings.search(frame.limit(0), asked).count() == 0


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    rows = [(i, [float(x) for x in centres[i % 20] + 0.4 * rng.normal(size=16)]) for i in range(4000)]
    rows += [(5000, [0.0] * 16), (5001, rows[3][1]), (5002, rows[3][1])]
    return rows


def nearest(rows, queries, k):
    unit = lambda v: np.asarray(v) / (np.linalg.norm(v) or 1.0)
    all_units = np.array([unit(v) for _, v in rows])
    out = {}
    for q, v in queries:
        similar = np.floor(1 / (2 - all_units @ unit(v)) * 10000 + 0.5) / 10000
        out[q] = [i for _, i in sorted((-s, i) for s, (i, _) in zip(similar.tolist(), rows, strict=True) if i != q)[:k]]
    return out


@pytest.mark.parametrize("tile", [(8192, 1024), (300, 7)])
def test_exact_neighbours(spark, cloud, monkeypatch, tile):
    monkeypatch.setattr(vectors, "VECTORS", tile[0])
    monkeypatch.setattr(vectors, "QUERIES", tile[1])
    queries = [r for r in cloud if r[0] % 200 == 0] + [(-1, cloud[3][1])]
    frame, asked = spark.createDataFrame(cloud, "item long, embedding array<double>"), spark.createDataFrame(queries, "query long, embedding array<double>")
    got = {}
    for r in vectors.exact(frame, asked, 10).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["item"])
    assert got == nearest(cloud, queries, 10)
    assert vectors.exact(frame, asked.limit(0), 10).count() == 0


def test_cells_cover_every_row_and_find_most(spark, cloud):
    frame = spark.createDataFrame(cloud, "item long, embedding array<double>")
    queries = [r for r in cloud if r[0] % 50 == 0]
    asked = spark.createDataFrame(queries, "query long, embedding array<double>")
    index = vectors.inverted_file(frame, cells=32, sample=1000)
    assert index.rows.count() == len(cloud) and len(index.centres) == 32
    expect = nearest(cloud, queries, 10)
    got = {(r["query"], r["item"]) for r in index.search(asked, 10, probes=6).collect()}
    assert sum((q, i) in got for q, items in expect.items() for i in items) / sum(map(len, expect.values())) >= 0.9
    assert {(r["query"], r["item"]) for r in index.search(asked, 10).collect()} == {(q, i) for q, items in expect.items() for i in items}
    assert vectors.inverted_file(frame.limit(0)).search(asked, 3).count() == 0


def test_cells_recall_on_the_table(spark, sf):
    exact = {(r["query"], r["item"]) for r in QUERIES["knn_cosine"](spark, sf).collect()}
    got = {(r["query"], r["item"]) for r in QUERIES["knn_cells"](spark, sf).collect()}
    assert len(got & exact) / len(exact) >= 0.9


@pytest.fixture(scope="module")
def talk(spark, sf):
    rng = random.Random(7)
    rows = [(f"{r['conv_id']}:{r['turn']}", r["conv_id"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()]
    words = [w for _, _, t in rows for w in t.split()]
    for i, (node, conv, text) in enumerate(rows[:60]):
        part = i % 5 / 10 + 0.05
        rows.append((f"9{node}", 1000 + i, " ".join(rng.choice(words) if rng.random() < part else w for w in text.split())))
    rows += [("x1", None, rows[0][2]), ("x2", 7, None), ("x3", 7, "short"), ("x4", 50_000, rows[5][2].upper()), ("x5", 50_001, rows[5][2]), ("x6", 50_002, "y" * 30_000), ("x7", 50_003, "y" * 600)]
    return rows


def test_alike_conversations_against_all_pairs(spark, talk, monkeypatch):
    monkeypatch.setattr(alike, "TILE", 16)
    groups, members = alike.classes(spark.createDataFrame(talk, "node string, conv long, text string"))
    texts = {}
    for node, conv, text in talk:
        if conv is not None and text and len(text) >= 10:
            texts.setdefault(text.lower()[:500], []).append((node, conv))
    named = {min(n for n, _ in v): (t, {c for _, c in v}) for t, v in texts.items()}
    expect = set()
    for a in named:
        for b in named:
            if a < b and len(named[a][1] | named[b][1]) > 1 and SequenceMatcher(None, named[a][0], named[b][0]).ratio() >= 0.6:
                expect.add((a, b))
    assert {(r["a"], r["b"]) for r in alike.links_exact(groups).collect()} == expect and len(expect) > 20
    got = {(r["a"], r["b"]) for r in alike.links(groups).collect()}
    assert got <= expect and len(got) / len(expect) >= 0.9
    assert sorted((r["node"], r["class"]) for r in members.collect()) == sorted((n, min(x for x, _ in v)) for v in texts.values() for n, _ in v)
    assert alike.links(groups.limit(0)).count() == 0 and alike.links_exact(groups.limit(0)).count() == 0


def louvain(edges):
    """The plain method: moves to the best neighbouring community, then the same among communities."""
    members = {v: v for e in edges for v in e[:2]}
    graph_ = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            graph_.setdefault(x, {})
            graph_[x][y] = graph_[x].get(y, 0.0) + w
    total = sum(sum(n.values()) for n in graph_.values())
    while True:
        label, degree = {v: v for v in graph_}, {v: sum(n.values()) for v, n in graph_.items()}
        whole, moved = dict(degree), True
        while moved:
            moved = False
            for v in sorted(graph_):
                links = {}
                for u, w in graph_[v].items():
                    if u != v:
                        links[label[u]] = links.get(label[u], 0.0) + w
                whole[label[v]] -= degree[v]
                best = max(sorted({label[v], *links}), key=lambda c: (round(links.get(c, 0.0) - degree[v] * whole[c] / total, 12), c == label[v]))
                whole[best] += degree[v]
                moved |= best != label[v]
                label[v] = best
        if len(set(label.values())) == len(graph_):
            return members
        members = {v: label[c] for v, c in members.items()}
        merged = {}
        for a, near in graph_.items():
            for b, w in near.items():
                row = merged.setdefault(label[a], {})
                row[label[b]] = row.get(label[b], 0.0) + w
        graph_ = merged


def graphs():
    rng = random.Random(3)
    ring = [(10 * c + i, 10 * c + j, 1.0) for c in range(8) for i in range(6) for j in range(i)] + [(10 * c, 10 * ((c + 1) % 8) + 1, 1.0) for c in range(8)]
    planted = [(a, b, 1.0) for a in range(120) for b in range(a) if rng.random() < (0.3 if a // 20 == b // 20 else 0.02)]
    tail = [(i, rng.randrange(max(1, i // 3)), 1.0 + rng.random()) for i in range(1, 150)] + [(rng.randrange(150), rng.randrange(150), 0.5) for _ in range(200)]
    return {"ring": ring, "planted": planted, "tail": [e for e in tail if e[0] != e[1]]}


@pytest.mark.parametrize("name, small", [("ring", 1 << 18), ("planted", 1 << 18), ("tail", 1 << 18), ("ring", 60), ("planted", 400), ("tail", 200)])
def test_leiden(spark, name, small):
    """Connected communities whose modularity is no less than that of the plain method; also where Spark coarsens first."""
    edges = graphs()[name]
    adj = graph.adjacency(spark.createDataFrame([(f"v{a:03}", f"v{b:03}", w) for a, b, w in edges], "source string, target string, weight double"))
    found = {r["node"]: r["community"] for r in leiden.leiden(adj, small=small).collect()}
    assert found.keys() == {f"v{x:03}" for e in edges for x in e[:2]} and all(found[c] == c for c in set(found.values()))
    near = {}
    for a, b, _ in edges:
        near.setdefault(f"v{a:03}", set()).add(f"v{b:03}")
        near.setdefault(f"v{b:03}", set()).add(f"v{a:03}")
    for c in set(found.values()):
        seen, stack = {c}, [c]
        while stack:
            for u in near[stack.pop()]:
                if found[u] == c and u not in seen:
                    seen.add(u)
                    stack.append(u)
        assert seen == {v for v in found if found[v] == c}
    plain = {f"v{v:03}": f"v{c:03}" for v, c in louvain(strongest(edges)).items()}
    frame = lambda m: spark.createDataFrame(list(m.items()), "node string, community string")
    got, least = graph.modularity(adj, frame(found)), graph.modularity(adj, frame(plain))
    assert got >= (least - 1e-9 if small > 1000 else 0.95 * least)


def strongest(edges):
    best = {}
    for a, b, w in edges:
        key = (min(a, b), max(a, b))
        best[key] = max(best.get(key, 0.0), w)
    return [(a, b, w) for (a, b), w in best.items()]


def test_leiden_odd_graphs(spark):
    schema = "src string, dst string, strength double"
    assert leiden.leiden(spark.createDataFrame([], schema)).count() == 0
    loop = spark.createDataFrame([("a", "a", 1.0), ("b", "c", 1.0), ("c", "b", 1.0)], schema)
    got = {r["node"]: r["community"] for r in leiden.leiden(loop).collect()}
    assert got["a"] == "a" and got["b"] == got["c"]


@pytest.mark.parametrize("many", [3, 200])
def test_walk_on_bits(spark, many):
    """As many queries as fill several longs, against a plain search in breadth."""
    rng = random.Random(many)
    edges = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(500)]
    anchors = [(f"q{q}", f"n{rng.randrange(400)}") for q in range(many) for _ in range(rng.randint(1, 3))] + [("q0", "nowhere")]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    expect = set()
    for q in {q for q, _ in anchors}:
        front = {n for p, n in anchors if p == q}
        seen = {n: 0 for n in front}
        for hop in range(1, 4):
            front = {m for n in front for m in near.get(n, ())} - seen.keys()
            seen.update(dict.fromkeys(front, hop))
        expect |= {(q, n, h) for n, h in seen.items()}
    connected = graph.connections(spark.createDataFrame(edges, "source string, target string"))
    got = graph.hops(connected, spark.createDataFrame(anchors, "query string, node string"), 3).collect()
    assert len(got) == len(expect) and {tuple(r) for r in got} == expect


def test_remap_leaves_other_edges_alone(spark):
    edges = spark.createDataFrame([("e1", "corrects", "a", "b", 1.0, 1.0), ("e2", "x", "c", "d", 0.4, 0.9), ("e3", "x", "c2", "d", 0.7, 0.2), ("e4", "x", "c2", "c", 0.7, 0.2), ("e5", "x", "c2", "z", 0.1, 0.6), ("e6", "y", "a", "b", 0.3, None), ("e7", "y", "a", "b", 0.5, 0.1)], "edge_id string, edge_type string, source string, target string, weight double, confidence double")
    names = spark.createDataFrame([(n, "c" if n == "c2" else n) for n in ("a", "b", "c", "c2", "d", "z")], "node string, canonical string")
    got = {(r["edge_id"], r["edge_type"], r["source"], r["target"], r["weight"], r["confidence"]) for r in resolve.remap(edges, names).collect()}
    assert got == {("e1", "corrects", "a", "b", 1.0, 1.0), ("e2", "x", "c", "d", 0.7, 0.9), (None, "x", "c", "z", 0.1, 0.6), ("e6", "y", "a", "b", 0.3, None), ("e7", "y", "a", "b", 0.5, 0.1)}


def test_update_of_one_node_twice(spark):
    nodes = spark.createDataFrame([(f"n{i}", "old", 0.5) for i in range(6)], "node string, label string, confidence double")
    twice = spark.createDataFrame([("n1", 1, "first", 0.7), ("n1", 2, "second", None), ("n2", 1, "own", None)], "node string, seq int, label string, confidence double")
    got = {r["node"]: (r["label"], r["confidence"]) for r in mutate.update(nodes, twice).collect()}
    assert len(got) == 6 == mutate.update(nodes, twice).count() and got["n1"] == ("second", 0.7) and got["n2"] == ("own", 0.5) and got["n3"] == ("old", 0.5)
    with pytest.raises(Exception, match="disagree"):
        mutate.update(nodes, twice.drop("seq")).collect()
    assert mutate.update(nodes, twice.where("node = 'n2'").drop("seq")).where(F.col("label") == "own").count() == 1


def test_alike_candidates_are_settled_where_tiles_meet(spark, monkeypatch):
    """Texts that all share a band with each other: no step puts out their pairs, and no link of another tile is lost."""
    monkeypatch.setattr(alike, "BLOCK", 32)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(6))
    texts = [f"one and the same beginning of all these texts {' '.join(word() for _ in range(k % 24 + 3))}" for k in range(120)]
    texts += [t[:-3] + "b q" for t in texts[:20]]
    rows = [(f"n{i:03}", i, t) for i, t in enumerate(texts)]
    groups, _ = alike.classes(spark.createDataFrame(rows, "node string, conv long, text string"))
    got = {}
    most = most_rows(spark, lambda: got.update({(r["a"], r["b"]): r["share"] for r in alike.links(groups).collect()}))
    exact = {}
    for y, _, b in rows:
        met = SequenceMatcher(None, "", b)
        for x, _, a in rows[: int(y[1:])]:
            met.set_seq1(a)
            if met.quick_ratio() >= 0.6 and met.ratio() >= 0.6:
                exact[x, y] = met.ratio()
    assert got.items() <= exact.items() and len(got) >= 0.9 * len(exact) and len(got) > 20
    assert most <= max(len(got), len(rows)) < len(rows) * (len(rows) - 1) / 4
