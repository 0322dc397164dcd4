"""Operators against brute force and by hand."""

import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from recollect.functions import similarity, temporal, text
from recollect.operators import evaluate, extract, govern, graph, lifecycle, recall, render, resolve
from recollect.sources import files


def test_walk_against_levels(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", round(rng.random(), 3)) for _ in range(70)]
    frame = spark.createDataFrame([(*e, "related_to") for e in edges], "source string, target string, weight double, edge_type string")
    anchors = spark.createDataFrame([("a", "n1"), ("a", "n2"), ("b", "n9")], "query string, node string")
    got = {(r["query"], r["node"]): (r["hops"], round(r["strength"], 9), tuple(r["path"])) for r in graph.walk(graph.adjacency(frame), anchors, 3, paths=True).collect()}
    best = {}
    for s, t, w in edges:
        for x, y in ((s, t), (t, s)):
            best[x, y] = max(best.get((x, y), 0), w)
    expect = {}
    for query, starts in (("a", ["n1", "n2"]), ("b", ["n9"])):
        seen = {n: (0, 1.0, (n,)) for n in starts}
        for hop in range(1, 4):
            found = {}
            for n, (h, s, p) in seen.items():
                if h == hop - 1:
                    for (x, y), w in best.items():
                        if x == n and y not in seen:
                            found[y] = min(found.get(y, (0.0, ())), (-s * w, (*p, y)))
            seen |= {n: (hop, -s, p) for n, (s, p) in found.items()}
        expect |= {(query, n): (h, round(s, 9), p) for n, (h, s, p) in seen.items()}
    assert got == expect
    plain = {(r["query"], r["node"]): (r["hops"], round(r["strength"], 9)) for r in graph.walk(graph.adjacency(frame), anchors, 3).collect()}
    assert plain == {k: v[:2] for k, v in expect.items()}


def test_reach_survives_cycles(spark):
    e = spark.createDataFrame([("a", "b", "derived_from"), ("b", "c", "derived_from"), ("c", "a", "derived_from"), ("c", "d", "related_to")], "source string, target string, edge_type string")
    q = spark.createDataFrame([("a", "a")], "query string, node string")
    assert {(r["node"], r["hops"]) for r in graph.lineage(e, q).collect()} == {("b", 1), ("c", 2)}
    assert {(r["node"], r["hops"]) for r in graph.forget_preview(e, q).collect()} == {("c", 1), ("b", 2)}


def test_communities_split_cliques(spark):
    pairs = [(a, b, 1.0) for g in ("ab", "xy") for a, b in itertools.combinations([f"{c}{i}" for c in g for i in range(3)], 2)] + [("a0", "x0", 0.01)]
    adj = graph.adjacency(spark.createDataFrame(pairs, "source string, target string, weight double"))
    groups = {}
    for r in graph.communities(adj).collect():
        groups.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(len, groups.values())) == [6, 6]


def test_modular_communities_find_the_groups(spark):
    pairs = [(a, b, 1.0) for g in "abcd" for a, b in itertools.combinations([f"{g}{i}" for i in range(5)], 2)] + [("a0", "b0", 0.1), ("b1", "c0", 0.1), ("c1", "d0", 0.1)]
    adj = graph.adjacency(spark.createDataFrame(pairs, "source string, target string, weight double"))
    members = graph.modular_communities(adj)
    groups = {}
    for r in members.collect():
        groups.setdefault(r["community"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [[f"{g}{i}" for i in range(5)] for g in "abcd"]
    inside, whole, of = 0.0, 0.0, {n: c for c, ns in groups.items() for n in ns}
    weight = dict.fromkeys(groups, 0.0)
    for a, b, w in pairs:
        whole += 2 * w
        weight[of[a]] += w
        weight[of[b]] += w
        inside += 2 * w * (of[a] == of[b])
    assert abs(graph.modularity(adj, members) - (inside / whole - sum((w / whole) ** 2 for w in weight.values()))) < 1e-9
    assert graph.modular_communities(adj.where("false")).count() == 0


def test_communities_run_until_no_label_moves(spark):
    pairs = [(f"n{i:02}", f"n{i + 1:02}", 1.0) for i in range(13)]
    adj = graph.adjacency(spark.createDataFrame(pairs, "source string, target string, weight double"))
    assert {r["community"] for r in graph.communities(adj).collect()} == {"n00"}
    with pytest.raises(RuntimeError):
        graph.communities(adj, max_rounds=3)


@pytest.mark.parametrize(
    ("sentence", "start", "end", "granularity"),
    [
        ("met on 3 March 2021.", "2021-03-03 00:00:00", "2021-03-03 23:59:59", "day"), ("on Sept 9th, 2020 we", "2020-09-09 00:00:00", "2020-09-09 23:59:59", "day"), ("in february 2024", "2024-02-01 00:00:00", "2024-02-29 23:59:59", "month"),
        ("on 31 february 2024", None, None, None), ("since 1999", "1999-01-01 00:00:00", "1999-12-31 23:59:59", "year"), ("3 weeks ago", "2024-04-22 00:00:00", "2024-04-28 23:59:59", "week"),
        ("a month ago", "2024-04-01 00:00:00", "2024-04-30 23:59:59", "month"), ("next year", "2025-01-01 00:00:00", "2025-12-31 23:59:59", "year"), ("last wednesday", "2024-05-08 00:00:00", "2024-05-08 23:59:59", "day"),
        ("on thursday", "2024-05-09 00:00:00", "2024-05-09 23:59:59", "day"), ("recently", None, None, None), (None, None, None, None),
    ],
)
def test_event_time(spark, sentence, start, end, granularity):
    df = spark.createDataFrame([(sentence, dt.datetime(2024, 5, 15, 12))], "t string, said timestamp")  # a Wednesday
    e = df.select(temporal.event_time("t", "said").alias("e")).select("e.*").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss"), F.date_format("end", "yyyy-MM-dd HH:mm:ss"), "granularity").first()
    assert tuple(e) == (start, end, granularity)


def test_porter_stems():
    words = "caresses ponies cats feed agreed plastered motoring conflated hopping falling hissing fizzed happy relational conditional digitizer operator feudalism hopefulness triplicate formalize revival adjustment adoption controlling rate cease roll".split()
    expect = "caress poni cat feed agre plaster motor conflat hop fall hiss fizz happi relat condit digit oper feudal hope triplic formal reviv adjust adopt control rate ceas roll".split()
    assert [similarity.stem(w) for w in words] == expect


def test_ratio_and_f1(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "x"), ("the running dogs", "a dog runs")], "a string, b string")
    got = [r[0] for r in df.select(similarity.ratio("a", "b")).collect()]
    assert got[0] == 0.75 and got[1] is None
    assert evaluate.token_f1(df.where("a like 'the%'"), "a", "b").first()["f1"] == 1.0


def test_topics_follow_their_order(spark):
    t = "alpha beta alpha beta gamma gamma gamma alphabet alphabet alphabet delta"
    got = [(r["topic"], r["frequency"]) for r in extract.topics(spark.createDataFrame([(1, t), (2, ""), (3, None)], "id int, text string"), "id", "text").orderBy("rank").collect()]
    assert got[:3] == [("alpha beta", 2), ("alphabet alphabet", 2), ("gamma gamma", 2)] and ("alphabet", 3) not in got and len(got) == 3


def test_fuzzy_pairs_are_complete(spark):
    rng = random.Random(1)
    labels = ["".join(rng.choices("ab c", k=rng.randint(0, 9))) for _ in range(60)]
    df = spark.createDataFrame([(x,) for x in labels], "label string")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    got = {(r["a"], r["b"]) for r in resolve.fuzzy_pairs(df, df, 3).collect()}
    assert got == {(a, b) for a in labels for b in labels if lev(a, b) < 3}


def test_dedup_greedy_replays_whole_types(spark):
    from difflib import SequenceMatcher

    rng = random.Random(5)

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    labels = ["cat", "bat", "zebra crossing", "the zebra crossings", None, ""]
    for _ in range(60):
        base = "".join(rng.choices("abcdefghij ", k=rng.randint(6, 40)))
        for _ in range(3):
            at = rng.randrange(len(base))
            labels.append(rng.choice(["", "Xy", "the "]) + base[:at] + "".join(rng.choices("qrstuv", k=rng.randint(0, 6))) + base[at + rng.randint(0, 4) :])
    rows = [(f"n{i:03}", ("topic", "entity", "context")[rng.choice((0, 0, 0, 1, 1, 2)) if i > 3 else 0], x) for i, x in enumerate(labels)]
    df = spark.createDataFrame(rows, "node string, node_type string, label string").repartition(3)
    norm = {r["node"]: r["norm"] for r in df.select("node", resolve.normalize_label("label").alias("norm")).collect()}
    expect, kept = {}, {}
    for node, kind, _ in rows:
        x, seen = norm[node], kept.setdefault(kind, {})
        if kind == "context" or x is None:
            expect[node] = node
            continue
        found = seen.get(x) or next((k for y, k in seen.items() if lev(y, x) < 5 or SequenceMatcher(None, y, x).ratio() >= 0.75), None)
        expect[node] = found or seen.setdefault(x, node)
    got = {r["node"]: r["canonical"] for r in resolve.dedup_greedy(df).collect()}
    assert got == expect and got["n001"] == "n000" and sum(k != v for k, v in got.items()) > 20


def test_claims(spark):
    said = ["I love tea", "I am sober", None, "", "I feel happy, and I was born in Oslo", "My favourite colour is red"]
    got = govern.classify(spark.createDataFrame([(i, t) for i, t in enumerate(said)], "id int, text string")).orderBy("id").collect()
    assert [r["claim_type"] for r in got] == ["preference_habit", None, None, None, got[4]["claim_type"], "preference_habit"] and got[4]["compound"] and got[4]["status"] != "classified"
    df = spark.createDataFrame([("I am s.o.b.e.r now",), ("sober!",), ("nothing",), (None,)], "t string")
    assert [r[0] for r in df.select(govern.tripwire(F.col("t"))).collect()] == [None, "recovery", None, None]


def test_change(spark):
    pairs = [("I live in Boston", "I moved to Denver"), ("I live in Boston", "I still live in Boston"), ("My favourite drink is tea", "My favourite show is now Lost"), ("I play chess weekly", "I quit chess"), ("I drive a Honda Civic", "I drive the Civic"), ("", "x")]
    df = spark.createDataFrame(pairs, "a string, b string").select(govern.change(F.col("a"), F.col("b")).alias("c")).select("c.*")
    assert [tuple(r) for r in df.collect()] == [("residence", True), ("residence", False), ("favourite", False), ("generic_change", True), ("vehicle", False), (None, False)]


def test_import_is_all_or_nothing(spark):
    n = lambda *ids: spark.createDataFrame([(i,) for i in ids], "node string")
    e = lambda *rows: spark.createDataFrame(rows, "edge_id string, source string, target string")
    with pytest.raises(ValueError, match="doubled"):
        lifecycle.import_graph(n("a"), e(("1", "a", "a")), n("b", "b"), e(("2", "b", "b")), "merge")
    with pytest.raises(ValueError, match="both ends"):
        lifecycle.import_graph(n("a"), e(("1", "a", "a")), n("b"), e(("2", "b", "z")), "merge")
    with pytest.raises(ValueError, match="not empty"):
        lifecycle.import_graph(n("a"), e(("1", "a", "a")), n("b"), e(("2", "b", "b")), "refuse")
    nodes, edges = lifecycle.import_graph(n("a"), e(("1", "a", "a")), n("a", "b"), e(("1", "a", "b"), ("2", "b", "a")), "merge")
    assert nodes.count() == 2 and {tuple(r) for r in edges.collect()} == {("1", "a", "a"), ("2", "b", "a")}


def test_supersede_writes_bounds_once(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    nodes = spark.createDataFrame([("old", None, t("2024-01-01"), t("2023-01-01"), None, None), ("new", t("2024-03-01"), t("2024-03-05"), None, None, None), ("other", None, t("2024-01-01"), None, None, None)], "node string, event_start timestamp, recorded_at timestamp, valid_from timestamp, valid_until timestamp, invalidated_at timestamp")
    got = {r["node"]: r for r in lifecycle.supersede(nodes, spark.createDataFrame([("old", "new")], "old string, new string"), F.lit("2024-04-01").cast("timestamp")).collect()}
    assert got["old"]["valid_from"] == t("2023-01-01") and got["old"]["valid_until"] == t("2024-03-01") and got["old"]["invalidated_at"] == t("2024-04-01")
    assert got["new"]["valid_from"] == t("2024-03-01") and got["other"]["valid_until"] is None


def test_keyword_anchors_and_scores(spark):
    rows = [("a", "topic", "Atlas server", "runs", "2024-01-01"), ("b", "topic", "x", "the atlas", "2024-02-01"), ("c", "context", "atlas", "", "2024-03-01")]
    nodes = spark.createDataFrame(rows, "node string, node_type string, label string, content string, created_at string")
    q = spark.createDataFrame([("q", "What about Atlas")], "query string, text string")
    assert [(r["node"], r["rank"]) for r in recall.keyword_anchors(nodes, q).orderBy("rank").collect()] == [("b", 1), ("a", 2)]
    df = spark.range(1).select(recall.proximity(F.lit(2)), recall.proximity(F.lit(4)), recall.frequency(F.lit(50)), recall.final_score(F.lit(0.5), F.lit(0.8), F.lit(0.15), F.lit(0.5)))
    assert tuple(df.first()) == (0.4, 0.0, 1.0, 0.5375)


def test_text_functions(spark):
    df = spark.createDataFrame([("The Atlas-Server's  nodes", "User:  hello\nmore", "x" * 150 + " " + "y" * 100)], "a string, b string, c string")
    r = df.select(text.normalize_label("a"), text.context_label(F.concat(F.lit("\n  "), "b")), text.truncate_label("c"), text.slug("a"), text.basename(F.lit("C:\\dir/file.txt")), text.safe_filename(F.lit("a/b: c"))).first()
    assert tuple(r) == ("atlas server nodes", "hello", "x" * 150 + "...", "the-atlas-server-s-nodes", "file.txt", "ab c")


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntags: x\n---\nintro\n# One\nbody [[Link|alias]] #tag\n## Two\n")
    (tmp_path / "b.bin").write_text("no")
    (tmp_path / "c.jsonl").write_text(json.dumps({"role": "user", "content": "hi"}))
    found = files.watched(spark, str(tmp_path))
    assert {(r["source_id"], r["content_type"]) for r in found.collect()} == {("file:a.md", "document"), ("file:c.jsonl", "conversation")}
    assert files.watched(spark, str(tmp_path), since="2100-01-01").count() == 0
    note = found.where("source_id = 'file:a.md'")
    assert [(r["heading"], r["body"]) for r in files.chunks(note, "source_id", "content").orderBy("i").collect()] == [("", "intro"), ("One", "body [[Link|alias]] #tag"), ("Two", "")]
    assert note.select(files.links(F.col("content"))).first()[0] == ["Link", "tag"]
    lines = spark.createDataFrame([("s", 1, '{"type": "user", "content": "hi"}'), ("s", 2, '{"payload": {"role": "assistant", "content": "yo"}}'), ("s", 3, "broken"), ("s", 4, '{"type": "tool", "content": "x"}')], "s string, o int, line string")
    assert tuple(files.transcript(lines, "s", "line", "o").first()) == ("s", "User: hi\nAssistant: yo", 2)


def test_tabular_quotes(spark):
    df = spark.createDataFrame([("g", 1, "a,b"), ("g", 2, None), ("g", 3, 'say "x"'), ("g", 4, "12"), ("g", 5, "plain")], "g string, i int, v string")
    assert render.tabular(df, "g", "rows", ["i", "v"], ["i"]).first()["text"] == 'rows[5]{i,v}:\n  1,"a,b"\n  2,null\n  3,"say \\"x\\""\n  4,"12"\n  5,plain'


def test_extraction_merges_names(spark):
    t = 'We met "Project Blue" at New York with the data layer, PostgreSQL and postgresql.'
    docs = spark.createDataFrame([(1, t)], "id int, text string")
    assert {r["label"] for r in extract.entities(docs, "id", "text").collect()} >= {"Project Blue", "New York"}
    assert {(r["term"], r["label"]) for r in extract.tech_entities(docs, "id", "text").collect()} == {("postgresql", "PostgreSQL"), ("postgres", "Postgre" + "S")}
