"""Queries over the memory graph: traversal, scores, recall, lifecycle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions.text import r4
from recollect.operators import graph, lifecycle, recall, resolve
from recollect.plans import views
from recollect.plans.registry import query
from recollect.session import materialize, table

R4 = lambda x: f"floor(({x}) * 10000 + 0.5) / 10000"


def _walk_sql(anchors: str, depth: int, final: str, base: str = views.SQL, path: bool = False) -> str:
    """Levels as a chain of tables: fewest hops, then the greatest product, then the least path."""
    levels, seen = [f"l0 AS (SELECT query, node, 0 AS hops, 1.0::DOUBLE AS strength, [node] AS path FROM ({anchors}))"], "SELECT query, node FROM l0"
    for i in range(1, depth + 1):
        step = f"SELECT l.query, a.dst AS node, l.strength * a.strength AS strength, list_append(l.path, a.dst) AS path FROM l{i - 1} l JOIN adj a ON a.src = l.node ANTI JOIN ({seen}) v ON v.query = l.query AND v.node = a.dst"
        pick = "row_number() OVER (PARTITION BY query, node ORDER BY strength DESC, path) = 1" if path else "row_number() OVER (PARTITION BY query, node ORDER BY strength DESC) = 1"
        levels.append(f"l{i} AS MATERIALIZED (SELECT query, node, {i} AS hops, strength, path FROM ({step}) QUALIFY {pick})")
        seen += f" UNION ALL SELECT query, node FROM l{i}"
    every = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(depth + 1))
    return f"WITH {base}, {', '.join(levels)}, walked AS ({every}) {final}"


@query(f"WITH {views.SQL} SELECT src, dst, {R4('strength')} AS strength FROM adj")
def adjacency_max(spark, d):
    """Both directions of every edge, the strongest of parallel ones."""
    return graph.adjacency(views.edges(spark, d)).select("src", "dst", r4(F.col("strength")).alias("strength"))


@query(f"WITH {views.SQL}, w AS (SELECT source, target, weight * confidence AS s FROM edges), f AS (SELECT source AS src, target AS dst, s FROM w UNION ALL SELECT target, source, s FROM w) SELECT src, count(DISTINCT dst) AS neighbours, {R4('max(s)')} AS strongest FROM f GROUP BY 1")
def neighbours_by_confidence(spark, d):
    adj = graph.adjacency(views.edges(spark, d), use_confidence=True)
    return adj.groupBy("src").agg(F.count("*").alias("neighbours"), r4(F.max("strength")).alias("strongest"))


@query(f"WITH {views.SQL} SELECT node_type, count(*) AS edges FROM edges JOIN nodes ON node = source OR node = target GROUP BY 1")
def incident_edges(spark, d):
    """How many edges touch nodes of each type."""
    e, n = views.edges(spark, d), views.nodes(spark, d).select("node", "node_type")
    ends = e.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("node"))
    return ends.join(n, "node").groupBy("node_type").agg(F.count("*").alias("edges"))


NATION_ANCHORS = "SELECT n_name AS query, 'n' || n_nationkey AS node FROM nation"


def _nations(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("query"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))


@query(_walk_sql(NATION_ANCHORS, 3, f"SELECT query, hops, count(*) AS nodes, {R4('max(strength)')} AS strongest, {R4('min(strength)')} AS weakest FROM walked GROUP BY 1, 2"))
def bfs_walk(spark, d):
    """Three steps from every nation, summed by distance."""
    walked = graph.walk(graph.strengths(views.edges(spark, d)), _nations(spark, d), 3)
    return walked.groupBy("query", "hops").agg(F.count("*").alias("nodes"), r4(F.max("strength")).alias("strongest"), r4(F.min("strength")).alias("weakest"))


@query(_walk_sql(NATION_ANCHORS, 2, f"SELECT query, node, hops, {R4('strength')} AS strength, array_to_string(path, '>') AS path FROM walked", path=True))
def walk_paths(spark, d):
    """Two steps from every nation, with the path of each node."""
    walked = graph.walk(graph.strengths(views.edges(spark, d)), _nations(spark, d), 2, paths=True)
    return walked.select("query", "node", "hops", r4(F.col("strength")).alias("strength"), F.array_join("path", ">").alias("path"))


@query(_walk_sql(NATION_ANCHORS, 2, "SELECT query, edge_type, count(*) AS edges FROM (SELECT DISTINCT query, e.* FROM walked JOIN edges e ON e.source = walked.node OR e.target = walked.node) GROUP BY 1, 2"))
def subgraphs(spark, d):
    """Edges around each nation's first two rings."""
    return graph.subgraph(views.edges(spark, d), _nations(spark, d), 2).groupBy("query", "edge_type").agg(F.count("*").alias("edges"))


@query(f"WITH RECURSIVE {views.DERIVED_SQL}, r(query, node, hops) AS (SELECT source, source, 0 FROM derived UNION ALL SELECT r.query, d.target, hops + 1 FROM r JOIN derived d ON d.source = r.node WHERE hops < 10) SELECT query, count(*) AS origins, max(hops) AS depth FROM r WHERE hops > 0 GROUP BY 1")
def lineage(spark, d):
    """What every order was derived from, ten steps back at most."""
    e = views.derived(spark, d)
    return graph.lineage(e, e.select(F.col("source").alias("query"), F.col("source").alias("node")), 10).groupBy("query").agg(F.count("*").alias("origins"), F.max("hops").alias("depth"))


@query(f"WITH RECURSIVE {views.DERIVED_SQL}, r(query, node) AS (SELECT target, source FROM derived UNION SELECT r.query, d.source FROM r JOIN derived d ON d.target = r.node) SELECT query, count(*) AS descendants FROM r WHERE node IS DISTINCT FROM query GROUP BY 1")
def forget_preview(spark, d):
    """How many orders derive from every order, to the end of every chain."""
    e = views.derived(spark, d)
    return graph.forget_preview(e, e.select(F.col("target").alias("query"), F.col("target").alias("node"))).groupBy("query").agg(F.count("*").alias("descendants"))


@query("WITH e AS (SELECT 'c' || o_custkey AS node FROM orders WHERE o_orderstatus = 'P') SELECT 'c' || c_custkey AS node FROM customer WHERE 'c' || c_custkey NOT IN (SELECT node FROM e)")
def orphans(spark, d):
    """Customers without pending orders."""
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("oc"), F.col("o_orderkey").cast("string")).alias("edge_id"))
    e = views.edges(spark, d).where("edge_type = 'mentioned_by'").join(pending, "edge_id", "left_semi")
    return graph.orphans(views.nodes(spark, d).where("node like 'c%'").select("node"), e)


@query("""
WITH gone AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT 'oc' || k AS edge_id FROM gone
UNION ALL SELECT 'op' || l_orderkey || '.' || l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT k FROM gone) OR l_orderkey NOT IN (SELECT o_orderkey FROM orders) OR l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'ps' || l_orderkey || '.' || l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) OR l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'oc' || o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'sn' || s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'cn' || c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
""")
def dangling_edges(spark, d):
    """Edges of which an end is not live."""
    live = views.rich(spark, d).where("invalidated_at is null").select("node")
    return graph.dangling(views.edges(spark, d), live).select("edge_id")


TENSION_SQL = "SELECT a.l_partkey AS x, b.l_partkey AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = 'R' AND b.l_returnflag = 'A' AND a.l_partkey <> b.l_partkey"


@query(f"WITH p AS ({TENSION_SQL}) SELECT DISTINCT least('p' || x, 'p' || y) AS a, greatest('p' || x, 'p' || y) AS b FROM p WHERE x IN (SELECT p_partkey FROM part WHERE p_size > 5) AND y IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def tension_pairs(spark, d):
    """Parts that one order returned and kept; an order has seven lines at most."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    a, b = li.where("l_returnflag = 'R'").select("l_orderkey", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source")), li.where("l_returnflag = 'A'").select("l_orderkey", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"))
    e = a.join(b, "l_orderkey").where("source <> target").select("source", "target", F.lit("conflicts_with").alias("edge_type"))
    parts = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"), F.when(F.col("p_size") <= 5, F.current_timestamp()).alias("invalidated_at"))
    return graph.tensions(e, parts)


@query(f"""
WITH {views.RICH_SQL}, src AS (SELECT node, confidence AS c FROM rich WHERE node LIKE 'c%'),
g1 AS (SELECT a.dst AS node, max(c * (1 - 0.1::DOUBLE * 1)) AS g FROM src JOIN adj a ON a.src = src.node GROUP BY 1), r1 AS (SELECT g1.node, g FROM g1 JOIN rich USING (node) WHERE g > confidence),
g2 AS (SELECT a.dst AS node, max(r1.g * (1 - 0.1::DOUBLE * 2)) AS g FROM r1 JOIN adj a ON a.src = r1.node GROUP BY 1), r2 AS (SELECT g2.node, g2.g FROM g2 JOIN rich USING (node) WHERE g2.g > confidence)
SELECT node, {R4('max(g)')} AS confidence FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY 1
""")
def propagate_confidence(spark, d):
    """Confidence passed on from the customers."""
    n = views.rich(spark, d)
    return graph.propagate(graph.connections(views.edges(spark, d)), n, n.where("node like 'c%'").select("node")).select("node", r4(F.col("confidence")).alias("confidence"))


@query()
def communities(spark, d):
    """Communities of the graph, with their centroids; label propagation has no SQL here."""
    names, adj = graph.coded(views.edges(spark, d))
    return rolled(graph.communities(adj, dealt=True), adj, names)


def rolled(members, adj, names):
    """The communities of a coded graph with the names of their nodes."""
    found = materialize(graph.community_rollup(members, adj).drop("centroid"), "rollup")
    tops = graph.named(found.select("community", F.posexplode("top_labels").alias("place", "node")), names, "node")
    tops = tops.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("place", "node"))).getField("node").alias("top_labels"))
    out = graph.named(found.select("community", "size").join(tops, "community"), names, "community")
    return out.select("community", "size", F.element_at("top_labels", 1).alias("centroid"), F.array_join("top_labels", ",").alias("top_labels"))


SCORE = f"""
parts AS (SELECT node, created_at, access_count, {R4("pow(0.5::DOUBLE, greatest((epoch(TIMESTAMP '2024-02-01') - floor(epoch(created_at))) / 86400.0::DOUBLE, 0.0::DOUBLE) / 365.0::DOUBLE)")} AS recency, {R4('least(1.0::DOUBLE, ln(1 + access_count::DOUBLE) / ln(51.0::DOUBLE))')} AS frequency FROM rich)"""


@query(f"WITH {views.RICH_SQL}, {SCORE} SELECT node, recency, frequency, {R4('0.35::DOUBLE * recency + 0.30::DOUBLE * frequency + 0.35::DOUBLE')} AS score FROM parts")
def three_factor(spark, d):
    """Recency, frequency and score of every node at distance zero."""
    n = views.rich(spark, d)
    now = F.lit(views.NOW).cast("timestamp")
    n = n.select("node", recall.recency(now, F.col("created_at")).alias("recency"), recall.frequency(F.col("access_count")).alias("frequency"))
    return n.withColumn("score", recall.three_factor(F.col("recency"), F.col("frequency"), recall.proximity(F.lit(0))))


def _recall_sql(live: str) -> str:
    proximity = R4("CASE WHEN hops > 3 THEN 0.0::DOUBLE ELSE greatest(1 - 0.3::DOUBLE * hops, 0.0::DOUBLE) END")
    final = f"""
    , {SCORE}, scored AS (SELECT query, walked.node, hops, recency, frequency, {proximity} AS proximity, confidence FROM walked JOIN rich USING (node) JOIN parts USING (node) WHERE {live}),
    total AS (SELECT *, {R4(f"{R4('0.35::DOUBLE * recency + 0.30::DOUBLE * frequency + 0.35::DOUBLE * proximity')} * confidence")} AS score FROM scored)
    SELECT query, node, hops, recency, frequency, proximity, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS rank FROM total WHERE score >= 0.01 QUALIFY rank <= 20"""
    return _walk_sql(NATION_ANCHORS, 3, "@", base=views.RICH_SQL).replace(" @", final)


@query(_recall_sql("invalidated_at IS NULL"))
def recall_topn(spark, d):
    """The twenty best nodes around every nation."""
    found = recall.recall(views.rich(spark, d), views.edges(spark, d), _nations(spark, d), F.lit(views.NOW).cast("timestamp"), top=20)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT query, node, hops, frequency, score, place AS rank FROM (SELECT query, node, hops, frequency, score, row_number() OVER (PARTITION BY query ORDER BY frequency DESC, rank) AS place FROM ({_recall_sql('invalidated_at IS NULL')}) QUALIFY place <= 5)")
def recall_reranked(spark, d):
    """The five best of the first twenty around every nation when these are put in order anew by how often they were used."""
    found = recall.recall(views.rich(spark, d), views.edges(spark, d), _nations(spark, d), F.lit(views.NOW).cast("timestamp"), top=5, rerank=lambda rows: rows["frequency"], head=20)
    return found.select("query", "node", "hops", "frequency", "score", F.col("rank").cast("long").alias("rank"))


@query(_recall_sql("NOT coalesce(valid_from > TIMESTAMP '1996-06-01', false) AND NOT coalesce(valid_until <= TIMESTAMP '1996-06-01', false) AND NOT (invalidated_at IS NOT NULL AND valid_until IS NULL)"))
def recall_as_of(spark, d):
    """The same as of a day in the past."""
    at = F.lit("1996-06-01").cast("timestamp")
    found = recall.recall(views.rich(spark, d), views.edges(spark, d), _nations(spark, d), F.lit(views.NOW).cast("timestamp"), top=20, as_of=at)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {views.RICH_SQL} SELECT CASE WHEN valid_from > TIMESTAMP '1996-06-01' THEN 'not_yet_valid' WHEN valid_until <= TIMESTAMP '1996-06-01' THEN 'no_longer_valid' WHEN invalidated_at IS NOT NULL AND valid_until IS NULL THEN 'invalidated' ELSE 'kept' END AS reason, count(*) AS n FROM rich GROUP BY 1")
def filter_reasons(spark, d):
    reason = recall.as_of_reason(F.lit("1996-06-01").cast("timestamp"), F.col("node_type"), F.col("valid_from"), F.col("valid_until"), F.col("invalidated_at"))
    return views.rich(spark, d).groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


COSINE = R4("1 / (2 - CASE WHEN vn > 0 AND qn > 0 THEN dot / (vn * qn) ELSE 0 END)")
KNN_SQL = f"""
e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, label FROM embeddings),
knn AS (SELECT q.vec_id AS query, e.vec_id AS item, {COSINE.replace('vn', 'e.n').replace('qn', 'q.n').replace('dot', 'list_dot_product(e.v, q.v)')} AS similarity, e.label AS item_label, q.label AS query_label FROM e JOIN e q ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item) AS rank FROM knn QUALIFY rank <= 30)"""


def _knn(spark, d):
    """Queries are the vectors whose id is divisible by 50: the stated query set, against all vectors."""
    v = table(spark, d, "embeddings")
    return recall.knn(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "embedding"))


@query(f"WITH {KNN_SQL} SELECT query, item, similarity, rank FROM top")
def knn_cosine(spark, d):
    return _knn(spark, d).withColumn("rank", F.col("rank").cast("long"))


@query(f"""
WITH {KNN_SQL}, lists AS (SELECT query, item, rank FROM top UNION ALL SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY abs(item - query), item) AS rank FROM top),
fused AS (SELECT query, item, floor(sum(1.0::DOUBLE / (60 + rank)) * 1e8 + 0.5) / 1e8 AS score FROM lists GROUP BY 1, 2)
SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM fused QUALIFY rank <= 30
""")
def rrf_fusion(spark, d):
    """Nearest vectors fused with the order of their ids' distance."""
    near = materialize(_knn(spark, d), "knn")
    other = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.abs(F.col("item") - F.col("query")), "item")))
    return recall.rrf(near.select("query", "item", "rank").unionByName(other.select("query", "item", "rank"))).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {KNN_SQL} SELECT query, item, {R4('(similarity + 0.25::DOUBLE * ' + R4('0.35::DOUBLE * (1.0::DOUBLE / rank)') + ' + CASE WHEN item_label = query_label THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) * 0.9::DOUBLE')} AS score FROM top")
def semantic_first(spark, d):
    """Similarity first, refined by a base score and a boost for the same community (label)."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    near = _knn(spark, d).join(labels.select(F.col("vec_id").alias("item"), F.col("label").alias("a")), "item").join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("b")), "query")
    base = r4(0.35 * (1.0 / F.col("rank")))
    return near.select("query", "item", recall.final_score(base, F.col("similarity"), F.when(F.col("a") == F.col("b"), recall.BOOST).otherwise(0.0), F.lit(0.9)).alias("score"))


USERS_SQL = "users AS (SELECT user_id AS node, 'inferred' AS source_type, user_id % 7 = 0 AS pinned, least(1.0::DOUBLE, 0.2::DOUBLE + count(*) / 100.0::DOUBLE) AS confidence, min(ts) AS created_at, max(ts) FILTER (WHERE event_type <> 'view') AS last_referenced FROM events GROUP BY 1)"


def _users(spark, d):
    """Users as nodes: the more events the surer, referenced by anything but a view, every seventh pinned."""
    e = table(spark, d, "events")
    out = e.groupBy(F.col("user_id").alias("node")).agg(F.count("*").alias("n"), F.min("ts").alias("created_at"), F.max(F.when(F.col("event_type") != "view", F.col("ts"))).alias("last_referenced"))
    return out.select("node", F.lit("inferred").alias("source_type"), (F.col("node") % 7 == 0).alias("pinned"), F.least(F.lit(1.0), 0.2 + F.col("n") / 100.0).alias("confidence"), "created_at", "last_referenced", F.lit(None).cast("timestamp").alias("invalidated_at"))


LATER = "2024-06-01 00:00:00"
DECAYED = "CASE WHEN NOT pinned THEN least(confidence, greatest(0.15::DOUBLE, confidence - floor(greatest((epoch(TIMESTAMP '2024-06-01') - floor(epoch(coalesce(last_referenced, created_at)))) / 86400.0::DOUBLE, 0.0::DOUBLE)) / 7 * 0.01::DOUBLE)) ELSE confidence END"


@query(f"WITH {USERS_SQL} SELECT * FROM (SELECT node, {R4('confidence')} AS before, {R4(DECAYED)} AS after FROM users) WHERE before - after > 0.005::DOUBLE")
def decay(spark, d):
    return lifecycle.decay(_users(spark, d), F.lit(LATER).cast("timestamp"))


@query(f"WITH {USERS_SQL} SELECT node, CASE WHEN NOT pinned AND coalesce(last_referenced, created_at) < TIMESTAMP '2024-02-01' - INTERVAL 4 DAY THEN 'archive' ELSE 'keep' END AS action FROM users")
def retention_sweep(spark, d):
    return lifecycle.retention(_users(spark, d), F.lit(views.NOW).cast("timestamp"), 4, "archive")


@query(f"WITH {views.SQL}, used AS (SELECT DISTINCT 'p' || l_partkey AS node FROM lineitem WHERE l_returnflag = 'R') SELECT edge_id, CASE WHEN source IN (SELECT node FROM used) OR target IN (SELECT node FROM used) THEN {R4('least(1.0::DOUBLE, weight + 0.05::DOUBLE)')} ELSE {R4('weight')} END AS weight FROM edges")
def mark_used_reinforce(spark, d):
    """Edges at returned parts are reinforced."""
    used = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("node"))
    return lifecycle.mark_used(views.edges(spark, d), used).select("edge_id", r4(F.col("weight")).alias("weight"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS seq FROM events GROUP BY 1")
def latest_version(spark, d):
    """The current state of every user's log."""
    return lifecycle.latest(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_type", "value", F.col("event_id").alias("seq"))


@query("SELECT event_type, count(*) AS n, count(valid_until) AS closed, CAST(sum(epoch(valid_until) - epoch(ts)) AS BIGINT) AS seconds FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_until FROM events) GROUP BY 1")
def supersede_windows(spark, d):
    """Each event holds until the user's next one."""
    v = lifecycle.validity(table(spark, d, "events"), "user_id", "ts", "event_id")
    return v.groupBy("event_type").agg(F.count("*").alias("n"), F.count("valid_until").alias("closed"), F.sum(F.unix_micros("valid_until") - F.unix_micros("valid_from")).alias("us")).select("event_type", "n", "closed", F.round(F.col("us") / 1e6).cast("long").alias("seconds"))


@query("SELECT event_type, count(*) AS users FROM (SELECT event_type FROM events WHERE ts <= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY 1")
def as_of_state(spark, d):
    """Every user's state as of a day."""
    v = lifecycle.validity(table(spark, d, "events"), "user_id", "ts", "event_id")
    return lifecycle.as_of(v, F.lit("2024-01-15").cast("timestamp")).groupBy("event_type").agg(F.count("*").alias("users"))


@query("SELECT CAST(doc_id AS VARCHAR) AS key, CASE doc_id % 4 WHEN 0 THEN 'append' WHEN 1 THEN 'adopt' WHEN 2 THEN 'noop' ELSE CASE WHEN text = lower(text) THEN 'noop' ELSE 'refresh' END END AS decision FROM documents")
def refresh_decision(spark, d):
    """Documents against a store that lacks some, knows some without hash, some alike and some in lower case."""
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.col("text").alias("content"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    k = F.col("doc_id") % 4
    stored = docs.where("doc_id % 4 <> 0").select("key", F.when(k == 2, sha(F.col("content"))).when(k == 3, sha(F.lower("content"))).alias("content_hash"))
    return lifecycle.refresh(stored, docs.select("key", "content"))


@query("SELECT count(*) AS nodes, count(*) FILTER (WHERE x % 2 = 1) AS added FROM (SELECT c_custkey AS x FROM customer)")
def import_merge(spark, d):
    """Customers imported over those with even keys that are there already."""
    every = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), (F.col("c_custkey") % 2 == 1).alias("odd"))
    none = views.edges(spark, d).where("false")
    merged, _ = lifecycle.import_graph(every.where("not odd"), none, every, none, "merge")
    return merged.agg(F.count("*").alias("nodes"), F.count_if("odd").alias("added"))


@query(f"WITH {views.DERIVED_SQL}, gone AS (SELECT 'o' || o_orderkey AS node FROM orders WHERE o_orderstatus = 'P') SELECT count(*) AS edges, count(*) FILTER (WHERE target IN (SELECT node FROM gone)) AS to_tombstones FROM derived WHERE source NOT IN (SELECT node FROM gone)")
def forget(spark, d):
    """Pending orders forgotten: what derives from them points at tombstones."""
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"), "o_orderstatus")
    _, kept = lifecycle.forget(o.select("node"), views.derived(spark, d), o.where("o_orderstatus = 'P'").select("node"))
    return kept.agg(F.count("*").alias("edges"), F.count_if(F.col("target").startswith("tombstone:")).alias("to_tombstones"))


@query(f"WITH {views.RICH_SQL}, e AS (SELECT source AS node FROM edges UNION SELECT target FROM edges) SELECT 0::BIGINT AS decayed, (SELECT count(*) FROM rich WHERE invalidated_at IS NULL AND node NOT IN (SELECT node FROM e)) AS orphans, (SELECT count(*) FROM rich WHERE invalidated_at IS NULL) AS live_nodes, (SELECT count(*) FROM edges) AS edges")
def consolidation(spark, d):
    """The report of a maintenance pass; extracted nodes do not decay."""
    n = views.rich(spark, d).withColumns({"source_type": F.lit("extracted"), "pinned": F.lit(False), "last_referenced": F.lit(None).cast("timestamp")})
    return lifecycle.consolidate(n, views.edges(spark, d), F.lit(views.NOW).cast("timestamp"))


@query("SELECT a.label AS a, b.label AS b, levenshtein(a.label, b.label) AS distance FROM (SELECT DISTINCT lower(p_name) AS label FROM part) a JOIN (SELECT DISTINCT lower(p_type) AS label FROM part) b ON levenshtein(a.label, b.label) < 5")
def fuzzy_lev(spark, d):
    """Part names against part types within four edits."""
    p = table(spark, d, "part")
    return resolve.fuzzy_pairs(p.select(F.lower("p_name").alias("label")), p.select(F.lower("p_type").alias("label")), 5).withColumn("distance", F.col("distance").cast("long"))


@query(f"WITH n AS (SELECT 'p' || p_partkey AS node, regexp_replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), '^(the|an|a) ', '') AS norm FROM part) SELECT node, min(node) OVER (PARTITION BY norm) AS canonical FROM n")
def alias_exact(spark, d):
    """Parts of one normalised name are one entity."""
    return resolve.dedup_exact(views.nodes(spark, d).where("node like 'p%'"))


@query()
def dedup_greedy(spark, d):
    """Entities of similar labels, replayed in order; the order decides, so no SQL."""
    return resolve.dedup_greedy(views.nodes(spark, d).where("node_type = 'topic'"))
