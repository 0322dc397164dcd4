"""Queries over REST replies, benchmark files, stored communities, vectors, triggers and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.operators import upkeep
from recollect.plans.memory import HOME
from recollect.plans.registry import ORACLES, QUERIES, query
from recollect.session import table
from recollect.sources import payloads


def _json_text(c: str):
    """A text as JSON: the only element of an array, without its brackets."""
    whole = F.to_json(F.array(c))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


@query("""
WITH t AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS i FROM conversations)
SELECT conv_id, i, text AS content, CASE role WHEN 'user' THEN 'conversation' ELSE role END AS content_type FROM t WHERE text <> ''
""")
def api_items(spark, d):
    """Conversations as replies of five shapes (user turns as texts, others as objects), and their items."""
    item = F.when(F.col("role") == "user", _json_text("text")).otherwise(F.to_json(F.struct("text", F.col("role").alias("content_type"))))
    turns = table(spark, d, "conversations").select("conv_id", F.struct("turn", "role", "text", item.alias("item")).alias("t"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).getField("item").alias("items"))
    body = F.concat(F.lit("["), F.array_join("items", ","), F.lit("]"))
    name = F.element_at(F.array(*map(F.lit, payloads.LISTS)), (F.col("conv_id") % 5).cast("int"))
    shaped = F.when(F.col("conv_id") % 5 == 0, body).otherwise(F.concat(F.lit('{"'), name, F.lit('": '), body, F.lit("}")))
    return payloads.items(listed.select("conv_id", shaped.alias("body")), "conv_id", "body").select("conv_id", "i", "content", "content_type")


@query("""
SELECT conv_id, CAST(turn // 2 + 1 AS INTEGER) AS session, CAST(turn AS INTEGER) AS m, role AS speaker, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, 'day ' || (turn // 2 + 1) AS session_date
FROM conversations WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''
""")
def benchmark_turns(spark, d):
    """Conversations as files of sessions of two turns, and the turns read back."""
    session = (F.floor(F.col("turn") / 2) + 1).cast("string")
    turn = F.struct(F.concat(F.lit("D"), session, F.lit(":"), F.col("turn").cast("string")).alias("dia_id"), F.col("role").alias("speaker"), "text")
    turns = table(spark, d, "conversations").select("conv_id", session.alias("s"), turn.alias("t"))
    sessions = turns.groupBy("conv_id", "s").agg(F.to_json(F.collect_list("t")).alias("turns"))
    entry = F.concat(F.lit('"session_'), "s", F.lit('": '), "turns", F.lit(', "session_'), "s", F.lit('_date_time": "day '), "s", F.lit('"'))
    files = sessions.select("conv_id", entry.alias("e")).groupBy("conv_id").agg(F.concat(F.lit("{"), F.array_join(F.collect_list("e"), ", "), F.lit("}")).alias("body"))
    return payloads.session_turns(files, "conv_id", "body").select("conv_id", "session", F.col("place.m").alias("m"), "speaker", "text", "session_date")


def _home(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    at = F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("community")
    people = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), at)
    return n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), at).unionByName(people)


@query(f"WITH {HOME} SELECT DISTINCT o_clerk.query AS query, community FROM (SELECT 'o' || o_orderpriority AS query, 'c' || o_custkey AS node FROM orders) o_clerk JOIN home USING (node)")
def community_anchors(spark, d):
    """The communities of every order priority's customers."""
    anchors = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderpriority").alias("query"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node"))
    return upkeep.communities_of(_home(spark, d), anchors)


@query(f"WITH {HOME} SELECT community, count(*) AS size, min(node) AS first FROM home GROUP BY 1")
def community_list(spark, d):
    """Stored communities with their sizes."""
    return upkeep.community_sizes(_home(spark, d))


@query("""
WITH changed AS (SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE text END AS text FROM documents JOIN labels USING (doc_id))
SELECT vec_id AS node, len(embedding) AS size, CAST(embedding[1] AS DOUBLE) AS head FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM changed)
UNION ALL SELECT doc_id, 2, CAST(length(text) AS DOUBLE) FROM changed WHERE text IS NOT NULL
""")
def reindex_vectors(spark, d):
    """Vectors after the labelled documents changed and the toxic ones were deleted; the plug-in counts characters."""
    labelled = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    changed = labelled.select(F.col("doc_id").alias("node"), F.when(F.coalesce("toxic", F.lit(0)) != 1, F.col("text")).alias("text"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector"))
    found = upkeep.reindex(vectors, changed, lambda text: F.array(F.length(text).cast("float"), F.lit(1.0).cast("float")))
    return found.select("node", F.size("vector").cast("long").alias("size"), F.element_at("vector", 1).cast("double").alias("head"))


@query("SELECT doc_id AS node FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) ORDER BY 1 LIMIT 256")
def pending_vectors(spark, d):
    """The next batch of documents to embed, were those with labels embedded already."""
    return upkeep.pending(table(spark, d, "documents").select(F.col("doc_id").alias("node")), table(spark, d, "labels").select(F.col("doc_id").alias("node")))


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT user_id, event_id, 'recluster' AS task FROM n WHERE n % 50 = 0 UNION ALL SELECT user_id, event_id, 'train' FROM n WHERE n >= 100 AND (n - 100) % 500 = 0
""")
def triggers(spark, d):
    """Events at which a user's memory is clustered again (every 50) or its scorer trained (100, then every 500)."""
    e, order = table(spark, d, "events"), ["ts", "event_id"]
    row = lambda df, task: df.select("user_id", "event_id", F.lit(task).alias("task"))
    return row(upkeep.due(e, "user_id", order), "recluster").unionByName(row(upkeep.due(e, "user_id", order, 500, 100), "train"))


@query(f"""
SELECT query, to_json({{'query': query, 'results': list({{'node': node, 'hops': hops, 'score': score}} ORDER BY rank)}}) AS payload FROM ({ORACLES["recall_boosted"]}) GROUP BY query
""")
def recall_payloads(spark, d):
    """Each nation's recall as one JSON text."""
    return upkeep.payload(QUERIES["recall_boosted"](spark, d), "node", "hops", "score")
