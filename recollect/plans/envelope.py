"""Queries over envelopes, gold units, attachment, merges, outcomes and fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions.text import r4
from recollect.operators import envelope, evaluate, govern, resolve
from recollect.plans.claims import GATE_SQL, SAID, _classified_sql, _pairs, _said
from recollect.plans.registry import query
from recollect.plans.texts import norm_sql
from recollect.session import table

R4 = lambda x: f"floor(({x}) * 10000 + 0.5) / 10000"


def _text(letter: str, c: str):
    return F.concat(F.lit(letter), F.col(c).cast("string"))


@query("""
WITH n AS (SELECT doc_id, unnest(['context', 'fact']) AS node_type FROM documents)
SELECT node_type || n.doc_id AS node, CASE WHEN d.doc_id IS NOT NULL AND d.doc_id % 7 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence, coalesce(d.doc_id % 7 = 0, false) AS curated,
  CASE WHEN d.doc_id IS NULL THEN NULL WHEN d.doc_id % 3 = 0 THEN 'mixed' ELSE 'text' END AS source_modality, d.doc_id % 6 = 0 AS vision_processed, CASE WHEN node_type = 'context' THEN d.doc_id % 3 <> 0 OR d.doc_id % 6 = 0 END AS answerable_by_text
FROM n LEFT JOIN (SELECT * FROM documents WHERE doc_id % 10 <> 9) d ON d.doc_id = n.doc_id
""")
def envelope_stamp(spark, d):
    """Two nodes of each document with what its input says; every tenth document's input is unknown."""
    docs, k = table(spark, d, "documents").select("doc_id"), F.col("doc_id")
    nodes = docs.select(F.explode(F.array(F.lit("context"), F.lit("fact"))).alias("node_type"), _text("d", "doc_id").alias("source_id"), F.lit(0.5).alias("confidence"), "doc_id").select(F.concat("node_type", F.col("doc_id").cast("string")).alias("node"), "node_type", "source_id", "confidence")
    inputs = docs.where(k % 10 != 9).select(_text("d", "doc_id").alias("source_id"), F.when(k % 3 == 0, "mixed").otherwise("text").alias("source_modality"), (k % 6 == 0).alias("vision_processed"), F.timestamp_seconds(k).alias("recorded_at"), ((k % 3 != 0) | (k % 6 == 0)).alias("answerable_by_text"), (k % 7 == 0).alias("curated"))
    return envelope.stamp(nodes, inputs).select("node", "confidence", "curated", "source_modality", "vision_processed", "answerable_by_text")


@query("SELECT doc_id, NOT (doc_id % 3 = 0) OR doc_id % 5 = 0 AS reconcilable FROM documents")
def reconcilable_claims(spark, d):
    """Claims that a distilled note may edit: every third is curated, every fifth came from an edit, and others say nothing."""
    k = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", envelope.reconcilable(F.when(k % 3 == 0, True), F.when(k % 5 == 0, "vault_reconcile").when(k % 2 == 0, "vault")).alias("reconcilable"))


@query("""
SELECT conv_id || ':D' || conv_id || ':' || turn AS source_id, conv_id AS conv, 'D' || conv_id || ':' || turn AS dia_id, (conv_id % 5)::INTEGER AS session, role || ': ' || text || CASE WHEN turn % 4 = 0 THEN ' [image: a picture]' ELSE '' END AS content,
  CASE WHEN turn % 2 = 0 THEN 'mixed' ELSE 'text' END AS source_modality, turn % 4 = 0 AS vision_processed, turn % 2 <> 0 OR turn % 4 = 0 AS answerable_by_text FROM conversations
""")
def benchmark_inputs(spark, d):
    """Turns as inputs, every second with an image, every fourth with a caption; and the tags of their contexts."""
    t = F.col("turn")
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("conv"), F.concat(F.lit("D"), F.col("conv_id"), F.lit(":"), "turn").alias("dia_id"), (F.col("conv_id") % 5).cast("int").alias("session"), F.col("role").alias("speaker"), "text", (t % 2 == 0).alias("has_image"), F.when(t % 4 == 0, "a picture").alias("caption"), F.timestamp_seconds("conv_id").alias("recorded_at"))
    inputs = envelope.turn_inputs(turns, captions=True)
    return envelope.tag(inputs.select("source_id", "content", "source_modality", "vision_processed", "answerable_by_text"), turns)


@query("SELECT doc_id, CASE WHEN contains(lower(answer), 'no information available') OR contains(lower(answer), 'not mentioned') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN coalesce(text, '') || ' It is Not Mentioned.' ELSE text END AS answer FROM documents)")
def adversarial_scores(spark, d):
    """Documents as answers to what cannot be answered: every seventh refuses, every fifth is silent."""
    k = F.col("doc_id")
    answer = F.when(k % 5 == 0, None).when(k % 7 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" It is Not Mentioned."))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", evaluate.adversarial(answer).alias("score"))


@query("""
WITH found AS (SELECT l_orderkey AS query, l_linenumber AS rank, CASE l_suppkey % 3 WHEN 0 THEN 'note:n' || l_suppkey % 10 WHEN 1 THEN 'conv:vaultconv:' || l_suppkey END AS gold FROM lineitem),
first AS (SELECT query, gold, min(rank) AS place FROM found WHERE gold IS NOT NULL GROUP BY 1, 2)
SELECT query, gold, row_number() OVER (PARTITION BY query ORDER BY place, gold) AS rank FROM first
""")
def gold_units(spark, d):
    """Gold units that each order's lines find, in order: suppliers are chunks of notes, turns about notes, or neither."""
    k = F.col("s_suppkey")
    source = F.when(k % 3 == 0, F.concat(F.lit("vault:n"), k % 10, F.lit("#h"), k)).when(k % 3 == 1, F.concat(F.lit("vaultconv:"), k)).otherwise(F.concat(F.lit("mail:"), k))
    nodes = table(spark, d, "supplier").select(_text("s", "s_suppkey").alias("node"), source.alias("source_id"))
    results = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), _text("s", "l_suppkey").alias("node"), F.col("l_linenumber").alias("rank"))
    return evaluate.gold_found(results, nodes).withColumn("rank", F.col("rank").cast("long"))


@query(f"""
WITH edges AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_linenumber = 1), asked AS (SELECT o_orderkey AS t, o_orderstatus AS expected, o_custkey % (SELECT count(*) FROM supplier) + 1 AS s FROM orders),
hit AS (SELECT DISTINCT l_orderkey AS t FROM lineitem JOIN asked ON t = l_orderkey JOIN edges ON p = l_partkey AND edges.s = asked.s)
SELECT expected, count(*) AS turns, {R4('avg(CASE WHEN hit.t IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END)')} AS rate FROM asked LEFT JOIN hit USING (t) GROUP BY 1
""")
def attachment_rates(spark, d):
    """How often an order's parts are connected to the supplier that its customer is matched with, by status."""
    li, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    edges = li.where("l_linenumber = 1").select(_text("p", "l_partkey").alias("source"), _text("s", "l_suppkey").alias("target"))
    many = table(spark, d, "supplier").agg(F.count("*").alias("many"))
    asked = orders.join(F.broadcast(many)).select(F.col("o_orderkey").alias("turn"), F.concat(F.lit("s"), (F.col("o_custkey") % F.col("many") + 1).cast("string")).alias("entity"), F.col("o_orderstatus").alias("expected"))
    found = evaluate.attached(li.select(F.col("l_orderkey").alias("turn"), _text("p", "l_partkey").alias("node")), asked, edges)
    return asked.join(found, "turn").groupBy("expected").agg(F.count("*").alias("turns"), r4(F.avg(F.col("attached").cast("double"))).alias("rate"))


LABELS = "SELECT 'p' || p_partkey AS node, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'The ' || p_name WHEN 2 THEN replace(p_name, ' ', '-') ELSE p_name END AS label FROM part"


@query(f"""
WITH n AS ({LABELS}), m AS (SELECT *, regexp_replace({norm_sql('label')}, '^(the|an|a) ', '') AS norm FROM n), c AS (SELECT node, label, min(node) OVER (PARTITION BY norm) AS canonical FROM m)
SELECT c.label AS candidate, n.label AS existing, count(*) AS nodes FROM c JOIN n ON n.node = canonical WHERE c.node <> canonical AND lower(c.label) <> lower(n.label) GROUP BY 1, 2
""")
def merge_report(spark, d):
    """Parts' names with articles, hyphens and capitals: what only normalisation merges."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    label = F.when(k == 0, F.upper(name)).when(k == 1, F.concat(F.lit("The "), name)).when(k == 2, F.replace(name, F.lit(" "), F.lit("-"))).otherwise(name)
    nodes = table(spark, d, "part").select(_text("p", "p_partkey").alias("node"), F.lit("topic").alias("node_type"), label.alias("label"))
    return evaluate.merges(nodes, resolve.dedup_exact(nodes))


@query(f"""
WITH {GATE_SQL}, told AS (SELECT coalesce(c.dimension, 'none') AS dimension, CASE WHEN g.id % 2 = 0 THEN 'even' ELSE 'odd' END AS style, CASE WHEN x[1] = 'auto_supersede' THEN 'updated' WHEN x[1] IN ('candidate', 'version_locked') THEN 'queued' ELSE 'stale' END AS outcome
  FROM g JOIN said USING (id) JOIN f5 c ON c.o = said.old_text AND c.n = said.new_text)
SELECT dimension, style, outcome, count(*) AS n FROM told GROUP BY CUBE (dimension, style), outcome
""")
def fact_update_outcomes(spark, d):
    """What becomes of every customer's later claim, by the topic that changed and by half."""
    decided = govern.gate(_pairs(spark, d), trace=True).select("action", F.col("trace.dimension").alias("dimension"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("style"))
    return evaluate.fact_outcomes(decided, "dimension", "style")


@query(f"""
WITH {SAID}, {_classified_sql('c', 'old_text')}, rows AS (SELECT CASE id % 3 WHEN 0 THEN 'preference' WHEN 1 THEN claim_type ELSE NULL END AS expected, claim_type AS predicted, status, CASE WHEN compound THEN 'compound' ELSE 'plain' END AS bucket FROM said JOIN c ON text = old_text)
SELECT bucket, count(*) AS n, count(*) FILTER (WHERE status = 'classified') AS committed, count(*) FILTER (WHERE status = 'classified' AND predicted IS NOT DISTINCT FROM expected) AS correct,
  count(*) FILTER (WHERE status = 'classified' AND predicted IS DISTINCT FROM expected) AS confident_wrong, {R4("count(*) FILTER (WHERE status = 'classified')::DOUBLE / count(*)")} AS coverage FROM rows WHERE expected IS NOT NULL GROUP BY 1
""")
def fixture_scores(spark, d):
    """First claims as fixtures: a third is labelled as they are read, a third as preferences, a third not at all."""
    k = F.col("id") % 3
    rows = govern.classify(_said(spark, d), "old_text").select(F.when(k == 0, "preference").when(k == 1, F.col("claim_type")).alias("expected"), F.col("claim_type").alias("predicted"), "status", F.when(F.col("compound"), "compound").otherwise("plain").alias("bucket"))
    return evaluate.fixture_scores(rows, "bucket")


EXTRA = {"licensing": [r"licen[cs]e", r"copyright"], "faith_religion": [r"shrine"]}


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '\\b(?:licen[cs]e|copyright)') OR regexp_matches(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\b(?:licen[cs]e|copyright)') THEN 'licensing' END AS domain FROM (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'Under c-o-p-y-r-i-g-h-t' WHEN 1 THEN 'All Copyrights' WHEN 2 THEN 'no LICENSE here' ELSE source END AS text FROM documents)")
def tripwire_union(spark, d):
    """Sources of documents, and three lines, held against the sensitive domains and one more."""
    k = F.col("doc_id") % 9
    text = F.when(k == 0, "Under c-o-p-y-r-i-g-h-t").when(k == 1, "All Copyrights").when(k == 2, "no LICENSE here").otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", govern.tripwire(text, EXTRA).alias("domain"))


@query("SELECT event_id, user_id, event_type, coalesce(value, 0.0::DOUBLE) * 0 + value AS value, 'event' AS kind, NULL::VARCHAR AS note FROM events")
def migrated_rows(spark, d):
    """Events of an older shape in a schema with two more columns, one of them with a default."""
    old = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    return envelope.migrate(old, "event_id long, user_id long, event_type string, value double, kind string, note string", {"kind": "event"})
