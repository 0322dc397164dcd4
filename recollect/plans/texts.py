"""Queries over texts: scans, labels, extraction, event time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions import temporal, text
from recollect.operators import extract, substrings
from recollect.plans.registry import query
from recollect.session import materialize, table
from recollect.sources import files

LIST = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in extract.TECH_TERMS) + "]"
STOPS = "(" + ", ".join(f"'{t}'" for t in extract.STOP_WORDS) + ")"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[-_./\\\\]+', ' ', 'g'), '''s\\b', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size >= 10 AND p_brand = 'Brand#12' ORDER BY p_retailprice DESC, p_partkey LIMIT 50 OFFSET 5")
def scan_nodes_filtered(spark, d):
    """A page of the dearest parts of a brand."""
    p = table(spark, d, "part").where("p_size >= 10 and p_brand = 'Brand#12'")
    return p.orderBy(F.desc("p_retailprice"), "p_partkey").offset(5).limit(50).select("p_partkey", "p_name", "p_retailprice")


KEYWORDS = ["license", "token", "with", "docker", "example.com"]


@query(f"""
SELECT keyword, doc_id, rank FROM (
  SELECT k.keyword, doc_id, row_number() OVER (PARTITION BY k.keyword ORDER BY doc_id DESC) AS rank
  FROM documents JOIN (VALUES {', '.join(f"('{k}')" for k in KEYWORDS)}) k(keyword) ON contains(lower(text), k.keyword)) WHERE rank <= 10
""")
def keyword_search(spark, d):
    """The ten newest documents that contain each keyword."""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("node"), F.lower("text").alias("text"), F.col("doc_id").alias("at"))
    hits = substrings.newest(texts, spark.createDataFrame([(k,) for k in KEYWORDS], "word string"), 10).select(F.col("node").alias("doc_id"), F.col("word").alias("keyword"))
    rank = F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("doc_id")))
    return hits.withColumn("rank", rank.cast("long")).where("rank <= 10").select("keyword", "doc_id", "rank")


@query("SELECT CAST(json_extract_string(props, '$.k') AS VARCHAR) AS ingest_key, min(event_id) AS oldest, count(*) AS contexts FROM events GROUP BY 1")
def ingest_key_lookup(spark, d):
    """The oldest event of each key in the properties."""
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("ingest_key")).agg(F.min("event_id").alias("oldest"), F.count("*").alias("contexts"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY 1")
def adoptable_context(spark, d):
    """The newest turn of each conversation."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


@query(f"SELECT p_partkey, {norm_sql('p_name')} AS norm, regexp_replace({norm_sql('p_type')}, '^(the|an|a) ', '') AS type_norm FROM part")
def norm_label(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normalize_text("p_name").alias("norm"), text.normalize_label("p_type").alias("type_norm"))


@query("""
SELECT conv_id, turn, coalesce(substr(regexp_replace(line, '^(User|Assistant|Human|AI):\\s*', ''), 1, 200), 'Unnamed context') AS label FROM (
  SELECT conv_id, turn, (SELECT l FROM (SELECT trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS l, i FROM (SELECT unnest(string_split(c.text, chr(10))) AS x, generate_subscripts(string_split(c.text, chr(10)), 1) AS i)) WHERE l <> '' ORDER BY i LIMIT 1) AS line FROM conversations c)
""")
def context_labels(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.context_label("text").alias("label"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment <> '' AND c_mktsegment <> c_name THEN c_name || '. ' || c_mktsegment ELSE c_name END AS embed_text FROM customer")
def embedding_texts(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.embedding_text("c_name", "c_mktsegment").alias("embed_text"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type || ' / ' || p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, length(p_name) AS n FROM part")
def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" / ", "p_type", "p_name")).alias("slug"), F.length("p_name").cast("long").alias("n"))


@query("""
SELECT doc_id, CASE WHEN length(l) <= 200 THEN l ELSE (CASE WHEN length(regexp_extract(substr(l, 1, 197), '(?s)^(.*) ', 1)) > 100 THEN regexp_extract(substr(l, 1, 197), '(?s)^(.*) ', 1) ELSE substr(l, 1, 197) END) || '...' END AS label FROM (SELECT doc_id, text AS l FROM documents)
""")
def truncated_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate_label("text").alias("label"))


@query("""
WITH a AS (SELECT event_id, CAST(epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)) AS BIGINT) AS s FROM events),
u AS (SELECT event_id, s, CASE WHEN s < 3600 THEN 60 WHEN s < 86400 THEN 3600 WHEN s < 604800 THEN 86400 WHEN s < 2592000 THEN 604800 WHEN s < 31536000 THEN 2592000 ELSE 31536000 END AS size,
  CASE WHEN s < 3600 THEN 'minute' WHEN s < 86400 THEN 'hour' WHEN s < 604800 THEN 'day' WHEN s < 2592000 THEN 'week' WHEN s < 31536000 THEN 'month' ELSE 'year' END AS word FROM a)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' ELSE CAST(s // size AS VARCHAR) || ' ' || word || CASE WHEN s // size = 1 THEN '' ELSE 's' END || ' ago' END AS age FROM u
""")
def relative_ages(spark, d):
    return table(spark, d, "events").select("event_id", text.relative_age(F.col("ts"), F.lit("2024-02-01").cast("timestamp")).alias("age"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(replace(t, ',', '')), '[!-/:-@\\[-`{-~]', '', 'g'), '\\b(a|an|the|and)\\b', ' ', 'g'), '[ \\n\\t]+', ' ', 'g')) AS answer FROM (SELECT p_partkey, 'The ' || p_name || ', and a ' || p_brand || ' (' || p_type || ')!' AS t FROM part)")
def normalized_answers(spark, d):
    t = F.concat(F.lit("The "), "p_name", F.lit(", and a "), "p_brand", F.lit(" ("), "p_type", F.lit(")!"))
    return table(spark, d, "part").select("p_partkey", text.normalize_answer(t).alias("answer"))


@query(f"SELECT conv_id, turn, term, substr(text, strpos(lower(text), term), length(term)) AS label FROM conversations, (SELECT unnest({LIST}) AS term) WHERE contains(lower(text), term)")
def tech_entities(spark, d):
    """Known terms in every turn, in its own spelling."""
    turns = table(spark, d, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    return extract.tech_entities(turns, "id", "text").select("id.conv_id", "id.turn", "term", "label")


@query("""
WITH e AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS contexts FROM e x JOIN e y ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand GROUP BY 1, 2
""")
def entity_cooccurrence(spark, d):
    """How many orders name both of two brands; an order has seven lines at most."""
    brands = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "p_brand")
    return extract.cooccurrence(brands, "l_orderkey", "p_brand")


STATEMENTS = {
    "decision": "'After a long talk we decided to use ' || p_name || ' for the line. Confirmed: ' || p_type || ' stays in stock.'",
    "fact": "'The database runs on ' || p_name || '. We host it at 10.0.' || p_size || '.7:' || (8000 + p_size) || ' for $' || CAST(p_size * 10 AS INT) || '/month.'",
    "preference": "'I prefer ' || p_name || '. We never use ' || p_type || ' parts.'",
}


def _statements(spark, d, kind):
    return table(spark, d, "part").selectExpr("p_partkey", f"{STATEMENTS[kind]} AS text")


def _found_sql(kind: str, patterns: list[str], least: int) -> str:
    found = " UNION ALL ".join(f"SELECT p_partkey, unnest(regexp_extract_all(text, '(?im){p.replace(chr(39), chr(39) * 2)}', 1)) AS x FROM s" for p in patterns)
    return f"WITH s AS (SELECT p_partkey, {STATEMENTS[kind]} AS text FROM part), m AS ({found}) SELECT DISTINCT p_partkey, substr(trim(x), 1, 200) AS label FROM m WHERE length(substr(trim(x), 1, 200)) > {least}"


@query(_found_sql("decision", extract.DECISIONS, 10))
def decision_extract(spark, d):
    return extract.decisions(_statements(spark, d, "decision"), "p_partkey", "text")


@query(_found_sql("fact", extract.FACTS[:2] + extract.FACTS[3:], 5))
def fact_extract(spark, d):
    return extract.facts(_statements(spark, d, "fact"), "p_partkey", "text")


@query(_found_sql("preference", extract.PREFERENCES, 5))
def preference_extract(spark, d):
    return extract.preferences(_statements(spark, d, "preference"), "p_partkey", "text")


@query(f"""
WITH s AS (SELECT p_partkey, {STATEMENTS['decision']} AS text, p_type FROM part),
m AS ({' UNION ALL '.join(f"SELECT p_partkey, unnest(regexp_extract_all(text, '(?im){p.replace(chr(39), chr(39) * 2)}', 1)) AS x FROM s" for p in extract.DECISIONS)})
SELECT DISTINCT m.p_partkey, substr(trim(x), 1, 200) AS decision, p_type AS entity, 0.7::DOUBLE AS weight FROM m JOIN s USING (p_partkey) WHERE length(trim(x)) > 10 AND contains(lower(substr(trim(x), 1, 200)), lower(p_type))
""")
def decision_entity_edges(spark, d):
    named = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("label"))
    return extract.decision_edges(extract.decisions(_statements(spark, d, "decision"), "p_partkey", "text"), named, "p_partkey")


@query("SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}(?::[0-9]+)?)', 1)) AS address FROM documents")
def ipv4_facts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(extract.FACTS[4]), F.lit(1))).alias("address"))


@query(f"""
WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(regexp_replace(regexp_replace(lower(text), '[^\\x00-\\x7F\\p{{L}}\\p{{N}}\\p{{M}}]', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g'), '\\b([a-z][a-z''-]+)\\b', 1)) AS word FROM conversations)
SELECT conv_id, turn, word AS topic, count(*) AS frequency FROM w WHERE length(word) > 3 AND word NOT IN {STOPS} GROUP BY 1, 2, 3 HAVING count(*) >= 3
""")
def topic_words(spark, d):
    """Words that a turn says three times and more."""
    words = table(spark, d, "conversations").select("conv_id", "turn", F.explode(text.topic_words("text")).alias("topic"))
    return words.where((F.length("topic") > 3) & ~F.col("topic").isin(extract.STOP_WORDS)).groupBy("conv_id", "turn", "topic").agg(F.count("*").alias("frequency")).where("frequency >= 3")


@query(f"""
WITH w AS (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(lower(text), '[^\\x00-\\x7F\\p{{L}}\\p{{N}}\\p{{M}}]', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g'), '\\b([a-z][a-z''-]+)\\b', 1) AS words FROM documents),
p AS (SELECT doc_id, unnest(words[:-2]) AS a, unnest(words[2:]) AS b FROM w)
SELECT doc_id, a || ' ' || b AS topic, count(*) AS frequency FROM p WHERE length(a) > 2 AND length(b) > 2 AND a NOT IN {STOPS} AND b NOT IN {STOPS} GROUP BY 1, 2 HAVING count(*) >= 2
""")
def topic_pairs(spark, d):
    """Word pairs that a document says twice and more."""
    words = table(spark, d, "documents").select("doc_id", text.topic_words("text").alias("w"))
    pairs = words.select("doc_id", F.inline(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))))
    good = lambda c: (F.length(c) > 2) & ~F.col(c).isin(extract.STOP_WORDS)
    return pairs.where(F.col("b").isNotNull() & good("a") & good("b")).groupBy("doc_id", F.concat_ws(" ", "a", "b").alias("topic")).agg(F.count("*").alias("frequency")).where("frequency >= 2")


@query()
def topics_ranked(spark, d):
    """The ten topics at most of every turn, longer ones first."""
    turns = table(spark, d, "conversations").withColumn("id", F.struct("conv_id", "turn"))
    return extract.topics(turns, "id", "text").select("id.conv_id", "id.turn", "topic", "frequency", "rank")


DATES = {
    "absolute": "CASE o_orderkey % 4 WHEN 0 THEN 'shipped on ' || extract(day FROM o_orderdate) || ' ' || {m} || ' ' || extract(year FROM o_orderdate) WHEN 1 THEN 'due ' || {m} || ' ' || extract(day FROM o_orderdate) || ', ' || extract(year FROM o_orderdate) WHEN 2 THEN 'sometime in ' || {m} || ' ' || extract(year FROM o_orderdate) ELSE 'the ' || extract(year FROM o_orderdate) || ' season' END",
    "relative": "CASE o_orderkey % 9 WHEN 0 THEN 'it came yesterday' WHEN 1 THEN 'we pay today' WHEN 2 THEN 'placed ' || (1 + o_orderkey % 20) || ' days ago' WHEN 3 THEN 'asked two weeks ago' WHEN 4 THEN 'sent a month ago' WHEN 5 THEN 'bought last year' WHEN 6 THEN 'comes next week' WHEN 7 THEN 'all of this month' ELSE 'signed last friday' END",
}
MONTH_SQL = "(CASE extract(month FROM o_orderdate) " + " ".join(f"WHEN {i + 1} THEN '{m.title()}'" for i, m in enumerate(temporal.MONTHS)) + " END)"


def _dated(spark, d, kind):
    return table(spark, d, "orders").selectExpr("o_orderkey", "o_orderdate", DATES[kind].format(m=MONTH_SQL) + " AS text")


def _resolved(df):
    e = temporal.event_time("text", "o_orderdate")
    f = lambda c: F.date_format(F.col(f"e.{c}"), "yyyy-MM-dd HH:mm:ss").alias(c)
    return df.withColumn("e", e).select("o_orderkey", f("start"), f("end"), F.col("e.granularity").alias("granularity"), F.col("e.confidence").alias("confidence"))


@query("""
WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'day' WHEN 1 THEN 'day' WHEN 2 THEN 'month' ELSE 'year' END AS granularity, o_orderdate AS t FROM orders),
s AS (SELECT *, date_trunc(granularity, t) AS a FROM r)
SELECT o_orderkey, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, strftime(a + CASE granularity WHEN 'day' THEN INTERVAL 1 DAY WHEN 'month' THEN INTERVAL 1 MONTH ELSE INTERVAL 1 YEAR END - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS "end",
  granularity, CASE granularity WHEN 'day' THEN 0.95::DOUBLE WHEN 'month' THEN 0.9::DOUBLE ELSE 0.85::DOUBLE END AS confidence FROM s
""")
def temporal_absolute(spark, d):
    """Dates written in four ways, of all orders."""
    return _resolved(_dated(spark, d, "absolute"))


@query("""
WITH r AS (SELECT o_orderkey, o_orderkey % 9 AS k, date_trunc('day', o_orderdate) AS t FROM orders),
s AS (SELECT o_orderkey, k, CASE k WHEN 0 THEN t - INTERVAL 1 DAY WHEN 1 THEN t WHEN 2 THEN t - to_days(CAST(1 + o_orderkey % 20 AS INTEGER)) WHEN 3 THEN date_trunc('week', t - INTERVAL 14 DAY) WHEN 4 THEN date_trunc('month', t) - INTERVAL 1 MONTH
  WHEN 5 THEN date_trunc('year', t) - INTERVAL 1 YEAR WHEN 6 THEN date_trunc('week', t) + INTERVAL 7 DAY WHEN 7 THEN date_trunc('month', t)
  ELSE t - to_days(CAST(CASE WHEN isodow(t) = 5 THEN 7 ELSE (isodow(t) + 2) % 7 END AS INTEGER)) END AS a FROM r),
g AS (SELECT *, CASE WHEN k IN (3, 6) THEN 'week' WHEN k IN (4, 7) THEN 'month' WHEN k = 5 THEN 'year' ELSE 'day' END AS granularity FROM s)
SELECT o_orderkey, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, strftime(a + CASE granularity WHEN 'day' THEN INTERVAL 1 DAY WHEN 'week' THEN INTERVAL 7 DAY WHEN 'month' THEN INTERVAL 1 MONTH ELSE INTERVAL 1 YEAR END - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S') AS "end", granularity,
  CASE k WHEN 0 THEN 0.95::DOUBLE WHEN 1 THEN 0.95::DOUBLE WHEN 2 THEN 0.9::DOUBLE WHEN 3 THEN 0.8::DOUBLE WHEN 4 THEN 0.75::DOUBLE WHEN 5 THEN 0.65::DOUBLE WHEN 6 THEN 0.55::DOUBLE WHEN 7 THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM g
""")
def temporal_relative(spark, d):
    """Expressions relative to the order's date, of all orders."""
    return _resolved(_dated(spark, d, "relative"))


@query("""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS conversation, CASE WHEN p IS NULL THEN 'context:' || conv_id ELSE 'm' || p END AS source, 'm' || turn AS target, CASE WHEN p IS NULL THEN 'mentioned_by' ELSE 'followed_by' END AS edge_type, CASE WHEN p IS NULL THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS weight
FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM t)
""")
def chat_tree_edges(spark, d):
    """Conversations as exported message trees in JSON, and their edges."""
    turns = table(spark, d, "conversations").withColumn("p", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    message = F.struct(F.struct(F.struct("role").alias("author"), F.struct(F.array("text").alias("parts")).alias("content")).alias("message"), F.concat(F.lit("m"), F.col("p").cast("string")).alias("parent"))
    exports = turns.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")), message)))).alias("mapping"))
    return files.chat_edges(materialize(files.chat_messages(exports, "id", "mapping"), "messages"))


@query("""
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS content, count(*) AS turns FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1
""")
def session_transcript(spark, d):
    """Turns as JSON lines of a session log, and their transcript."""
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", F.col("text").alias("content"))).alias("line"))
    return files.transcript(lines, "conv_id", "line", "turn")


@query(f"""
WITH t AS (SELECT conv_id, turn, ' ' || {norm_sql('text')} || ' ' AS t FROM conversations), g AS (SELECT DISTINCT {norm_sql('word')} AS key FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark))
SELECT conv_id, turn, count(*) AS mentions FROM t JOIN g ON length(key) >= 4 AND contains(t, ' ' || key || ' ') GROUP BY 1, 2
""")
def mention_link(spark, d):
    """How many terms of a gazetteer (the words of the benchmark items) each turn names."""
    turns = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), text.normalize_text("text").alias("norm"))
    names = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).select(text.normalize_text("word").alias("key")).distinct().withColumn("label", F.col("key"))
    return extract.mentions(turns, names, "id", "norm", "label", "key").groupBy("id").agg(F.count("*").alias("mentions")).select("id.conv_id", "id.turn", "mentions")
