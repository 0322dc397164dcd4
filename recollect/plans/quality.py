"""Queries that evaluate, render and stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions.similarity import ratio
from recollect.functions.text import r4
from recollect.operators import answers, evaluate, render
from recollect.plans.graphs import KNN_SQL, R4, _knn
from recollect.plans.registry import query
from recollect.session import materialize, table
from recollect.sources import files
from recollect.streaming import ingest


@query(f"""
WITH {KNN_SQL}, gold AS (SELECT q.vec_id AS query, e.vec_id AS item FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND e.label = q.label AND e.vec_id <> q.vec_id),
n AS (SELECT q.vec_id AS query, count(item) AS n_gold FROM embeddings q LEFT JOIN gold ON gold.query = q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1),
h AS (SELECT query, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1.0::DOUBLE)) AS dcg FROM top JOIN gold USING (query, item) WHERE rank <= 10 GROUP BY 1)
SELECT query, n_gold, CASE WHEN n_gold = 0 THEN 1.0::DOUBLE ELSE {R4('coalesce(hits, 0)::DOUBLE / n_gold')} END AS recall, CASE WHEN n_gold = 0 THEN 1.0::DOUBLE ELSE {R4('coalesce(1.0::DOUBLE / first, 0.0::DOUBLE)')} END AS reciprocal_rank,
  CASE WHEN n_gold = 0 THEN 1.0::DOUBLE ELSE {R4('coalesce(dcg / (SELECT sum(1 / log2(i + 1.0::DOUBLE)) FROM range(1, least(10, n_gold) + 1) t(i)), 0.0::DOUBLE)')} END AS ndcg FROM n LEFT JOIN h USING (query)
""")
def retrieval_quality(spark, d):
    """Recall, reciprocal rank and nDCG at ten of nearest vectors; gold are the vectors of the same label."""
    v = table(spark, d, "embeddings").select("vec_id", "label")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), "label")
    return evaluate.per_query_labelled(_knn(spark, d), v.withColumnRenamed("vec_id", "item"), q)


@query("SELECT event_type, count(*) AS n, floor(quantile_cont(value, 0.5) * 1000 + 0.5) / 1000 AS p50, floor(quantile_cont(value, 0.9) * 1000 + 0.5) / 1000 AS p90, floor(quantile_cont(value, 0.99) * 1000 + 0.5) / 1000 AS p99, floor(min(value) * 1000 + 0.5) / 1000 AS min, floor(max(value) * 1000 + 0.5) / 1000 AS max, floor(avg(value) * 1000 + 0.5) / 1000 AS mean FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return evaluate.latency(table(spark, d, "events"), F.col("value"), "event_type")


@query("""
SELECT cause, count(*) AS n, CAST(sum(o_totalprice > 100000) AS BIGINT) AS dear FROM (SELECT o_totalprice, CASE WHEN o_orderkey % 2 = 1 THEN 'never_extracted' WHEN o_orderstatus = 'F' THEN 'outranked' WHEN o_orderstatus = 'P' THEN 'filtered_out'
  WHEN o_orderpriority = '1-URGENT' THEN 'no_anchors' WHEN o_custkey % 3 = 0 THEN 'walk_depth_miss' ELSE 'disconnected' END AS cause FROM orders) GROUP BY 1
""")
def miss_taxonomy(spark, d):
    """Causes of missed items, with flags taken from orders."""
    o = table(spark, d, "orders").select("o_totalprice", (F.col("o_orderkey") % 2 == 0).alias("extracted"), (F.col("o_orderstatus") == "F").alias("ranked"), (F.col("o_orderstatus") == "P").alias("filtered"), (F.col("o_orderpriority") != "1-URGENT").alias("anchored"), (F.col("o_custkey") % 3 == 0).alias("near"))
    return o.groupBy(evaluate.miss_cause(o).alias("cause")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("dear"))


@query()
def token_f1(spark, d):
    """Stemmed token overlap of part names and types; stems are no SQL function."""
    return evaluate.token_f1(table(spark, d, "part").select("p_partkey", "p_name", "p_type"), "p_name", "p_type")


@query()
def fuzzy_ratio(spark, d):
    """Matching characters of each part's name and type."""
    p = table(spark, d, "part")
    return p.select("p_partkey", r4(ratio(F.lower("p_name"), F.lower("p_type"))).alias("ratio"))


@query(f"""
SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY tail, CASE WHEN tail = 0 THEN -again ELSE 0 END, rank) AS rank FROM (
  SELECT query, item, top.rank, CASE WHEN top.rank <= 20 THEN 0 ELSE 1 END AS tail, {R4('similarity * (1 + item % 10 / 10.0::DOUBLE)')} AS again FROM (WITH {KNN_SQL} SELECT * FROM top) top)
""")
def rerank_head(spark, d):
    """The first twenty of each ranking ordered anew by another score; the rest keeps its order."""
    near = _knn(spark, d).withColumn("tail", (F.col("rank") > 20).cast("int")).withColumn("again", r4(F.col("similarity") * (1 + F.col("item") % 10 / 10.0)))
    order = Window.partitionBy("query").orderBy("tail", F.when(F.col("tail") == 0, -F.col("again")).otherwise(0.0), "rank")
    return near.select("query", "item", F.row_number().over(order).cast("long").alias("rank"))


@query("""
WITH c AS (SELECT n_nationkey AS entity, c_mktsegment AS kind, c_name AS label, DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER) AS t, 'c' || c_custkey AS node FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT entity, kind, '## ' || kind || chr(10) || string_agg('- ' || label || ' (' || strftime(t, '%Y-%m-%d') || ') ^' || node, chr(10) ORDER BY t, lower(label), node) AS section, count(*) AS n FROM c GROUP BY 1, 2)
SELECT entity, '# ' || n_name || chr(10) || chr(10) || string_agg(section, chr(10) || chr(10) ORDER BY kind) AS note, CAST(sum(n) AS BIGINT) AS claims FROM s JOIN nation ON n_nationkey = entity GROUP BY entity, n_name
""")
def distill_notes(spark, d):
    """A note of each nation: its customers by segment."""
    c = table(spark, d, "customer")
    claims = c.select(F.col("c_nationkey").alias("entity"), F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("label"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).alias("recorded_at"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return render.notes(table(spark, d, "nation").select(F.col("n_nationkey").alias("entity"), F.col("n_name").alias("name")), claims)


@query("SELECT 'c' || c_custkey AS anchor, CASE WHEN c_custkey % 10 = 0 THEN 'added' WHEN c_custkey % 10 = 1 THEN 'deleted' ELSE 'edited' END AS change FROM customer WHERE c_custkey % 10 IN (0, 1) OR c_acctbal < 0")
def manifest_diff(spark, d):
    """Two renderings of all customers: some added, some deleted, those in debt edited."""
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("anchor"), "c_name", "c_acctbal")
    sha = lambda x: F.substring(F.sha2(x.cast("binary"), 256), 1, 16)
    before = c.where("c_custkey % 10 <> 0").select("anchor", sha(F.col("c_name")).alias("content_hash"))
    after = c.where("c_custkey % 10 <> 1").select("anchor", sha(F.when(F.col("c_acctbal") < 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))).alias("content_hash"))
    return render.manifest_diff(before, after)


@query("""
WITH r AS (SELECT n_regionkey, n_nationkey, n_name FROM nation)
SELECT n_regionkey AS region, 'nations[' || count(*) || ']{n_nationkey,n_name}:' || chr(10) || string_agg('  ' || n_nationkey || ',' || CASE WHEN regexp_matches(n_name, '[,:"\\\\\\[\\]{}]') THEN '"' || n_name || '"' ELSE n_name END, chr(10) ORDER BY n_nationkey) AS text FROM r GROUP BY 1
""")
def toon_rows(spark, d):
    """The nations of each region in tabular notation."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), "n_nationkey", "n_name")
    return render.tabular(n, "region", "nations", ["n_nationkey", "n_name"], ["n_nationkey"])


@query("SELECT 'conv:' || conv_id || ':' || turn AS node, sha256(text) AS content_hash FROM conversations")
def stream_ingest(spark, d):
    """Turns ingested by a stream, once."""
    schema = spark.read.parquet(f"{d}/conversations.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/conversations.parquet*")
    return ingest.run_once(spark, ingest.contexts(stream), "contexts").select("node", "content_hash")


@query()
def stream_signal_counts(spark, d):
    """Daily counts of signals by a stream, the newest days too."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.run_windows(spark, ingest.signal_windows(stream), "signals", ["start", "event_type"])


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS used FROM events GROUP BY 1, 2")
def signal_counts(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("used"))


@query("WITH c AS (SELECT event_type, CASE event_type WHEN 'view' THEN TIMESTAMP '2024-01-10' WHEN 'click' THEN TIMESTAMP '2024-01-20' END AS cursor FROM (SELECT DISTINCT event_type FROM events)) SELECT event_id FROM events JOIN c USING (event_type) WHERE cursor IS NULL OR ts > cursor")
def cursor_sync(spark, d):
    """Events newer than their source's cursor; a source without one comes whole."""
    e = table(spark, d, "events")
    cursors = spark.createDataFrame([("view", "2024-01-10"), ("click", "2024-01-20")], "event_type string, c string").select("event_type", F.col("c").cast("timestamp").alias("cursor"))
    return files.since_cursor(e, cursors, "event_type", "ts").select("event_id")


@query("SELECT page_id, len(regexp_extract_all(html, '<h[1-6]')) AS headings, len(regexp_extract_all(html, 'href=\"([^\"]*)\"')) AS links FROM pages")
def page_outline(spark, d):
    """Headings and links of every page."""
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("(<h[1-6])"), F.lit(1))).cast("long").alias("headings"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long").alias("links"))


@query()
def note_chunks(spark, d):
    """Every nation's note as a vault would hold it, cut at its headings."""
    notes = materialize(distill_notes(spark, d), "notes")
    return files.chunks(notes, "entity", "note").select("entity", "i", "heading", F.length("body").alias("size"))


WORDS = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


@query(f"""
WITH q AS (SELECT conv_id, {WORDS("arg_min(text, turn)")} AS q FROM conversations WHERE role = 'user' GROUP BY 1),
s AS (SELECT c.conv_id, unnest(string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10))) AS sentence FROM conversations c WHERE role <> 'user'),
r AS (SELECT conv_id, sentence, {R4("len(list_intersect(" + WORDS("sentence") + ", q))::DOUBLE / greatest(len(q), 1) / (1 + 0.002::DOUBLE * greatest(length(sentence) - 80, 0))")} AS score FROM s JOIN q USING (conv_id) WHERE trim(sentence) <> '')
SELECT conv_id, CASE WHEN score >= 0.15 THEN sentence END AS answer, score FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, sentence) = 1
""")
def extractive_answers(spark, d):
    """Of each conversation the sentence of others that answers the user's first turn best."""
    c = table(spark, d, "conversations")
    first = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    return answers.best_sentence(first, c.where("role <> 'user'").select("conv_id", "text"), "conv_id")


@query("SELECT user_id, count(*) AS steps, count(*) FILTER (WHERE ts < before) AS backwards FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) GROUP BY 1")
def audit_integrity(spark, d):
    """Whether each user's log runs forward in time."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").withColumn("before", before).groupBy("user_id").agg(F.count("*").alias("steps"), F.count_if(F.col("ts") < F.col("before")).alias("backwards"))


@query()
def learned_rescore(spark, d):
    """Documents' scores moved by a model trained on which of them were found useful (their quality label)."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    signals = table(spark, d, "labels").join(docs, "doc_id").select("text", F.col("quality").alias("used"))
    return answers.adjust(docs.withColumn("score", F.lit(0.5)), answers.train_scorer(signals), "score").select("doc_id", "score", "adjusted")


@query("SELECT p_brand AS brand, p_partkey AS id, p_name || ', \"' || p_type || '\"' AS label FROM part")
def toon_round_trip(spark, d):
    """The parts of each brand written in tabular notation and read back."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("label"))
    written = materialize(render.tabular(p, "brand", "parts", ["id", "label"], ["id"]), "tabular")
    return render.parse_tabular(written, "brand", "text", ["id", "label"]).select("brand", F.col("id").cast("long").alias("id"), "label")


@query("SELECT event_type, strftime(day, '%Y-%m-%d') AS day FROM (SELECT DISTINCT event_type, date_trunc('day', ts) AS day FROM events) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY day DESC) <= 10")
def snapshots_kept(spark, d):
    """The ten newest days of each kind of event."""
    days = table(spark, d, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    return render.newest(days, ["event_type"], "day", 10)


@query(f"""
WITH o AS (SELECT greatest((epoch(TIMESTAMP '2024-02-01') - floor(epoch(o_orderdate))) / 86400.0::DOUBLE, 0.0::DOUBLE) AS days, l.n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey),
v AS (SELECT w, h FROM (SELECT unnest([0, 1, 2, 3, 4]) AS w), (SELECT unnest([7, 30, 90, 365, 1095]) AS h))
SELECT w, h, floor(avg(floor((w / 4.0::DOUBLE * pow(0.5::DOUBLE, days / h) + (1 - w / 4.0::DOUBLE) * least(1.0::DOUBLE, ln(1 + n::DOUBLE) / ln(51.0::DOUBLE))) * 10000 + 0.5) / 10000) * 10000 + 0.5) / 10000 AS score FROM o, v GROUP BY 1, 2
""")
def knob_sweep(spark, d):
    """The mean score of all orders under 25 settings of the recency weight and the half-life."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    days = F.greatest((F.unix_timestamp(F.lit("2024-02-01").cast("timestamp")) - F.unix_timestamp("o_orderdate")) / 86400.0, F.lit(0.0))
    o = table(spark, d, "orders").join(lines, "o_orderkey").select(days.alias("days"), "n")
    settings = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w in range(5) for h in (7, 30, 90, 365, 1095)])).alias("s")
    v = o.select("days", "n", settings).select("days", "n", "s.w", "s.h")
    often = F.least(F.lit(1.0), F.log1p(F.col("n").cast("double")) / F.log1p(F.lit(50.0)))
    score = r4(F.col("w") / 4.0 * F.pow(F.lit(0.5), F.col("days") / F.col("h")) + (1 - F.col("w") / 4.0) * often)
    return v.groupBy("w", "h").agg(r4(F.avg(score)).alias("score"))
