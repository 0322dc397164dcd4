"""Recall: anchors, walk, three-factor score, confidence, filters and ranking, for many queries at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import normalize_label, r4
from recollect.operators import extract, graph, resolve, substrings, vectors
from recollect.session import materialize

# Weights and bounds of the score, and the words that keyword anchors ignore (fixed values).
RECENCY, FREQUENCY, PROXIMITY, HALF_LIFE, FREQUENT, HOP_LOSS, DEPTH = 0.35, 0.30, 0.35, 365.0, 50, 0.3, 3
SIMILAR, REFINE, BOOST, RRF_K, TOP_K = 0.30, 0.25, 0.15, 60, 30
KEYWORD_STOP = """what did we about the is are was were how when where why who do does a an in on at to for of with that this
it and or but not no have has had be been will would can could should may might my our i you he she they me us them
last next any some""".split()


def days_between(now: Column, then: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400.0


def recency(now: Column, then: Column) -> Column:
    return r4(F.pow(F.lit(0.5), F.greatest(days_between(now, then), F.lit(0.0)) / HALF_LIFE))


def frequency(count: Column) -> Column:
    return r4(F.least(F.lit(1.0), F.log1p(count.cast("double")) / F.log1p(F.lit(float(FREQUENT)))))


def proximity(hops: Column) -> Column:
    return r4(F.when(hops > DEPTH, 0.0).otherwise(F.greatest(1 - HOP_LOSS * hops, F.lit(0.0))))


def three_factor(r: Column, f: Column, p: Column) -> Column:
    return r4(RECENCY * r + FREQUENCY * f + PROXIMITY * p)


def decayed(confidence: Column, now: Column, since: Column, eligible: Column) -> Column:
    """A hundredth a week, not below 0.15 and never upwards; only where ``eligible``."""
    weeks = F.floor(F.greatest(days_between(now, since), F.lit(0.0))) / 7
    return F.when(eligible, F.least(confidence, F.greatest(F.lit(0.15), confidence - weeks * 0.01))).otherwise(confidence)


def final_score(base: Column, similarity: Column, boost: Column, confidence: Column) -> Column:
    return r4(F.when(similarity.isNotNull(), (similarity + REFINE * base + boost) * confidence).otherwise((base + boost) * confidence))


def as_of_reason(as_of: Column | None, node_type: Column, valid_from: Column, valid_until: Column, invalidated: Column, include_context: bool = False) -> Column:
    """Why a row is left out, or null."""
    reason = F.when((node_type == "context") & F.lit(not include_context), "context_excluded")
    if as_of is not None:
        reason = reason.when(valid_from > as_of, "not_yet_valid").when(valid_until <= as_of, "no_longer_valid")
        return reason.when(invalidated.isNotNull() & valid_until.isNull(), "invalidated")
    return reason.when(invalidated.isNotNull(), "invalidated")


def keyword_texts(nodes: DataFrame, at: str | None = None) -> DataFrame:
    """(node, text) in which keywords are looked for: label and content of all nodes but contexts, in lower case; with the column ``at`` as at."""
    text = F.lower(F.concat_ws(" ", "label", "content")).alias("text")
    return nodes.where("node_type <> 'context'").select("node", text, *([F.col(at).alias("at")] if at else []))


def keyword_anchors(nodes: DataFrame, queries: DataFrame, limit: int = 10, index: DataFrame | None = None) -> DataFrame:
    """(query, node, rank): newest nodes whose label or content contains any word of the query, as a substring.

    ``index`` are written ``substrings.postings`` of ``keyword_texts`` of the nodes.
    """
    words = queries.select("query", F.explode(F.array_except(F.split(F.lower("text"), r"\s+"), F.array(*map(F.lit, KEYWORD_STOP)))).alias("word")).where("word <> ''")
    # A query's newest are among the newest of its words.
    found = materialize(substrings.newest(keyword_texts(nodes, "created_at"), words, limit, index), "found")
    hits = words.join(found, "word").select("query", "node", F.col("at").alias("created_at")).distinct()
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("created_at"), "node"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "node", "rank")


def knn(embedded: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query, item, similarity, rank): the k nearest of ``embedded`` (vec_id, embedding) by cosine; similarity is 1 / (1 + distance).

    ``queries`` (query, embedding) are a stated set; they meet the vectors in tiles. For less work on many vectors see ``vectors.inverted_file``.
    """
    return vectors.exact(embedded.select(F.col("vec_id").alias("item"), "embedding"), queries, k)


def entity_anchors(nodes: DataFrame, named: DataFrame, below: int = 3, least: float | None = 0.75) -> DataFrame:
    """(query, node, exact) of the entities that queries name: ``named`` is (query, label, node_type).

    A name's anchor is the first node of its type whose normalised label is equal; where there is none, every label of any
    type within ``below`` edits or ``least`` alike, by the first node of the type that bears it (``resolve.dedup_exact`` names the others).
    Names and labels meet by keys alone.
    """
    told = materialize(named.where("node_type <> 'context'").select("query", "label", "node_type", normalize_label("label").alias("norm")).distinct(), "named")
    # A label's first node stands for all that bear it, so a common label costs a row and not its nodes times its names.
    labels = nodes.where("node_type <> 'context'").groupBy("node_type", normalize_label("label").alias("norm")).agg(F.min("node").alias("node"))
    labels = materialize(labels.where("norm is not null"), "labels")
    few = F.broadcast if labels.count() <= substrings.FEW else (lambda df: df)
    equal = materialize(told.join(few(labels), ["node_type", "norm"]).select("query", "label", "node_type", "node"), "exact")
    rest = told.join(few(labels.select("node_type", "norm")), ["node_type", "norm"], "left_anti")
    words, every = rest.select(F.col("norm").alias("label")).distinct(), labels.select(F.col("norm").alias("label")).distinct()
    near = resolve.fuzzy_pairs(words, every, below).select(F.col("a").alias("norm"), F.col("b").alias("found"))
    if least is not None:
        # The share is not the same both ways: the label comes first, the name second.
        alike = resolve.alike_pairs(every.select(F.lit("any").alias("node_type"), F.col("label").alias("norm"), F.concat(F.lit("0"), "label").alias("node")).unionByName(words.select(F.lit("any").alias("node_type"), F.col("label").alias("norm"), F.concat(F.lit("1"), "label").alias("node"))), below, least)
        near = near.union(alike.where("before like '0%' and after like '1%'").select(F.substring("after", 2, 1 << 20), F.substring("before", 2, 1 << 20))).distinct()
    anchors = materialize(near.join(labels.select("node", F.col("norm").alias("found")), "found").select("norm", "node"), "near")
    close = rest.join(F.broadcast(anchors) if anchors.count() <= substrings.FEW else anchors, "norm").select("query", "label", "node_type", "node")
    both = equal.withColumn("exact", F.lit(True)).unionByName(close.withColumn("exact", F.lit(False)))
    return both.groupBy("query", "node").agg(F.max("exact").alias("exact"))


def named_in(queries: DataFrame) -> DataFrame:
    """(query, label, node_type) of what the extractor finds in the queries' texts."""
    parts = {"entity": extract.tech_entities(queries, "query", "text").select("query", "label").unionByName(extract.entities(queries, "query", "text")), "decision": extract.decisions(queries, "query", "text"), "fact": extract.facts(queries, "query", "text"), "preference": extract.preferences(queries, "query", "text")}
    found = [df.select("query", "label", F.lit(kind).alias("node_type")) for kind, df in parts.items()]
    topics = extract.topics(queries, "query", "text").select("query", F.col("topic").alias("label"), F.lit("topic").alias("node_type"))
    return reduce(DataFrame.unionByName, [*found, topics])


def semantic_anchors(near: DataFrame, floor: float = SIMILAR) -> DataFrame:
    """Of nearest vectors (query, item, similarity, rank) those similar enough to be anchors."""
    return near.where(F.col("similarity") >= floor).select("query", F.col("item").alias("node"), "similarity", "rank")


def fused_anchors(keyword: DataFrame, semantic: DataFrame, top: int = TOP_K) -> DataFrame:
    """(query, node, score, rank) of both ranked lists (query, node, rank) by reciprocal rank."""
    item = lambda df: df.select("query", F.col("node").alias("item"), "rank")
    return rrf(item(keyword).unionByName(item(semantic)), top).withColumnRenamed("item", "node")


def union_anchors(entity: DataFrame, keyword: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """(query, node): entities, keywords only where a query names no entity, and what is similar."""
    fallback = keyword.join(entity.select("query").distinct(), "query", "left_anti")
    parts = [entity, fallback] + ([semantic] if semantic is not None else [])
    return reduce(DataFrame.unionByName, [p.select("query", "node") for p in parts]).distinct()


def rrf(lists: DataFrame, top: int = TOP_K) -> DataFrame:
    """(query, item, score, rank) of ranked lists (query, item, rank) fused by reciprocal rank."""
    fused = lists.groupBy("query", "item").agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("raw"))
    fused = fused.select("query", "item", (F.floor(F.col("raw") * 1e8 + 0.5) / 1e8).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    return fused.withColumn("rank", rank).where(F.col("rank") <= top)


def scored(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, now: Column, least: float = 0.01, as_of: Column | None = None, similarity: DataFrame | None = None, depth: int = DEPTH, members: DataFrame | None = None, include_context: bool = False, include_invalidated: bool = False, fading: bool = False, scorer=None) -> DataFrame:
    """Every node that a query's walk reaches with its scores and, in ``reason``, why it is left out (null: it is not).

    ``members`` (node, community) boost nodes of the anchors' communities; ``fading`` lets confidence decay up to ``now``
    (nodes then carry source_type, pinned and last_referenced); ``scorer`` maps the rows to a column that replaces the base score.
    """
    rows, queries = _bit_scored(nodes, edges, anchors, now, as_of, depth, None if similarity is not None or scorer else members, include_context, include_invalidated, fading)
    if similarity is None and not scorer:
        return graph.by_query(_judged(rows.withColumn("similarity", F.lit(None).cast("double")), least), queries)
    rows = graph.by_query(rows.drop("boost"), queries)
    rows = rows.join(similarity.select("query", "node", "similarity"), ["query", "node"], "left") if similarity is not None else rows.withColumn("similarity", F.lit(None).cast("double"))
    boost = F.lit(0.0)
    if members is not None:
        home = anchors.select("query", "node").join(members, "node").select("query", "community").distinct().withColumn("__home", F.lit(True))
        rows = rows.join(members.select("node", "community"), "node", "left").join(home, ["query", "community"], "left")
        boost = F.when(F.col("__home"), BOOST).otherwise(0.0)
    rows = rows.withColumn("boost", boost)
    return _judged(rows.withColumn("base", scorer(rows)) if scorer else rows, least)


def _bit_scored(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, now: Column, as_of: Column | None, depth: int, members: DataFrame | None, include_context: bool, include_invalidated: bool, fading: bool) -> tuple[DataFrame, DataFrame]:
    """The rows of the walk on bitmaps with what does not depend on a query, and the queries; a row whose queries differ in their boost is two."""
    reached, queries = graph.bit_hops(graph.connections(edges), anchors, depth)
    boost = F.lit(0.0)
    if members is not None:
        told = queries.select("__part", F.posexplode("queries").alias("n", "query"))
        home = anchors.join(told, "query").join(members, "node").groupBy("__part", "community").agg(F.bit_or(F.expr("shiftleft(1L, n)")).alias("__home"))
        homes = members.join(F.broadcast(home) if home.count() <= graph.FEW else home, "community").groupBy("__part", "node").agg(F.bit_or("__home").alias("__home"))
        both = F.array(F.struct(F.col("__bits").bitwiseAND(F.coalesce("__home", F.lit(0).cast("long"))).alias("__bits"), F.lit(BOOST).alias("boost")), F.struct(F.col("__bits").bitwiseAND(F.bitwise_not(F.coalesce("__home", F.lit(0).cast("long")))).alias("__bits"), F.lit(0.0).alias("boost")))
        reached = reached.join(homes, ["__part", "node"], "left").select("__part", "node", "hops", F.inline(both)).where("__bits <> 0")
        boost = F.col("boost")
    rows = reached.join(nodes, "node", "left")
    reason = F.when(F.col("node_type").isNull(), "missing").otherwise(as_of_reason(as_of, F.col("node_type"), F.col("valid_from"), F.col("valid_until"), F.lit(None) if include_invalidated else F.col("invalidated_at"), include_context))
    when = F.coalesce("recorded_at", "created_at") if "recorded_at" in nodes.columns else F.col("created_at")
    rows = rows.withColumns({"reason": reason, "recency": recency(now, when), "frequency": frequency(F.col("access_count")), "proximity": proximity(F.col("hops")), "boost": boost})
    rows = rows.withColumn("base", three_factor(F.col("recency"), F.col("frequency"), F.col("proximity")))
    sure = F.col("confidence")
    if fading:
        sure = decayed(sure, now, F.coalesce("last_referenced", "created_at"), (F.col("source_type") == "inferred") & ~F.col("pinned") & F.col("invalidated_at").isNull())
    return rows.withColumn("__sure", sure), queries


def _judged(rows: DataFrame, least: float) -> DataFrame:
    rows = rows.withColumn("score", final_score(F.col("base"), F.col("similarity"), F.col("boost"), F.col("__sure"))).drop("__sure")
    return rows.withColumn("reason", F.coalesce("reason", F.when(F.col("score") < least, "below_min_score")))


def _leading(rows: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """``rows`` (__part, __bits, score, ...) whose bits are left to the queries in which the score is among the ``top`` highest, ties included.

    Scores are counted by query first, so nothing is sorted but the few rows that lead. ``rows`` is read twice: hand over a written table.
    """
    key = F.coalesce("score", F.lit(float("-inf")))
    told = queries.select("__part", F.posexplode("queries").alias("n", "query"))
    counted = graph.by_query(rows.select("__bits", "__part", F.col("__part").alias("part"), key.alias("at")), queries).groupBy("part", "query", "at").agg(F.count("*").alias("many"))
    above = F.sum("many").over(Window.partitionBy("query").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1))
    lead = counted.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < top).join(told, "query")
    mask = materialize(lead.groupBy(F.col("part").alias("__part"), "at").agg(F.bit_or(F.expr("shiftleft(1L, n)")).alias("__lead")), "leading")
    kept = rows.withColumn("at", key).join(F.broadcast(mask) if mask.count() <= graph.FEW else mask, ["__part", "at"])
    return kept.withColumn("__bits", F.col("__bits").bitwiseAND(F.col("__lead"))).where("__bits <> 0").drop("at", "__lead")


def recall(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, now: Column, top: int = 5, least: float = 0.01, as_of: Column | None = None, similarity: DataFrame | None = None, depth: int = DEPTH, rerank=None, head: int = 20, **more) -> DataFrame:
    """(query, node, hops, recency, frequency, proximity, score, rank): the best ``top`` nodes of each query.

    ``nodes`` carry node, node_type, created_at, access_count, confidence, valid_from,
    valid_until and invalidated_at; ``similarity`` (query, node, similarity) makes the score semantic first. ``rerank`` maps the rows
    to a column by which the first ``head`` of each query are put in order anew. ``more`` is as for ``scored``.
    """
    if similarity is None and more.get("scorer") is None:
        flags = [more.get(k, False) for k in ("include_context", "include_invalidated", "fading")]
        rows, queries = _bit_scored(nodes, edges, anchors, now, as_of, depth, more.get("members"), *flags)
        rows = _judged(rows.withColumn("similarity", F.lit(None).cast("double")), least).where("reason is null")
        # Other columns of the nodes are for the rerank alone.
        rows = materialize(rows if rerank else rows.select("__part", "__bits", "node", "hops", "recency", "frequency", "proximity", "score"), "scored")
        rows = graph.by_query(_leading(rows, queries, max(top, head) if rerank else top), queries)
    else:
        rows = scored(nodes, edges, anchors, now, least, as_of, similarity, depth, **more).where("reason is null")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (max(top, head) if rerank else top))
    if rerank:
        again = ranked.withColumn("second", F.when(F.col("rank") <= head, rerank(ranked)))
        ranked = again.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.isnull("second"), F.desc("second"), "rank"))).where(F.col("rank") <= top)
    return ranked.select("query", "node", "hops", "recency", "frequency", "proximity", "score", "rank")


def attach_tensions(results: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``results`` with ``tensions``: the live nodes that conflict with each result's node, in order of their ids."""
    pairs = graph.tensions(edges, nodes)
    other = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    asked = other.join(results.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_list("other")).alias("tensions"))
    return results.join(asked, "node", "left").withColumn("tensions", F.coalesce("tensions", F.array().cast("array<string>"))).select(*results.columns, "tensions")


def confidence_page(nodes: DataFrame, now: Column, order: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of nodes, newest first by ``order``, then in the order of their confidence as it has decayed by ``now``."""
    eligible = (F.col("source_type") == "inferred") & ~F.col("pinned") & F.col("invalidated_at").isNull()
    page = nodes.orderBy(F.desc(order), "node").offset(offset).limit(limit)
    return page.withColumn("confidence", r4(decayed(F.col("confidence"), now, F.coalesce("last_referenced", "created_at"), eligible))).orderBy(F.desc("confidence"), "node")
