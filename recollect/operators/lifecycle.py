"""Versions, validity, decay, retention, forgetting, refresh and import."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import r4
from recollect.operators import graph
from recollect.operators.recall import decayed
from recollect.session import materialize


def latest(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The current state of an append-only version log: the newest row of each key, without deletions."""
    newest = log.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where("__n = 1").drop("__n")
    return newest.where("op <> 'delete'") if "op" in log.columns else newest


def validity(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Each version's half-open validity: it ends where the next of its key begins."""
    order = Window.partitionBy(key).orderBy(at, tie)
    return events.withColumn("valid_from", F.col(at)).withColumn("valid_until", F.lead(at).over(order))


def as_of(versions: DataFrame, at: Column) -> DataFrame:
    return versions.where((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))


def decay(nodes: DataFrame, now: Column) -> DataFrame:
    """(node, before, after) of confidences that fall by more than 0.005; only inferred, unpinned, live nodes fall."""
    eligible = (F.col("source_type") == "inferred") & ~F.col("pinned") & F.col("invalidated_at").isNull()
    after = decayed(F.col("confidence"), now, F.coalesce("last_referenced", "created_at"), eligible)
    return nodes.select("node", r4(F.col("confidence")).alias("before"), r4(after).alias("after")).where("before - after > 0.005")


def retention(nodes: DataFrame, now: Column, days: int, mode: str) -> DataFrame:
    """(node, action): keep, archive (invalidate) or expire (forget) what was not referenced for ``days``."""
    stale = F.coalesce("last_referenced", "created_at") < now - F.make_dt_interval(F.lit(days))
    hit = stale & ~F.col("pinned") & F.col("invalidated_at").isNull()
    return nodes.select("node", F.when(hit & F.lit(mode != "keep"), mode).otherwise("keep").alias("action"))


def mark_used(edges: DataFrame, used: DataFrame, step: float = 0.05) -> DataFrame:
    """Edges with the weight of those at a used node raised by ``step``, to 1 at most."""
    at = materialize(used.select("node").distinct(), "used")  # written once, and each part of it hashed: the edges need no sort
    side = lambda end, flag: at.select(F.col("node").alias(end), F.lit(True).alias(flag)).hint("shuffle_hash")
    flagged = edges.join(side("source", "__s"), "source", "left").join(side("target", "__t"), "target", "left")
    raised = F.least(F.lit(1.0), F.col("weight") + step)
    return flagged.withColumn("weight", F.when(F.col("__s") | F.col("__t"), raised).otherwise(F.col("weight"))).select(*edges.columns)


def refresh(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(key, decision) of keyed inputs: append (new), noop (same hash), adopt (no hash yet) or refresh."""
    old = stored.select("key", F.lit(True).alias("__known"), F.col("content_hash").alias("__old"))
    new = incoming.select("key", F.sha2(F.col("content").cast("binary"), 256).alias("__new"))
    decision = F.when(F.col("__known").isNull(), "append").when(F.col("__old").isNull(), "adopt").when(F.col("__old") == F.col("__new"), "noop").otherwise("refresh")
    return new.join(old, "key", "left").select("key", decision.alias("decision"))


def import_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after an import that adds (``merge``), takes over (``replace``) or must not meet data (``refuse``).

    All-or-nothing: doubled ids and edges whose ends are unknown raise before anything is written.
    """
    if not new_nodes.groupBy("node").count().where("count > 1").isEmpty():
        raise ValueError("doubled node ids in the import")
    if mode == "refuse" and not nodes.isEmpty():
        raise ValueError("the graph is not empty")
    ids = new_nodes.select("node") if mode != "merge" else new_nodes.select("node").union(nodes.select("node")).distinct()
    if not graph.dangling(new_edges, ids).isEmpty():
        raise ValueError("edges without both ends in the import")
    if mode != "merge":
        return new_nodes, new_edges
    return nodes.unionByName(new_nodes.join(nodes.select("node"), "node", "left_anti"), allowMissingColumns=True), edges.unionByName(new_edges.join(edges.select("edge_id"), "edge_id", "left_anti"), allowMissingColumns=True)


def forget_order(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, int]:
    """(node, layer, cycle) of ``ids`` (node) and all that derives from them, in the order in which they can go; and the number of layers.

    Layer 0 are nodes from which nothing derives, layer n + 1 those from which nothing is left once layer n is gone. Nodes on a cycle, and
    those from which a cycle derives, never get so far: they go last, together, and are marked. One round is two anti-joins; rounds are as
    many as the longest derivation.
    """
    derived = materialize(edges.where("edge_type = 'derived_from'").select(F.col("source").alias("child"), F.col("target").alias("parent")).distinct(), "derived")
    front = found = materialize(ids.select("node").distinct(), "found")
    seen = [found]
    while not front.isEmpty():
        step = derived.join(front.withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("node")).distinct()
        front = materialize(step.join(found, "node", "left_anti"), "found")
        seen.append(front)
        found = reduce(DataFrame.union, seen)
    left = materialize(found, "left")
    links = materialize(derived.join(left.withColumnRenamed("node", "child"), "child").join(left.withColumnRenamed("node", "parent"), "parent"), "links")
    layers: list[DataFrame] = []
    while not left.isEmpty():
        leaves = materialize(left.join(links.select(F.col("parent").alias("node")).distinct(), "node", "left_anti"), "leaves")
        stuck = leaves.isEmpty()
        gone = left if stuck else leaves
        layers.append(gone.select("node", F.lit(len(layers)).alias("layer"), F.lit(stuck).alias("cycle")))
        if stuck:
            break
        left = materialize(left.join(gone, "node", "left_anti"), "left")
        links = materialize(links.join(gone.withColumnRenamed("node", "child"), "child", "left_anti"), "links")
    empty = ids.select("node").limit(0).select("node", F.lit(0).alias("layer"), F.lit(False).alias("cycle"))
    return reduce(DataFrame.unionByName, layers, empty), len(layers)


def forget(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without ``ids``: pinned empty tombstones take their place as origins of what was derived from them."""
    gone = ids.select("node").distinct().join(nodes.where("node like 'tombstone:%'"), "node", "left_anti")
    kept = nodes.join(gone, "node", "left_anti")
    origin = edges.where("edge_type = 'derived_from'").join(gone.withColumnRenamed("node", "target"), "target", "left_semi").join(gone.withColumnRenamed("node", "source"), "source", "left_anti")
    moved = origin.withColumn("target", F.concat(F.lit("tombstone:"), "target"))
    rest = edges.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti")
    stones = moved.select(F.col("target").alias("node")).distinct().withColumn("pinned", F.lit(True))
    return kept.unionByName(stones, allowMissingColumns=True), rest.unionByName(moved.select(*rest.columns))


def supersede(nodes: DataFrame, pairs: DataFrame, now: Column) -> DataFrame:
    """Nodes after ``pairs`` (old, new) superseded each other: bounds are written once, the old one is invalidated."""
    start = lambda: F.coalesce("event_start", "recorded_at")
    at = pairs.join(nodes.select(F.col("node").alias("new"), F.coalesce("event_start", "recorded_at", now).alias("__at")), "new")
    closing = at.groupBy(F.col("old").alias("node")).agg(F.min("__at").alias("__until"))
    opening = at.groupBy(F.col("new").alias("node")).agg(F.min("__at").alias("__from"))
    joined = nodes.join(closing, "node", "left").join(opening, "node", "left")
    return joined.withColumns({
        "valid_from": F.coalesce("valid_from", F.when(F.col("__until").isNotNull(), start()), "__from"),
        "valid_until": F.coalesce("valid_until", "__until"),
        "invalidated_at": F.coalesce("invalidated_at", F.when(F.col("__until").isNotNull(), now)),
    }).drop("__until", "__from")


def consolidate(nodes: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """One row: nodes that decay, orphans but for contexts, live nodes and edges."""
    down = decay(nodes, now).agg(F.count("*").alias("decayed"))
    lone = graph.orphans(nodes.where("node_type <> 'context' and invalidated_at is null"), edges).agg(F.count("*").alias("orphans"))
    live = nodes.agg(F.count_if(F.col("invalidated_at").isNull()).alias("live_nodes"))
    return down.join(lone).join(live).join(edges.agg(F.count("*").alias("edges")))
