"""Stored communities, vectors that follow their nodes, triggers by count, and results as text for a client."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def communities_of(members: DataFrame, anchors: DataFrame) -> DataFrame:
    """(query, community): the distinct communities of anchors (query, node); nodes in none give no row."""
    return anchors.join(members.where("community is not null"), "node").select("query", "community").distinct()


def community_sizes(members: DataFrame) -> DataFrame:
    """(community, size, first): stored communities and their least node."""
    return members.where("community is not null").groupBy("community").agg(F.count("*").alias("size"), F.min("node").alias("first"))


def reindex(vectors: DataFrame, changed: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(node, vector): every changed node's vector is made anew from its text, and removed where the text is null.

    ``changed`` is (node, text), a node once; null texts stand for deleted nodes. Vectors of other nodes stay.
    """
    kept = vectors.join(changed, "node", "left_anti").select("node", "vector")
    return kept.unionByName(changed.where("text is not null").select("node", embed(F.col("text")).alias("vector")))


def pending(nodes: DataFrame, vectors: DataFrame, batch: int = 256) -> DataFrame:
    """The first ``batch`` nodes (by node) that have no vector yet; the rest wait for the next search."""
    return nodes.join(vectors, "node", "left_anti").orderBy("node").limit(batch)


def due(log: DataFrame, key: str, order: list[str], every: int = 50, first: int | None = None) -> DataFrame:
    """Rows of each key's log at which its counter fills: after ``first`` rows (``every`` if none), then every ``every``."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - F.lit(every if first is None else first)
    return log.withColumn("__n", n).where((F.col("__n") >= 0) & (F.col("__n") % every == 0)).drop("__n")


def signals(results: DataFrame, at: Column) -> DataFrame:
    """(query, node, was_used, at): what was returned, to be appended to the log; nothing has been used yet."""
    return results.select("query", "node", F.lit(False).alias("was_used"), at.alias("at"))


def payload(results: DataFrame, *fields: str) -> DataFrame:
    """(query, payload): each query's results (query, rank, fields; a page of bounded size) as one JSON text in order."""
    page = F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("r")))).getField("r")
    return results.groupBy("query").agg(page.alias("results")).select("query", F.to_json(F.struct("query", "results")).alias("payload"))
