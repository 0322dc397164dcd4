"""Entity resolution: exact by normalised label, fuzzy by edit distance or matching characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.similarity import ratio
from recollect.functions.text import normalize_label
from recollect.session import materialize


def dedup_exact(nodes: DataFrame) -> DataFrame:
    """(node, canonical): the first node of the same type and normalised label; contexts stay themselves."""
    keyed = nodes.withColumn("norm", normalize_label("label"))
    first = keyed.where("node_type <> 'context'").groupBy("node_type", "norm").agg(F.min("node").alias("canonical"))
    return keyed.join(first, ["node_type", "norm"], "left").select("node", F.coalesce("canonical", "node").alias("canonical"))


def fuzzy_pairs(left: DataFrame, right: DataFrame, below: int) -> DataFrame:
    """(a, b, distance) of labels closer than ``below`` edits, each side (label).

    Labels closer than ``below`` edits share one of ``below`` pieces of the shorter one
    at almost its place; the pieces with their possible places are the join's key, so unlike labels never meet.
    """
    piece = lambda c, n: F.transform(F.sequence(F.lit(0), F.lit(below - 1)), lambda i: F.struct(i.alias("i"), F.floor(n * i / below).cast("int").alias("from"), F.floor(n * (i + 1) / below).cast("int").alias("to")))
    n = F.length("a")
    cut = left.select(F.col("label").alias("a")).distinct().select("a", n.alias("n"), F.explode(piece("a", n)).alias("p")).select("a", "n", F.col("p.i").alias("i"), F.substring("a", F.col("p.from") + 1, F.col("p.to") - F.col("p.from")).alias("piece"))
    other = right.select(F.col("label").alias("b")).distinct().select("b", F.explode(F.sequence(F.greatest(F.lit(0), F.length("b") - (below - 1)), F.length("b") + (below - 1))).alias("n"))
    pieces = other.select("b", "n", F.explode(piece("b", F.col("n"))).alias("p"))
    shifted = pieces.select("b", "n", F.col("p.i").alias("i"), F.col("p.from").alias("from"), (F.col("p.to") - F.col("p.from")).alias("len"), F.explode(F.sequence(F.lit(1 - below), F.lit(below - 1))).alias("shift"))
    shifted = shifted.where("from + shift >= 0").select("b", "n", "i", F.substring("b", F.col("from") + F.col("shift") + 1, F.col("len")).alias("piece")).distinct()
    near = cut.join(shifted, ["n", "i", "piece"]).select("a", "b").distinct()
    return near.withColumn("distance", F.levenshtein("a", "b", below)).where((F.col("distance") >= 0) & (F.col("distance") < below))


def alike_pairs(labels: DataFrame, below: int, least: float) -> DataFrame:
    """(before, after) of the nodes of labels (node_type, norm, node) that match: of one type, within ``below`` edits or ``least`` alike.

    Labels ``least`` alike share matching characters in order, and so bigrams: at least ``share`` times
    their lengths, less one. Each label is keyed by its rarest bigrams, as many as leave fewer than that over; those
    too short to have to share one are within a few edits.
    """
    share = 1.5 * least - 1
    if share <= 0:
        raise ValueError("least must be above 2/3")
    labels = materialize(labels, "labels")
    words = labels.select("norm").distinct()
    reach = max(below, int((1 - least) / share + 1e-9) + 1)
    close = fuzzy_pairs(words.select(F.col("norm").alias("label")), words.select(F.col("norm").alias("label")), reach).select("a", "b")
    n = F.length("norm")
    two = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(F.col("norm"), i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    told = F.transform("two", lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice("two", F.lit(1), i), lambda h: h == g)).cast("string")))
    grams = materialize(words.withColumn("two", two).select("norm", n.alias("n"), told.alias("grams")), "grams")
    each = grams.select("norm", "n", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    ranked = each.join(each.groupBy("gram").agg(F.count("*").alias("uses")), "gram").withColumn("rank", F.row_number().over(Window.partitionBy("norm").orderBy("uses", "gram")))
    fewest = F.greatest(F.lit(1), F.ceil(share * F.col("n") * (1 + least / (2 - least)) - 1 - 1e-9))
    keys = ranked.where(F.col("rank") <= F.col("size") - fewest + 1).select("norm", "n", "gram")
    left, right = keys.select(F.col("norm").alias("a"), F.col("n").alias("na"), "gram"), keys.select(F.col("norm").alias("b"), F.col("n").alias("nb"), "gram")
    both = F.col("na") + F.col("nb")
    met = left.join(right, "gram").where((2 * F.least("na", "nb") >= least * both - 1e-9) & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    full = lambda c: grams.select(F.col("norm").alias(c), F.col("n").alias(f"n{c}"), F.col("grams").alias(f"g{c}"))
    met = met.join(full("a"), "a").join(full("b"), "b").where(F.size(F.array_intersect("ga", "gb")) >= share * both - 1 - 1e-9).select("a", "b")
    found = materialize(close.where("a <> b").union(met).distinct(), "near")
    side = lambda c, name: labels.select("node_type", F.col("norm").alias(c), F.col("node").alias(name))
    ordered = found.join(side("a", "before"), "a").join(side("b", "after"), ["node_type", "b"]).where("before < after")
    near = F.levenshtein("a", "b") < below
    return ordered.withColumn("near", near).where(F.when(F.col("near"), True).otherwise(ratio("a", "b") >= least)).select("before", "after")


def dedup_greedy(nodes: DataFrame, below: int = 5, least: float = 0.75) -> DataFrame:
    """(node, canonical): as if one node after another, of each type, were held against those kept so far.

    Nodes come in order of their id; the first kept node is a match if its label is
    equal when normalised, within ``below`` edits, or ``least`` alike. The matching pairs are found first; then, round by
    round, nodes without an earlier undecided match are kept and their later matches are merged. Contexts and nodes
    without a label stay themselves.
    """
    keyed = nodes.where("node_type <> 'context'").select("node", "node_type", normalize_label("label").alias("norm")).where("norm is not null")
    labels = keyed.groupBy("node_type", "norm").agg(F.min("node").alias("first"))
    pairs = materialize(alike_pairs(labels.withColumnRenamed("first", "node"), below, least), "pairs")
    merged, left = [pairs.select(F.col("after").alias("node")).limit(0)], pairs
    while not left.isEmpty():
        kept = left.select("before").distinct().join(left.select(F.col("after").alias("before")), "before", "left_anti")
        merged.append(materialize(left.join(kept, "before").select(F.col("after").alias("node")).distinct(), "merged"))
        gone = lambda c: merged[-1].withColumnRenamed("node", c)
        left = materialize(left.join(gone("after"), "after", "left_anti").join(gone("before"), "before", "left_anti").select("before", "after"), "left")
    lost = reduce(DataFrame.union, merged)
    into = pairs.join(lost.withColumnRenamed("node", "before"), "before", "left_anti").groupBy(F.col("after").alias("first")).agg(F.min("before").alias("into"))
    names = labels.join(into, "first", "left").select("node_type", "norm", F.coalesce("into", "first").alias("canonical"))
    return nodes.withColumn("norm", normalize_label("label")).join(names, ["node_type", "norm"], "left").select("node", F.coalesce("canonical", "node").alias("canonical"))


def remap(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges between canonical nodes, without loops.

    Only edges of which an end moves are touched. One that comes to lie beside others of its type becomes one edge with them: of the
    greatest weight and the greatest confidence, under the least id of those that lay there before (null if none did).
    """
    lost = names.where("node <> canonical")
    by = lambda c: lost.select(F.col("node").alias(c), F.col("canonical").alias(f"__{c}"))
    found = edges.join(by("source"), "source", "left").join(by("target"), "target", "left").withColumn("__moved", F.expr("__source is not null or __target is not null"))
    found = found.withColumn("source", F.coalesce("__source", "source")).withColumn("target", F.coalesce("__target", "target")).drop("__source", "__target").where("source <> target")
    key = ["source", "target", "edge_type"]
    changed = found.where("__moved").select(*key).distinct()
    rest = [c for c in edges.columns if c not in key]
    merged = found.join(changed, key, "left_semi").groupBy(*key).agg(*[F.min(F.when(~F.col("__moved"), F.col(c))).alias(c) if c == "edge_id" else F.max(c).alias(c) for c in rest])
    return found.where("not __moved").join(changed, key, "left_anti").select(*edges.columns).unionByName(merged.select(*edges.columns))
