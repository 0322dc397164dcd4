"""Traversal of the memory graph: edges are stored directed and walked undirected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import discard, keyed, materialize


def adjacency(edges: DataFrame, use_confidence: bool = False) -> DataFrame:
    """(src, dst, strength) in both directions; of parallel edges the strongest counts."""
    strength = F.coalesce("weight", F.lit(0.5))
    if use_confidence:
        strength = strength * F.coalesce("confidence", F.lit(0.5))
    flat = edges.select("source", "target", strength.alias("strength"))
    both = flat.select(F.inline(F.array(F.struct(F.col("source").alias("src"), F.col("target").alias("dst"), "strength"), F.struct(F.col("target").alias("src"), F.col("source").alias("dst"), "strength"))))
    return both.groupBy("src", "dst").agg(F.max("strength").alias("strength"))


def connections(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, parallel edges as they are: enough for a walk that counts steps alone."""
    both = F.array(F.struct(F.col("source").alias("src"), F.col("target").alias("dst")), F.struct(F.col("target").alias("src"), F.col("source").alias("dst")))
    return edges.select(F.inline(both))


def strengths(edges: DataFrame) -> DataFrame:
    """(src, dst, strength) in both directions, parallel edges as they are: enough for a walk, which takes the strongest itself."""
    strength = F.coalesce("weight", F.lit(0.5)).alias("strength")
    flat = edges.select("source", "target", strength)
    return flat.select(F.inline(F.array(F.struct(F.col("source").alias("src"), F.col("target").alias("dst"), "strength"), F.struct(F.col("target").alias("src"), F.col("source").alias("dst"), "strength"))))


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, neighbour) of every id in ``ids`` (node)."""
    return adjacency(edges).join(ids.select(F.col("node").alias("src")), "src").select(F.col("src").alias("node"), F.col("dst").alias("neighbour"))


#: Queries whose walks share a row: the bits of a long, but for its sign.
BITS = 63
#: Groups of queries up to this number are broadcast, with the queries' names; above it they are joined by a shuffle.
FEW = 10_000


def numbered(queries: DataFrame, bits: int = BITS) -> DataFrame:
    """(__part, queries) of the distinct ``queries`` (query) in arrays of up to ``bits``; a query's place is its bit."""
    blocks = max(1, queries.agg(F.approx_count_distinct("query")).first()[0] // (bits // 2))
    dealt = queries.select("query").distinct().withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    place = dealt.withColumn("n", F.row_number().over(Window.partitionBy("block").orderBy("query")) - 1)
    part = F.concat_ws(":", "block", F.floor(F.col("n") / bits)).alias("__part")
    return place.groupBy(part).agg(F.array_sort(F.collect_list(F.struct("n", "query"))).getField("query").alias("queries"))


def bit_hops(connected: DataFrame, anchors: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(__part, node, hops, __bits) of a walk without strengths for all queries at once, and the ``numbered`` queries.

    A node has a row for each part of the queries and each distance, whose bits are the queries that reach it first at that distance. One step is
    one join on the node and a bitwise or that combines before its shuffle; the bits of what was visited are cleared. So rows
    grow with the nodes, not with nodes times queries. The edges are dealt by node once; a step moves what the walk has reached alone.
    """
    connected = keyed(connected.select("src", "dst"), "src", "connections")
    names = materialize(numbered(anchors), "queries")
    bit = F.expr("shiftleft(1L, n)")
    told = names.select("__part", F.posexplode("queries").alias("n", "query"))
    start = anchors.join(told, "query").groupBy("__part", "node").agg(F.bit_or(bit).alias("__bits"))
    seen = materialize(start.withColumns({"visited": F.col("__bits"), "hops": F.lit(0)}), "level")
    levels = [seen.select("__part", "node", "hops", "__bits")]
    for hop in range(1, depth + 1):
        step = seen.where("__bits <> 0").select("__part", F.col("node").alias("src"), "__bits").hint("shuffle_hash").join(connected, "src").groupBy("__part", F.col("dst").alias("node")).agg(F.bit_or("__bits").alias("reached"))
        met = step.join(seen.select("__part", "node", "visited"), ["__part", "node"], "full_outer" if hop < depth else "left")
        before, reached = F.coalesce("visited", F.lit(0).cast("long")), F.coalesce("reached", F.lit(0).cast("long"))
        fresh = reached.bitwiseAND(F.bitwise_not(before))
        seen = met.select("__part", "node", fresh.alias("__bits"), before.bitwiseOR(reached).alias("visited"), F.lit(hop).alias("hops"))
        seen = materialize(seen, "level") if hop < depth else seen  # the last one is read once
        levels.append(seen.where("__bits <> 0").select("__part", "node", "hops", "__bits"))
    return reduce(DataFrame.unionByName, levels), names


def by_query(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` (__part, bits, ...) once for each of their queries: (query, ...)."""
    known = F.broadcast(names) if names.count() <= FEW else names
    hit = F.filter(F.transform("queries", lambda q, i: F.when(F.getbit("__bits", i) == 1, F.struct(q.alias("query")))), lambda q: q.isNotNull())
    return rows.join(known, "__part").select(F.inline(hit), *[c for c in rows.columns if c not in ("__part", "__bits")])


def hops(connected: DataFrame, anchors: DataFrame, depth: int = 3) -> DataFrame:
    """(query, node, hops) of all nodes within ``depth`` of a query's anchors: a walk without strengths."""
    return by_query(*bit_hops(connected, anchors, depth)).select("query", "node", "hops")


def walk(adjacent: DataFrame, anchors: DataFrame, depth: int = 3, paths: bool = False) -> DataFrame:
    """(query, node, hops, strength), with ``paths`` also path, of all nodes within ``depth`` of a query's anchors.

    A node is reached in the fewest hops, there with the greatest product of
    strengths, there by the least path. One level is one equi-join, one grouped maximum
    that combines before its shuffle, and one anti-join, for all queries at once; levels
    are written, so lineage stays short. ``adjacent`` may hold parallel edges.
    """
    adjacent = keyed(adjacent.select("src", "dst", "strength"), "src", "adjacency")
    return _paths(adjacent, anchors, depth) if paths else _strongest(adjacent, anchors, depth)


def _paths(adjacent: DataFrame, anchors: DataFrame, depth: int) -> DataFrame:
    start = anchors.select("query", "node").distinct().select("query", "node", F.lit(0).alias("hops"), F.lit(1.0).alias("strength"), F.array("node").alias("path"))
    levels = [materialize(start, "level")]
    for hop in range(1, depth + 1):
        visited = reduce(DataFrame.unionByName, levels).select("query", F.col("node").alias("dst"))
        step = levels[-1].withColumnRenamed("node", "src").withColumnRenamed("strength", "before").hint("shuffle_hash").join(adjacent, "src")
        product = F.col("before") * F.col("strength")
        best = F.min(F.struct((-product).alias("minus"), F.concat("path", F.array("dst")).alias("path"))).alias("best")
        reached = step.groupBy("query", "dst").agg(best).select("query", "dst", (-F.col("best.minus")).alias("strength"), F.col("best.path").alias("path"))
        reached = reached.join(visited, ["query", "dst"], "left_anti").withColumnRenamed("dst", "node").withColumn("hops", F.lit(hop))
        levels.append(materialize(reached.select(*start.columns), "level"))
    return reduce(DataFrame.unionByName, levels)


#: Queries whose strengths share a row; those that a walk's last step takes at once where more nodes than that have been reached.
WIDE, NARROW, LARGE = 32, 8, 1 << 19


def _strongest(adjacent: DataFrame, anchors: DataFrame, depth: int) -> DataFrame:
    """A row a node and part of the queries, with a column of strengths for each query's place: a step moves a row an edge, not one a query."""
    names = materialize(numbered(anchors, WIDE), "queries")
    places = range(names.agg(F.max(F.size("queries"))).first()[0] or 1)
    told = names.select("__part", F.posexplode("queries").alias("n", "query"))
    own = [f"s{i}" for i in places]
    bits = lambda cols: reduce(lambda a, b: a.bitwiseOR(b), [F.when(c.isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in cols.items()])
    start = anchors.join(told, "query").groupBy("__part", "node").agg(*[F.max(F.when(F.col("n") == i, 1.0)).alias(c) for i, c in enumerate(own)])
    seen = materialize(start.withColumn("visited", bits({i: F.col(c) for i, c in enumerate(own)})).withColumn("hops", F.lit(0)), "level")
    levels, found = [seen], lambda df, part: reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in part])
    for hop in range(1, depth + 1):
        # Of many nodes the last step, whose rows are the most, is made for some queries after the others: the disk holds what those shuffle.
        many = hop == depth and len(own) > NARROW and seen.count() > LARGE
        before, steps = F.coalesce("visited", F.lit(0).cast("long")), []
        for at in range(0, len(own), NARROW if many else len(own)):
            part = own[at : at + NARROW] if many else own
            front = seen.where(found(seen, part)).select("__part", F.col("node").alias("src"), *part)
            step = front.hint("shuffle_hash").join(adjacent, "src").groupBy("__part", F.col("dst").alias("node")).agg(*[F.max(F.col(c) * F.col("strength")).alias(f"r{c}") for c in part])
            met = step.join(seen.select("__part", "node", "visited"), ["__part", "node"], "full_outer" if hop < depth else "left")
            fresh = {c: F.when(F.getbit(before, F.lit(own.index(c))) == 0, F.col(f"r{c}")) if c in part else F.lit(None).cast("double") for c in own}
            step = met.select("__part", "node", *[f.alias(c) for c, f in fresh.items()], before.bitwiseOR(bits({own.index(c): F.col(f"r{c}") for c in part})).alias("visited"), F.lit(hop).alias("hops"))
            step = materialize(step.where(found(step, part)), "level") if many else step
            steps.append(step)
        seen = materialize(steps[0], "level") if hop < depth else seen  # the last one is read once
        levels += [seen] if hop < depth else steps
    known = F.broadcast(names) if names.count() <= FEW else names
    rows = reduce(DataFrame.unionByName, [df.where(found(df, own)).select("__part", "node", "hops", F.array(*own).alias("all")) for df in levels])
    each = F.filter(F.transform("queries", lambda q, i: F.struct(q.alias("query"), F.get("all", i).alias("strength"))), lambda x: x["strength"].isNotNull())
    return rows.join(known, "__part").select("node", "hops", F.inline(each)).select("query", "node", "hops", "strength")


def reach(edges: DataFrame, anchors: DataFrame, depth: int | None = None) -> DataFrame:
    """(query, node, hops) along directed edges (source to target), nearest first and cycle-safe; without ``depth`` to the end of every way."""
    edges = keyed(edges.select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct(), "src", "edges")
    levels, hop = [materialize(anchors.select("query", "node", F.lit(0).alias("hops")).distinct(), "level")], 0
    while depth is None or hop < depth:
        hop += 1
        step = levels[-1].select("query", F.col("node").alias("src")).hint("shuffle_hash").join(edges, "src").select("query", F.col("dst").alias("node")).distinct()
        if depth is None and hop & (hop - 1) == 0:  # what was met before is let go after 1, 2, 4, 8 ... steps, so a cycle ends and few levels are read again
            step = step.join(reduce(DataFrame.unionByName, levels).select("query", "node"), ["query", "node"], "left_anti")
        levels.append(materialize(step.withColumn("hops", F.lit(hop)), "level"))
        if levels[-1].isEmpty():
            break
    # A node met again further on counts at its nearest; a level holds a query's node once, so ``depth`` or the next power of two bounds what a cycle repeats.
    return reduce(DataFrame.unionByName, levels).groupBy("query", "node").agg(F.min("hops").alias("hops"))


def lineage(edges: DataFrame, ids: DataFrame, depth: int = 10) -> DataFrame:
    """What each id (query, node) was derived from."""
    return reach(edges.where("edge_type = 'derived_from'"), ids, depth).where("hops > 0")


def truncated(edges: DataFrame, ids: DataFrame, depth: int = 10) -> DataFrame:
    """(query, truncated): whether a lineage of ``depth`` steps leaves origins further back unnamed."""
    beyond = reach(edges.where("edge_type = 'derived_from'"), ids, depth + 1).where(F.col("hops") > depth).select("query").distinct().withColumn("more", F.lit(True))
    return ids.select("query").distinct().join(beyond, "query", "left").select("query", F.coalesce("more", F.lit(False)).alias("truncated"))


def forget_preview(edges: DataFrame, ids: DataFrame, depth: int | None = None) -> DataFrame:
    """All that was derived from each id, directly or not; ``depth`` is only for who asks for the first steps."""
    turned = edges.where("edge_type = 'derived_from'").select(F.col("target").alias("source"), F.col("source").alias("target"))
    return reach(turned, ids, depth).where("hops > 0")


def subgraph(edges: DataFrame, anchors: DataFrame, depth: int = 2) -> DataFrame:
    """(query, edge columns): edges that touch any node within ``depth``; they may point beyond."""
    reached, names = bit_hops(connections(edges), anchors, depth)
    inside = materialize(reached.groupBy("__part", "node").agg(F.bit_or("__bits").alias("__bits")), "inside")
    end = lambda c, name: inside.select("__part", F.col("node").alias(c), F.col("__bits").alias(name))
    none = F.lit(0).cast("long")
    first = edges.join(end("source", "__s"), "source").join(end("target", "__t"), ["__part", "target"], "left")
    second = edges.join(end("target", "__t"), "target").join(end("source", "__s"), ["__part", "source"], "left_anti").withColumn("__s", none)
    rows = first.unionByName(second).withColumn("__bits", F.col("__s").bitwiseOR(F.coalesce("__t", none)))
    return by_query(rows.select("__part", "__bits", *edges.columns), names).select("query", *edges.columns)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    ends = edges.select(F.col("source").alias("node")).union(edges.select("target"))
    return nodes.join(ends, "node", "left_anti")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is not among ``nodes`` (distinct): one left join for each end, and no distinct."""
    known = lambda c, flag: nodes.select(F.col("node").alias(c), F.lit(True).alias(flag))
    marked = edges.join(known("source", "__s"), "source", "left").join(known("target", "__t"), "target", "left")
    return marked.where("__s is null or __t is null").select(*edges.columns)


def tensions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) pairs of live nodes that conflict, each pair once."""
    live = nodes.where("invalidated_at is null").select("node")
    pairs = edges.where("edge_type = 'conflicts_with'").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return pairs.join(live.withColumnRenamed("node", "a"), "a", "left_semi").join(live.withColumnRenamed("node", "b"), "b", "left_semi")


def propagate(adjacent: DataFrame, nodes: DataFrame, sources: DataFrame, hops: int = 2) -> DataFrame:
    """(node, confidence) raised from ``sources``: a tenth less at every hop; only raised nodes pass it on."""
    adjacent = keyed(adjacent.select("src", "dst"), "src", "adjacency")
    known = nodes.select("node", "confidence")
    front = sources.join(known, "node").select("node", "confidence")
    raised = []
    for hop in range(1, hops + 1):
        given = front.withColumnRenamed("node", "src").hint("shuffle_hash").join(adjacent, "src").groupBy(F.col("dst").alias("node")).agg(F.max(F.col("confidence") * (1 - 0.1 * hop)).alias("given"))
        front = materialize(known.join(given, "node").where("given > confidence").select("node", F.col("given").alias("confidence")), "raised")
        raised.append(front)
    return reduce(DataFrame.unionByName, raised).groupBy("node").agg(F.max("confidence").alias("confidence"))


def coded(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, id) of all ends of ``edges``, and their ``adjacency`` in ids, dealt by dst. Ids are whole numbers in the order of the nodes, so ties fall as among the nodes."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("node")).where("node is not null").distinct()
    names = materialize(ends.repartitionByRange(parts, "node").sortWithinPartitions("node").select("node", F.monotonically_increasing_id().alias("id")), "names")
    told = edges.select("source", "target", "weight")
    for end in ("source", "target"):
        side = names.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id"))
        told = told.join(side.hint("shuffle_hash"), end).drop(end).withColumnRenamed(f"{end}_id", end)
    told = materialize(told, "told")
    # Edges are dealt before parallel ones are merged, so that they move once.
    adjacent = keyed(strengths(told).repartition(parts, "dst").groupBy("src", "dst").agg(F.max("strength").alias("strength")), "dst", "adjacency", dealt=True)
    discard(told)
    return names, adjacent


def named(rows: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with the nodes that bear the ids in ``columns``."""
    for c in columns:
        rows = rows.join(names.select(F.col("id").alias(c), F.col("node").alias("__node")), c).drop(c).withColumnRenamed("__node", c)
    return rows


def communities(adjacent: DataFrame, max_rounds: int = 1000, dealt: bool = False) -> DataFrame:
    """(node, community) by weighted label propagation: the neighbour label of greatest weight, ties to the least.

    Runs until no label moves; labels only fall, so it ends. The edges are dealt by the voting end once, so a round moves the labels to them
    and sums of votes back; a hub's votes are summed before they are shuffled. Sums count to nine digits, so their order decides nothing.
    Labels of a round go when the next ones are written, so the disk holds the edges and one round. ``dealt`` tells that ``adjacent`` is ``coded``'s.
    """
    adjacent = adjacent if dealt else keyed(adjacent.select("src", "dst", "strength"), "dst", "adjacency")
    labels = materialize(adjacent.groupBy(F.col("dst").alias("node")).agg(F.min("dst").alias("community")), "labels")
    for _ in range(max_rounds):
        votes = adjacent.join(labels.select(F.col("node").alias("dst"), "community").hint("shuffle_hash"), "dst").groupBy("src", "community").agg(F.round(F.sum("strength"), 9).alias("weight"))
        best = votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct((-F.col("weight")).alias("w"), "community")).alias("b")).select("node", F.col("b.community").alias("next"))
        moved = best.join(labels.select("node", "community").hint("shuffle_hash"), "node").select("node", F.least("community", "next").alias("community"), (F.col("next") < F.col("community")).alias("moved"))
        before, labels = labels, materialize(moved, "labels")
        discard(before)
        if labels.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"labels still move after {max_rounds} rounds")
    return labels.select("node", "community")


def modularity(adjacent: DataFrame, members: DataFrame) -> float:
    """The share of weight inside communities above what the nodes' weights alone would put there.

    ``adjacent`` holds both directions of every edge; without any weight it is 0.
    """
    side = lambda end, c: members.select(F.col("node").alias(end), F.col("community").alias(c))
    joined = adjacent.join(side("src", "c1"), "src").join(side("dst", "c2"), "dst")
    sums = joined.groupBy("c1").agg(F.sum("strength").alias("whole"), F.sum(F.when(F.col("c1") == F.col("c2"), F.col("strength"))).alias("inside"))
    row = sums.agg(F.sum("whole").alias("m"), F.sum("inside").alias("i"), F.sum(F.col("whole") * F.col("whole")).alias("s")).first()
    return (row["i"] or 0.0) / row["m"] - row["s"] / row["m"] ** 2 if row["m"] else 0.0


def _moved(adjacent: DataFrame, rounds: int) -> DataFrame:
    """(node, community) after nodes have moved, a hashed half of them in each round, to where modularity gains most."""
    degrees = adjacent.groupBy(F.col("src").alias("node")).agg(F.sum("strength").alias("k"))
    state = materialize(degrees.select("node", "k", F.col("node").alias("community")), "communities")
    total = state.agg(F.sum("k")).first()[0]
    between = adjacent.where("src <> dst")
    for i in range(rounds):
        there = between.join(state.select(F.col("node").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("strength").alias("w"))
        choices = there.unionByName(state.select("node", "community", F.lit(0.0).alias("w"))).groupBy("node", "community").agg(F.sum("w").alias("w"))
        own = state.select("node", "k", F.col("community").alias("own"))
        weights = state.groupBy("community").agg(F.sum("k").alias("all"))
        stays = F.col("community") == F.col("own")
        others = F.col("all") - F.when(stays, F.col("k")).otherwise(0.0)
        scored = choices.join(own, "node").join(weights, "community").withColumn("gain", F.round(F.col("w") - F.col("k") * others / total, 9))
        best = scored.groupBy("node", "k", "own").agg(F.min(F.struct((-F.col("gain")).alias("g"), (~stays).alias("moves"), "community")).alias("b"))
        turn = F.pmod(F.xxhash64("node", F.lit(i)), F.lit(2)) == 0
        state = materialize(best.select("node", "k", F.when(turn, F.col("b.community")).otherwise(F.col("own")).alias("community"), F.col("b.moves").alias("wants")), "communities")
        if state.where("wants").isEmpty():
            break
    return state.select("node", "community")


def modular_communities(adjacent: DataFrame, rounds: int = 12, levels: int = 6) -> DataFrame:
    """(node, community) by moves that raise modularity, then the same between communities, while it still rises.

    ``adjacent`` holds both directions of every edge. Every node gets a community; a node without weighted edges is not
    in ``adjacent``. ``rounds`` and ``levels`` bound the search, not the graph: a level that does not raise modularity is
    dropped, so what is returned is never worse than the level before. A community bears the name of one of its nodes'.
    """
    level = adjacent = materialize(adjacent.select("src", "dst", "strength"), "adjacency")
    best, found = None, 0.0
    for _ in range(levels):
        step = _moved(level, rounds)
        members = step if best is None else best.select("node", F.col("community").alias("c")).join(step.select(F.col("node").alias("c"), "community"), "c").select("node", "community")
        members = materialize(members, "members")
        score = modularity(adjacent, members)
        if best is not None and score <= found + 1e-9:
            break
        best, found = members, score
        side = lambda end: step.select(F.col("node").alias(end), F.col("community").alias(f"{end}_c"))  # noqa: B023, E731
        merged = level.join(side("src"), "src").join(side("dst"), "dst").groupBy(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).agg(F.sum("strength").alias("strength"))
        level = materialize(merged, "level")
    return best


def community_rollup(members: DataFrame, adjacent: DataFrame, top: int = 5) -> DataFrame:
    """(community, size, centroid, top_labels): the centroid has the greatest weighted degree inside."""
    inside = adjacent.join(members.select(F.col("node").alias("dst"), F.col("community").alias("c2")), "dst").join(members.select(F.col("node").alias("src"), F.col("community").alias("c1")), "src").where("c1 = c2")
    degree = inside.groupBy(F.col("src").alias("node")).agg(F.sum("strength").alias("degree"))
    ranked = members.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "node"))
    first = ranked.withColumn("place", place).where(F.col("place") <= top).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("place", "node"))).getField("node").alias("top_labels"))
    sizes = ranked.groupBy("community").agg(F.count("*").alias("size"))
    return sizes.join(first, "community").select("community", "size", F.element_at("top_labels", 1).alias("centroid"), "top_labels")
