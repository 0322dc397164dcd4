"""Prefix trie of conversations (operator 11) with totals of subtrees by centroid decomposition.

A node of depth d stands for all conversations that begin with the same d turns (role and text); the root has none. Turns are told
apart by two 64-bit hashes; the key of a prefix is a pair of polynomials of its turns' hashes modulo 2**64, which
is built by running sums over turns that are range-sorted by conversation, so a conversation of any length is spread over tasks and
what a task border cuts is carried over (a row a task). Nodes are groups of keys.

Totals of subtrees (leaves, saved tokens) come from a centroid decomposition of the parent edges. In every component the
centroid is the deepest node that has more than half of the component below it; the nodes with more than half are just the path
from the component's top to it. The total of the centroid's own subtree is aggregated once and added to that path; then the
centroid goes, and its children's subtrees and what is above become components of at most half the size. So the rounds grow with
the logarithm of the nodes, however deep or wide the trie is. Components above ``HOLD`` nodes are split by
joins over all of them at once (the sizes of the first round are summed from the conversations' own stretches of nodes, and the
child under a centroid is found by one equi-join on conversation and depth); smaller ones are taken to their end within a task.

Turns are ordered by turn (null first), then role, then text; null role or text is empty; repeated rows are turns of
their own. Rows without conversation id belong to no conversation and are left out. An empty table has no node, not even a root. Texts may be of any length;
columns other than the four named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import common

#: Components of at most so many nodes are decomposed within a task.
HOLD = 1 << 14
#: Components above that size are broadcast up to this number, with a row each.
FEW = 10_000
#: Bytes of ids that are hashed at once.
CHUNK = 1 << 16
#: Bases of the two polynomials.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: np.ndarray) -> np.ndarray:
    """``base ** n`` modulo 2**64."""
    out, n, b = np.ones(len(n), np.uint64), n.astype(np.uint64), base
    while n.any():
        out[(n & np.uint64(1)).astype(bool)] *= np.uint64(b)
        n, b = n >> np.uint64(1), b * b & 0xFFFFFFFFFFFFFFFF
    return out


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each row in its conversation and running sums, within a sorted partition."""
    last, count, sums = None, 0, [np.uint64(0), np.uint64(0)]
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        starts = np.r_[0, np.flatnonzero(np.diff(conv)) + 1]
        lens = np.diff(np.r_[starts, len(conv)])
        goes_on = last is not None and conv[0] == last
        at = np.arange(len(conv)) - np.repeat(starts, lens)
        if goes_on:
            at[: lens[0]] += count
        columns = []
        for k in range(2):
            each = batch.column(k + 1).to_numpy().view(np.uint64) * _powers(BASES[k], at)
            total = np.cumsum(each)
            before = np.repeat((total - each)[starts], lens)
            s = total - before
            if goes_on:
                s[: lens[0]] += sums[k]
            sums[k] = s[-1]
            columns += [s, s - each]
        last, count = conv[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at), *(pa.array(c.view(np.int64)) for c in columns), *batch.columns[3:]], ["conv_id", "at", "a", "pa", "b", "pb", *batch.schema.names[3:]])


def _carry(borders: dict[int, tuple[int, int, int, int]]):
    """Adds to the rows of a conversation that began in an earlier partition what it had there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, part, at = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("conv_id", "part", "at"))
            sums = {c: batch.column(batch.schema.get_field_index(c)).to_numpy().view(np.uint64).copy() for c in ("a", "pa", "b", "pb")}
            at = at.copy()
            for p in np.unique(part).tolist():
                if p in borders:
                    first, n, *before = borders[p]
                    rows = (part == p) & (conv == first)
                    at[rows] += n
                    for k, names in enumerate((("a", "pa"), ("b", "pb"))):
                        for c in names:
                            sums[c][rows] = sums[c][rows] * np.uint64(pow(BASES[k], n, 1 << 64)) + np.uint64(before[k])
            new = {"at": pa.array(at), **{c: pa.array(v.view(np.int64)) for c, v in sums.items()}}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], batch.schema.names)

    return run


def scan(rows: DataFrame, order: list, keep: list[str], name: str) -> DataFrame:
    """(conv_id, at, a, pa, b, pb, ``keep``) of ``rows`` (conv_id, a, b, ...) sorted by conversation and ``order``.

    ``at`` is a row's place in its conversation from 0, (a, b) the key of all rows up to it, (pa, pb) that of those before it. At
    most one conversation a partition goes on from the partitions before; its sums there are collected, a row a partition.
    """
    by = [F.col("conv_id"), *order]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "a", "b", *keep, F.spark_partition_id().alias("part"))
    kinds = dict(dealt.dtypes)
    ddl = "conv_id long, at long, a long, pa long, b long, pb long, " + ", ".join(f"`{c}` {kinds[c]}" for c in [*keep, "part"])
    local = common.materialize(dealt.mapInArrow(_running, ddl), name)
    edges = local.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    ends = local.join(F.broadcast(edges), "part").where("conv_id = low or conv_id = high")
    ends = ends.groupBy("part", "conv_id").agg(F.max("at").alias("at"), F.max_by(F.struct("a", "b"), "at").alias("s")).orderBy("conv_id", "part").collect()
    borders, conv = {}, None
    for r in ends:
        if r["conv_id"] != conv:
            conv, n, sums = r["conv_id"], 0, [0, 0]
        else:
            borders[r["part"]] = (conv, n, *sums)
        sums = [(s * pow(b, n, 1 << 64) + before) % (1 << 64) for s, b, before in zip(r["s"], BASES, sums, strict=True)]
        n += r["at"] + 1
    return local.mapInArrow(_carry(borders), ddl).drop("part") if borders else local.drop("part")


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(conv_id, at, a, b, chars) of every turn: its place, its hashes, its code points; with ``keep_text`` also role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    own = [F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "text", "role").alias("h2"), F.length("text").cast("long").alias("chars")]
    zero = F.lit(0).cast("long")
    found = scan(rows.withColumns({"a": zero, "b": zero, **dict(zip(("h1", "h2", "chars"), own, strict=True))}), [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], ["h1", "h2", "chars", *["role", "text"] * keep_text], "turns")
    return common.materialize(found.select("conv_id", "at", F.col("h1").alias("a"), F.col("h2").alias("b"), "chars", *["role", "text"] * keep_text), "sequences")


def prefixes(found: DataFrame, convs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, chars): of every conversation all prefixes, the empty one (0, 0) first.

    ``found`` has the turns (conv_id, a, b, chars, and ``order``), ``convs`` every conversation once.
    """
    order = order or ["at"]
    zero = F.lit(0).cast("long")
    top = convs.select("conv_id", zero.alias("a"), zero.alias("b"), zero.alias("chars"), *[F.lit(-1).cast("long").alias(c) for c in order])
    rows = top.unionByName(found.select("conv_id", "a", "b", "chars", *[F.col(c).cast("long").alias(c) for c in order]))
    return common.materialize(scan(rows, [F.col(c) for c in order], ["chars"], "prefixes").withColumnRenamed("at", "depth"), "prefixes")


def _roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of the nodes of whole components, which arrive one after another."""

    def out(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, b, up_a, up_b, ca, cb, depth, leaves, saved = rows
        place = {key: i for i, key in enumerate(zip(a.tolist(), b.tolist(), strict=True))}
        top = (a == ca) & (b == cb)
        parent = np.array([-1 if t else place[key] for t, key in zip(top.tolist(), zip(up_a.tolist(), up_b.tolist(), strict=True), strict=True)], np.int64)
        total = decompose(parent, depth, np.stack([leaves, saved], axis=1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, total[:, 0], total[:, 1])], ["a", "b", "leaves", "saved"])

    rest = None
    for batch in batches:
        now = [c.to_numpy() for c in batch.columns]
        rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
        borders = np.flatnonzero((np.diff(rest[4]) != 0) | (np.diff(rest[5]) != 0)) + 1
        if len(borders) and borders[-1] >= HOLD:
            yield out([x[: borders[-1]] for x in rest])
            rest = [x[borders[-1] :] for x in rest]
    if rest is not None and len(rest[0]):
        yield out(rest)


def decompose(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the subtree of each node of a forest (``parent``, -1 for a top), by centroids.

    All components are split at once; nodes are numbered in preorder, so a subtree is a stretch of numbers.
    """
    n = len(parent)
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)
    full = np.ones(n, np.int64)
    for level in reversed(levels):
        inner = level[parent[level] >= 0]
        np.add.at(full, parent[inner], full[inner])
    siblings = np.lexsort((np.arange(n), parent))
    ahead = np.cumsum(full[siblings]) - full[siblings]
    first = np.searchsorted(parent[siblings], parent[siblings])
    offset = np.empty(n, np.int64)
    offset[siblings] = ahead - ahead[first]
    pre = np.zeros(n, np.int64)
    for level in levels:
        p = parent[level]
        pre[level] = offset[level] + np.where(p >= 0, pre[p] + 1, 0)
    order = np.argsort(pre)
    up, full, values = np.where(parent[order] >= 0, pre[parent[order]], -1), full[order], values[order]
    edges = np.sort(up[up >= 0] * n + np.flatnonzero(up >= 0))
    me = np.arange(n)
    comp = np.maximum.accumulate(np.where(up < 0, me, 0))
    size, left, out = full.copy(), np.ones(n, bool), np.zeros_like(values)
    while left.any():
        path = np.flatnonzero(left & (2 * size > size[comp]))
        centroid = np.zeros(n, np.int64)
        np.maximum.at(centroid, comp[path], path)
        mine = centroid[comp]
        below = np.flatnonzero(left & (me > mine) & (me < mine + full[mine]))
        total = np.zeros_like(values)
        np.add.at(total, comp[below], values[below])
        out[path] += total[comp[path]] + values[mine[path]]
        gone = np.unique(mine[path])
        cut = size[mine[path]]
        size[path] -= cut
        left[gone] = False
        comp[below] = edges[np.searchsorted(edges, mine[below] * n + below, "right") - 1] % n
    back = np.empty_like(out)
    back[order] = out
    return back


def subtree_totals(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, leaves, saved): sums of the columns ``leaf`` and ``saved`` of ``nodes`` over every node's subtree.

    ``nodes`` is a written table (a, b, pa, pb, conv_id, depth, leaf, saved), ``rows`` the prefixes.
    """
    count = nodes.count()
    parts: list[DataFrame] = []
    zero = F.lit(0).cast("long")
    active = nodes.select("a", "b", "pa", "pb", "conv_id", "depth", "leaf", "saved", zero.alias("ca"), zero.alias("cb"))
    if count > HOLD:
        led = nodes.groupBy("conv_id").agg(F.min("depth").alias("first"))
        ends = rows.groupBy("conv_id").agg(F.max("depth").alias("last")).join(led, "conv_id")
        size = rows.join(ends, "conv_id").groupBy("a", "b").agg(F.sum(F.col("last") - F.greatest("first", "depth") + 1).alias("size"))
        active = common.materialize(active.join(size, ["a", "b"]), "active")
        steps = rows.select("conv_id", (F.col("depth") - 1).alias("at"), F.col("pa").alias("xa"), F.col("pb").alias("xb"), F.col("a").alias("na"), F.col("b").alias("nb")).where("at >= 0")
        while True:
            large = common.materialize(active.where("a = ca and b = cb").where(F.col("size") > HOLD).select("ca", "cb", F.col("size").alias("all")), "large")
            n = large.count()
            small = (lambda df: F.broadcast(df)) if n <= FEW else (lambda df: df)
            parts.append(active.join(small(large), ["ca", "cb"], "left_anti").drop("size") if n else active.drop("size"))
            if not n:
                break
            mine = active.join(small(large), ["ca", "cb"])
            path = F.col("size") * 2 > F.col("all")
            split = mine.where(path).groupBy("ca", "cb").agg(F.min_by(F.struct("a", "b", "depth", "size", "leaf", "saved"), "size").alias("c"))
            split = common.materialize(split.select("ca", "cb", *[F.col(f"c.{c}").alias(f"x{c}") for c in ("a", "b", "depth", "size", "leaf", "saved")]), "centroids")
            met = mine.join(small(split), ["ca", "cb"])
            deep = met.where("depth > xdepth").join(steps.select("conv_id", F.col("at").alias("xdepth"), F.col("xa").alias("ya"), F.col("xb").alias("yb"), "na", "nb"), ["conv_id", "xdepth"])
            under = (F.col("ya") == F.col("xa")) & (F.col("yb") == F.col("xb"))
            columns = ["a", "b", "pa", "pb", "conv_id", "depth", "leaf", "saved", "size", "ca", "cb", "all", "xa", "xb", "xsize", "xleaf", "xsaved"]
            deep = deep.select(*columns, F.when(under, F.col("na")).alias("na"), F.when(under, F.col("nb")).alias("nb"))
            rest = met.where("depth <= xdepth").select(*columns, F.lit(None).cast("long").alias("na"), F.lit(None).cast("long").alias("nb"))
            met = common.materialize(deep.unionByName(rest), "split")
            below = met.where("na is not null").groupBy("ca", "cb").agg(F.sum("leaf").alias("sl"), F.sum("saved").alias("ss"))
            on_path = met.where(path).join(small(below), ["ca", "cb"], "left")
            parts.append(on_path.select("a", "b", (F.coalesce("sl", zero) + F.col("xleaf")).alias("leaves"), (F.coalesce("ss", zero) + F.col("xsaved")).alias("saved")))
            kept = met.where("not (a = xa and b = xb)")
            now = F.when(F.col("na").isNull() & path, F.col("size") - F.col("xsize")).otherwise(F.col("size"))
            active = common.materialize(kept.select("a", "b", "pa", "pb", "conv_id", "depth", "leaf", "saved", F.coalesce("na", "ca").alias("ca"), F.coalesce("nb", "cb").alias("cb"), now.alias("size")), "active")
    else:
        parts.append(active)
    out = None
    for p in parts:
        if "leaf" in p.columns:
            whole = p.select("a", "b", "pa", "pb", "ca", "cb", "depth", F.col("leaf").cast("long"), "saved").repartition("ca", "cb").sortWithinPartitions("ca", "cb", "depth")
            p = whole.mapInArrow(_roll, "a long, b long, leaves long, saved long")
        out = p if out is None else out.unionByName(p)
    return out.groupBy("a", "b").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, first, ids): the sorted ids of a node as text, in pieces."""
    key, ids, size = None, [], 0
    rows: list[tuple] = []

    def flush():
        nonlocal ids, size
        if ids:
            rows.append((*key, ids[0], ",".join(map(str, ids)).encode()))
        ids, size = [], 0

    def batch_of():
        a, b, first, text = zip(*rows, strict=True)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(first, pa.int64()), pa.array(text, pa.binary())], ["a", "b", "first", "ids"])

    for batch in batches:
        for a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a, b) != key or size >= CHUNK:
                flush()
                key = a, b
            ids.append(conv)
            size += 8
        if len(rows) >= 10_000:
            yield batch_of()
    flush()
    if rows:
        yield batch_of()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sha): SHA-256 of each node's pieces, which follow one another; one piece is held at a time."""
    key, digest, keys, out = None, None, [], []
    for batch in batches:
        for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (a, b) != key:
                if key is not None:
                    keys.append(key)
                    out.append(digest.hexdigest())
                key, digest = (a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(out, pa.string())], ["a", "b", "sha"])
        keys, out = [], []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([digest.hexdigest()])], ["a", "b", "sha"])


def end_digests(rows: DataFrame) -> DataFrame:
    """(a, b, sha) of every node where conversations end: SHA-256 of their ids in numeric order, comma-joined.

    Such a hash is sequential: ids are sorted and joined to pieces by all tasks, and the pieces of one node pass one task, one at a time.
    """
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("a", "b"), "depth").alias("s")).select("s.a", "s.b", "conv_id")
    by = ["a", "b", "conv_id"]
    pieces = last.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_chunks, "a long, b long, first long, ids binary")
    dealt = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first").select("a", "b", "ids")
    return dealt.mapInArrow(_digests, "a long, b long, sha string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of ``rows`` (prefixes): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    groups = rows.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("depth", "pa", "pb", "chars")])
    nodes = common.materialize(groups, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = common.materialize(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "nodes")
    parents = nodes.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    inner = common.hot_join(nodes.where("depth > 0").select("a", "b", "pa", "pb"), parents, ["pa", "pb"], "n_children", nodes.count()).select("a", "b", "parent_conv_id")
    totals, digests = subtree_totals(nodes, rows), end_digests(rows)
    full = nodes.join(totals.withColumnRenamed("saved", "saved_tokens"), ["a", "b"]).join(inner, ["a", "b"], "left").join(digests, ["a", "b"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), "saved_tokens", F.coalesce("sha", none).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", texts: bool = True) -> DataFrame:
    """The trie of the conversations as they are; with ``texts`` each node also has the role and text of its last turn."""
    found = sequences(turns, conv_col, turn_col, role_col, text_col, keep_text=texts)
    nodes = trie(prefixes(found, found.select("conv_id").distinct()))
    last = found.select("conv_id", (F.col("at") + 1).alias("depth"), "role", "text") if texts else None
    return nodes.join(last, ["conv_id", "depth"], "left") if texts else nodes


#: A conversation takes its first turns from that of the full hundred below, up to five.
HUNDRED, HEADS = 100, 6


def rebuilt(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of every conversation c: the first h of conversation c - c % 100, then its own after its first h; h is crc32(c) % 6.

    Returned are (conv_id, kind, at, a, b, chars) and all conversations. At most five turns of a head conversation are gathered in a row.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    convs = common.materialize(found.select("conv_id").distinct(), "convs")
    heads = found.where((F.col("conv_id") % HUNDRED == 0) & (F.col("at") < HEADS - 1)).groupBy(F.col("conv_id").alias("head"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("at", "a", "b", "chars"))).alias("turns"))
    borrowed = convs.withColumn("head", F.col("conv_id") - F.col("conv_id") % HUNDRED).join(heads, "head").select("conv_id", F.explode(F.slice("turns", 1, h.cast("int"))).alias("t"))
    kind = lambda k: F.lit(k).cast("long").alias("kind")
    rows = borrowed.select("conv_id", kind(0), "t.at", "t.a", "t.b", "t.chars").unionByName(found.where(F.col("at") >= h).select("conv_id", kind(1), "at", "a", "b", "chars"))
    return rows, convs


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns, convs = rebuilt(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return trie(prefixes(turns, convs, ["kind", "at"]))


SQL = """
WITH bytes AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
turns AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS head,
  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), bytes),
dealt AS (SELECT c.conv_id, 0 AS kind, pos, r, x FROM convs c JOIN turns t ON t.conv_id = c.head AND t.pos < c.h
  UNION ALL SELECT conv_id, 1, pos, r, x FROM turns JOIN convs USING (conv_id) WHERE pos >= h),
whole AS (SELECT conv_id, coalesce(s, []) AS s FROM convs LEFT JOIN (SELECT conv_id, list({'r': r, 'x': x} ORDER BY kind, pos) AS s FROM dealt GROUP BY conv_id) USING (conv_id)),
prefixes AS (SELECT conv_id, d, s[1:d] AS key, s[1:d - 1] AS up, CASE WHEN d > 0 THEN length(s[d].x) ELSE 0 END AS chars, len(s) = d AS ends FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM whole)),
nodes AS (SELECT key, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
  sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM prefixes GROUP BY key),
counted AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN (SELECT up, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up) k ON k.up = nodes.key),
totals AS (SELECT key[1:e] AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS e FROM counted) GROUP BY key[1:e])
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM counted c JOIN totals USING (key) LEFT JOIN nodes p ON p.key = c.up AND c.depth > 0
"""

QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLES = {"op11_prefix_trie": SQL}
