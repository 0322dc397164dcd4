"""Ranked lexical search (operator 13): exact top-k by a dual tree over items and documents.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. Its weight falls with the number
of documents that hold it, its impact in a document rises with its occurrences and falls with the document's length, and a score
is the sum of weight times impact over an item's distinct terms, all in whole numbers.

Items are taken in blocks of at most ``BLOCK``. For a block the documents are read once into an index of the block's terms
(a row a document: length, term numbers, occurrences), which also gives the counts over all documents. Each task then
searches its part of the index: batches of documents and the block's items are both ordered along principal directions of the items
and grouped into trees whose nodes hold the maximum of each coordinate. A pair of nodes is bounded by the product
of their maxima; it is left out with all its documents and items where the bound is below the weakest k-th score that an item of the node
has so far. Pairs that remain are split, and pairs of leaves are scored exactly. Scores stay below 2**53, so sums of
doubles are exact. Every task starts from the k-th scores that a bounded sample of the index has: they can only be too low,
so they spare work and change no result.

A row of documents is a document; null and empty texts have no term and are never found. Rows that repeat an id are ranked
each, and equal scores by ascending id, null last. Rows with one item id (null is an id too) are one item with the terms of all
its texts; items without terms have no result. Either table may be empty. Only the columns named are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm import common

#: Items that one pass over the documents serves at most.
BLOCK = 1024
#: Documents of a leaf, children of a node, documents of a batch, and cells that the leaves of a batch may fill.
LEAF, FAN, BATCH, CELLS = 16, 8, 8192, 1 << 22
#: Documents in expectation from which the first k-th scores are taken.
SEEDS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of a text: letters in lower case, blanks for what lies between terms.
FLAT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text):
    """The terms of a text as an array column."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN), lambda t: t != "")


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(block, item, term) of every item's distinct terms, written by block; and the number of blocks."""
    rows = items.select(F.col(id_col).alias("item"), F.explode(terms(F.col(text_col))).alias("term")).distinct()
    rows = common.materialize(rows, "item-terms")
    count = rows.agg(F.count_distinct("item"), F.max(F.isnull("item").cast("int"))).first()
    blocks = -(-((count[0] or 0) + (count[1] or 0)) // BLOCK)
    return (rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1)))), blocks)


def index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, ids, tfs) of every document with a term: its length, and the numbers and occurrences of its terms in ``vocabulary``."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            n, ids, tfs = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or b"").translate(FLAT).split()
                n.append(len(words))
                i, c = np.unique(np.fromiter(filter(None, map(known.get, words)), np.int32), return_counts=True)
                ids.append(i)
                tfs.append(c)
            at = np.flatnonzero(n)
            offsets = pa.array(np.r_[0, np.cumsum([len(ids[k]) for k in at])].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, t), *(x[k] for k in at)]).astype(t))) for x, t in ((ids, np.int32), (tfs, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.array(n, np.int64)[at]), *lists], ["doc_id", "n", "ids", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<int>")


def _directions(rows: np.ndarray, ids: np.ndarray, weight: np.ndarray, count: int, n: int) -> list[np.ndarray]:
    """``n`` principal directions of the items (``count`` rows of ``weight`` at ``ids``), centred, by power iteration."""
    found: list[np.ndarray] = []
    for k in range(n):
        u = np.cos(np.arange(count) * (k + 1.7)) + 0.1
        for _ in range(12):
            v = np.bincount(ids, weight[ids] * (u - u.mean())[rows], minlength=len(weight))
            for z in found:
                v -= z * (v @ z)
            v /= np.linalg.norm(v) or 1.0
            u = np.bincount(rows, weight[ids] * v[ids], minlength=count)
        found.append(v)
    return found


def _nested(projections: list[np.ndarray], count: int) -> np.ndarray:
    """An order of rows: by the first projection's eighths, in each by the second's, and so on."""
    group = np.zeros(count, np.int64)
    for p in projections:
        order = np.lexsort((p, group))
        first = np.searchsorted(group[order], group[order])
        size = np.searchsorted(group[order], group[order], "right") - first
        part = np.empty(count, np.int64)
        part[order] = (np.arange(count) - first) * FAN // np.maximum(size, 1)
        group = group * FAN + part
    return np.argsort(group, kind="stable")


@dataclass
class Node:
    """Items (their places in the block), the coordinates where their maximum is not zero, and that maximum."""

    items: np.ndarray
    ids: np.ndarray
    weight: np.ndarray
    children: list[Node] = field(default_factory=list)


def item_tree(lists: list[np.ndarray], weight: np.ndarray) -> tuple[Node, list[np.ndarray]]:
    """A tree whose leaves are the items; and the directions along which it is ordered."""
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    ids = np.concatenate(lists)
    directions = _directions(rows, ids, weight, len(lists), 3)
    order = _nested([np.bincount(rows, (weight * z)[ids], minlength=len(lists)) for z in directions], len(lists))
    level = [Node(np.array([i]), lists[i], weight[lists[i]]) for i in order]
    while len(level) > 1:
        groups = [level[i : i + FAN] for i in range(0, len(level), FAN)]
        level = []
        for g in groups:
            union = np.unique(np.concatenate([x.ids for x in g]))
            level.append(Node(np.concatenate([x.items for x in g]), union, weight[union], g))
    return level[0], directions


@dataclass
class Block:
    """What a task needs of a block: the tree, the weights, the counts over all documents and the first k-th scores."""

    root: Node
    weight: np.ndarray
    directions: list[np.ndarray]
    items: int
    documents: int
    length: int
    k: int
    least: np.ndarray


class Search:
    """The best documents of every item so far; ``add`` searches a batch."""

    def __init__(self, block: Block):
        self.block, self.visited, self.scored = block, 0, 0
        self.floor = np.maximum(block.least, 1.0)
        none = np.zeros(0, np.int64)
        self.best = [(none, none.astype(bool), none) for _ in range(block.items)]

    def add(self, doc: np.ndarray, null: np.ndarray, n: np.ndarray, offsets: np.ndarray, ids: np.ndarray, tf: np.ndarray) -> None:
        b, count = self.block, len(doc)
        m = 10 + (90 * n * b.documents) // b.length
        rows, tf = np.repeat(np.arange(count), np.diff(offsets)), tf.astype(np.int64)
        impact = ((1_000_000_000 * tf) // (1000 * tf + 8 * m[rows])).astype(float)
        order = _nested([np.bincount(rows, impact * (b.weight * z)[ids], minlength=count) for z in b.directions], count)
        self.doc, self.null = doc[order], null[order]
        lens = np.diff(offsets)[order]
        self.offsets = np.r_[0, np.cumsum(lens)]
        at = np.repeat(offsets[:-1][order] - self.offsets[:-1], lens) + np.arange(len(ids))
        self.ids, self.impact = ids[at], impact[at]
        leaves = np.zeros((-(-count // LEAF), len(b.weight)))
        np.maximum.at(leaves, (np.repeat(np.arange(count), lens) // LEAF, self.ids), self.impact)
        self.levels = [leaves]
        while len(self.levels[-1]) > FAN:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN), axis=0))
        self.walk(b.root, len(self.levels) - 1, np.arange(len(self.levels[-1])))

    def walk(self, node: Node, level: int, places: np.ndarray) -> None:
        """Follow the pairs of ``node`` and the documents' nodes ``places`` that can still hold one of the best."""
        self.visited += len(places)
        bound = self.levels[level][np.ix_(places, node.ids)] @ node.weight
        places = places[bound >= self.floor[node.items].min()]
        if not len(places):
            return
        if level == 0 and not node.children:
            self.score(node, places)
            return
        if level:
            places = (places[:, None] * FAN + np.arange(FAN)).ravel()
            level -= 1
            places = places[places < len(self.levels[level])]
        for child in node.children or [node]:
            self.walk(child, level, places)

    def score(self, leaf: Node, places: np.ndarray) -> None:
        """Score the documents of the leaves ``places`` for one item and keep its k best."""
        item = int(leaf.items[0])
        docs = (places[:, None] * LEAF + np.arange(LEAF)).ravel()
        docs = docs[docs < len(self.doc)]
        self.scored += len(docs)
        first, lens = self.offsets[docs], self.offsets[docs + 1] - self.offsets[docs]
        ends = np.cumsum(lens)
        at = np.arange(ends[-1]) + np.repeat(first - (ends - lens), lens)
        weight = np.zeros(len(self.block.weight))
        weight[leaf.ids] = leaf.weight
        total = np.bincount(np.repeat(np.arange(len(docs)), lens), weight[self.ids[at]] * self.impact[at], minlength=len(docs))
        good = total >= self.floor[item]
        found = (total[good].astype(np.int64), self.null[docs[good]], self.doc[docs[good]])
        score, null, doc = (np.concatenate(x) for x in zip(self.best[item], found, strict=True))
        keep = np.lexsort((doc, null, -score))[: self.block.k]
        self.best[item] = score[keep], null[keep], doc[keep]
        if len(keep) == self.block.k:
            self.floor[item] = max(self.floor[item], float(score[keep[-1]]))

    def rows(self) -> pa.RecordBatch:
        score, null, doc = (np.concatenate(x) for x in zip(*self.best, strict=True))
        item = np.repeat(np.arange(len(self.best), dtype=np.int32), [len(s) for s, _, _ in self.best])
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=null), pa.array(score)], ["item", "doc_id", "score"])


def search(indexed: DataFrame, block: Block) -> DataFrame:
    """(item, doc_id, score): of every task the documents that may be among the k best of all."""
    shipped = indexed.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Search(shipped.value)
        most = int(np.clip(CELLS // max(1, len(shipped.value.weight)) * LEAF, LEAF, BATCH))
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                part = batch.slice(a, most)
                ids, tfs = part.column(2), part.column(3)
                offsets = ids.offsets.to_numpy().astype(np.int64)
                found.add(part.column(0).fill_null(0).to_numpy(), part.column(0).is_null().to_numpy(zero_copy_only=False), part.column(1).to_numpy(), offsets - offsets[0], ids.flatten().to_numpy(), tfs.flatten().to_numpy())
        yield found.rows()

    return indexed.mapInArrow(run, "item int, doc_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best documents of each item, with their rank."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", seeds: int = SEEDS) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's ``k`` best documents with a score above 0."""
    spark, kind = docs.sparkSession, items.schema[item_col].dataType
    rows, blocks = item_blocks(items, item_col, item_text)
    out = spark.createDataFrame([], "rank int, doc_id long, score long").select(F.lit(None).cast(kind).alias("item_id"), "rank", "doc_id", "score")
    for b in range(blocks):
        part = rows.where(F.col("block") == b).groupBy("item").agg(F.collect_list("term").alias("terms")).toArrow()
        names, lists = part.column(0), part.column(1).to_pylist()
        words = sorted({t for ts in lists for t in ts})
        vocabulary = {t.encode(): i + 1 for i, t in enumerate(words)}  # number 0 is no term
        if not words:
            continue
        indexed = common.materialize(index(docs, vocabulary, id_col, text_col), "index")
        count = indexed.agg(F.count("*").alias("n"), F.sum("n").alias("length")).first()
        if not count["n"]:
            continue
        held = {r["id"]: r["n"] for r in indexed.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).collect()}
        weight = np.array([0.0, *(math.floor(1000 * math.log((2 * count["n"] + 2) / (2 * held.get(i + 1, 0) + 1))) for i in range(len(words)))])
        root, directions = item_tree([np.unique([vocabulary[t.encode()] for t in ts]) for ts in lists], weight)
        block = Block(root, weight, directions, len(lists), count["n"], count["length"], k, np.zeros(len(lists)))
        if count["n"] > 2 * seeds:
            drawn = indexed.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(1 << 30)) < int(seeds / count["n"] * (1 << 30)))
            for r in best(search(drawn, block), k).where(F.col("rank") == k).select("item", "score").collect():
                block.least[r["item"]] = r["score"]
        known = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(lists), dtype=np.int32)), "item_id": names}))
        found = best(search(indexed, block), k).join(F.broadcast(known), "item")
        out = out.unionByName(found.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score"))
    return out


def op13_dual_tree(spark, sf_dir: str) -> DataFrame:
    return ranked(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _terms_sql(table: str, key: str) -> str:
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"SELECT {key}, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{pattern}')) AS term FROM {table}"


SQL = f"""
WITH words AS ({_terms_sql("(SELECT row_number() OVER () AS uid, doc_id, text FROM documents)", "uid, doc_id")}),
items AS (SELECT DISTINCT * FROM ({_terms_sql("benchmark", "item_id")})),
lengths AS (SELECT uid, count(*) AS n FROM words GROUP BY uid),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM lengths),
tfs AS (SELECT uid, doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM items) GROUP BY uid, doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, total GROUP BY term),
impacts AS (SELECT uid, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)) AS impact FROM tfs JOIN lengths USING (uid), total),
scores AS (SELECT item_id, uid, doc_id, sum(w * impact)::BIGINT AS score FROM items JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, uid, doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""

QUERIES = {"op13_dual_tree": op13_dual_tree}
ORACLES = {"op13_dual_tree": SQL}
