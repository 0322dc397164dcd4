"""SimHash near-duplicates by tiled exact comparison (operator 8).

Fingerprints of all texts come from built-in functions. Distinct fingerprints fall
into cells by the population counts of their four 16-bit quarters; two
fingerprints within the radius lie in cells whose counts differ by no more than the
radius in sum, so only such cells meet. A cell is cut into tiles of a fixed size, and
each pair of tiles is compared exactly in numpy (exclusive or, bit count) in one
task. Of the links in a pair of tiles only a spanning forest leaves the task, so a
dense family of near copies costs rows in proportion to its size. No bucket is
capped and no partner is dropped.

Null text counts as empty; texts without words have fingerprint zero and link like
any other. Rows that repeat a doc_id are fingerprinted one by one and each gets a row; rows with null
doc_id take part, and a component of such rows alone has a null id. An empty table
gives no rows. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\f\r"
#: Tiles of a cell at most.
TILES = 1 << 15
LANES = 0x0000000100000001


def vote(hashes, weight=None) -> list:
    """32 sums; each adds bit i in its low and bit i + 32 in its high 32 bits."""
    lane = lambda i: F.shiftrightunsigned(hashes, i).bitwiseAND(F.lit(LANES))
    return [F.sum(lane(i) if weight is None else lane(i) * weight).alias(f"v{i}") for i in range(32)]


def majority(total):
    """The 64-bit word whose bit is 1 where the votes exceed half of ``total``."""
    word = F.lit(0).cast("long")
    for i in range(32):
        v = F.coalesce(F.col(f"v{i}"), F.lit(0).cast("long"))
        low, high = v.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(v, 32)
        word = word.bitwiseOR(F.when(low * 2 > total, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        top = (1 << (i + 32)) - (1 << 64 if i == 31 else 0)
        word = word.bitwiseOR(F.when(high * 2 > total, F.lit(top)).otherwise(F.lit(0)).cast("long"))
    return word


def words(text):
    """Words of a text after lower-casing A-Z; a text without words gives one empty word."""
    return F.split(F.btrim(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(SPACE)), r"[\x20\x09-\x0D]+")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, hashed: bool = False) -> DataFrame:
    """(uid, doc_id, fingerprint long) of every row; with ``hashed`` also ``key``, a hash of the text."""
    keys = ["uid", "doc_id", *["key"] * hashed]
    key = [F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key")] * hashed
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), *key, words(F.col(text_col)).alias("w"))
    n = F.size("w")
    whole = F.array(F.concat_ws(" ", "w"))
    none = F.array(F.lit(None).cast("string"))
    columns = [F.when(n >= shingle, F.slice("w", i + 1, F.greatest(n - (shingle - 1), F.lit(1)))).otherwise(whole if i == 0 else none).alias(f"w{i}") for i in range(shingle)]
    rows = base.select(*keys, *columns).select(*keys, F.inline(F.arrays_zip(*[f"w{i}" for i in range(shingle)])))
    term = F.concat_ws(" ", *[f"w{i}" for i in range(shingle)])
    terms = rows.select(*keys, F.when(term != "", F.xxhash64(term)).alias("h"))
    return terms.groupBy(*keys).agg(*vote(F.col("h")), F.count("h").alias("n")).select(*keys, majority(F.col("n")).alias("fingerprint"))


def _forest(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within ``radius`` between two tiles."""
    nodes = a if same else np.concatenate([a, b])
    at, label = 0 if same else len(a), np.arange(len(nodes))
    step = max(1, (1 << 20) // max(1, len(b)))
    for i in range(0, len(a), step):
        left, right = np.nonzero(np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius)
        left, right = left + i, right + at
        while True:
            x, y = label[left], label[right]
            if (differ := x != y).sum() == 0:
                break
            left, right, x, y = left[differ], right[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label != (up := label[label])).any():
                label = up
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _compare(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pairs(key, high, fp):
            out = []
            for x, y in zip(*(lambda c: (np.r_[0, c], np.r_[c, len(key)]))(np.flatnonzero(np.diff(key)) + 1), strict=True):
                a, b = fp[x:y][~high[x:y]], fp[x:y][high[x:y]]
                same = len(b) == 0
                out.append(_forest(a, a if same else b, same, radius))
            if out:
                yield pd.DataFrame({"a": np.concatenate([o[0] for o in out]).view(np.int64), "b": np.concatenate([o[1] for o in out]).view(np.int64)})

        rest = None
        for batch in batches:
            now = [batch["key"].to_numpy(), batch["high"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            end = np.searchsorted(now[0], now[0][-1])
            rest = [x[end:] for x in now]
            if end:
                yield from pairs(*(x[:end] for x in now))
        if rest is not None and len(rest[0]):
            yield from pairs(*rest)

    return run


def links(distinct: DataFrame, radius: int = 2, tile: int = 4096) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of ``distinct`` (fp) within ``radius``.

    The table of cells has 17**4 rows at most, so it is broadcast. Tiles are larger than ``tile`` only where
    a cell would have more than 2**15 of them, the most that a key of a pair of tiles has room for.
    """
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF))).cast("int").alias(f"p{q}") for q in range(4)]
    cell = lambda p: sum((x * 17**q for q, x in enumerate(p)), F.lit(0))
    placed = distinct.select("fp", *quarter)
    placed = placed.withColumn("cell", cell([F.col(f"p{q}") for q in range(4)]))
    sizes = common.materialize(placed.groupBy("cell").agg(F.count("*").alias("n")), "cells")
    tile = max(tile, -(-(sizes.agg(F.max("n")).first()[0] or 0) // TILES))
    cells = sizes.select("cell", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    near = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    others = F.array(*[F.struct(*[(F.col(f"p{q}") + d[q]).alias(f"p{q}") for q in range(4)]) for d in near])
    inside = F.filter(others, lambda o: (F.least(*[o[f"p{q}"] for q in range(4)]) >= 0) & (F.greatest(*[o[f"p{q}"] for q in range(4)]) <= 16))
    own = placed.join(F.broadcast(cells), "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    met = own.select("fp", "cell", "tile", F.explode(F.transform(inside, lambda o: cell([o[f"p{q}"] for q in range(4)]))).alias("cell2"))
    met = met.join(F.broadcast(cells.select(F.col("cell").alias("cell2"), "tiles")), "cell2").select("fp", "cell", "tile", "cell2", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile2"))
    high = (F.col("cell") > F.col("cell2")) | ((F.col("cell") == F.col("cell2")) & (F.col("tile") > F.col("tile2")))
    pack = lambda c, t, c2, t2: F.shiftleft(c.cast("long"), 47) + F.shiftleft(c2.cast("long"), 30) + F.shiftleft(t.cast("long"), 15) + t2.cast("long")
    key = F.when(high, pack(F.col("cell2"), F.col("tile2"), F.col("cell"), F.col("tile"))).otherwise(pack(F.col("cell"), F.col("tile"), F.col("cell2"), F.col("tile2")))
    keyed = met.select(key.alias("key"), high.alias("high"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInPandas(_compare(radius), "a long, b long")


def grouped(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """(fingerprint, component_id, root, n) of the distinct fingerprints of ``rows``; n of them have it."""
    classes = common.materialize(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes")
    roots = common.components(links(classes.select("fp"), radius, tile))
    joined = common.materialize(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "roots")
    return common.with_least(joined, "root", "first", "component_id").select(F.col("fp").alias("fingerprint"), "component_id", "root", "n")


def labelled(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """``rows`` with their groups; rows of a fingerprint that very many share stay in the tasks where they lie."""
    found = common.materialize(grouped(rows, radius, tile), "groups")
    return common.hot_join(rows, found, ["fingerprint"], "n", found.agg(F.sum("n")).first()[0] or 0)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, tile: int = 4096) -> DataFrame:
    """(doc_id, fingerprint string, component_id) for every row of ``docs``."""
    rows = common.materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    return labelled(rows, radius, tile).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, tile: int = 4096) -> DataFrame:
    """``docs`` with one row of each component: that of the least id (rows without an id come last)."""
    rows = common.materialize(fingerprints(docs, id_col, text_col, hashed=True), "fingerprints")
    place = F.struct(F.isnull("doc_id"), F.col("doc_id"), F.col("key"))
    first = labelled(rows, radius, tile).groupBy("root").agg(F.min(place).alias("first"))
    ident, key, least = common.unused(docs.columns, "id", "key", "least")
    kept = first.select(F.col("first.doc_id").alias(ident), F.col("first.key").alias(least))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    found = keyed.join(kept, keyed[id_col].eqNullSafe(F.col(ident)) & (F.col(key) == F.col(least)))
    return found.dropDuplicates([ident, least]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_simhash_tiles(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))


QUERIES = {"op8_simhash_tiles": op8_simhash_tiles}
ORACLES: dict[str, str] = {}
