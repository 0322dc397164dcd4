"""Nearest vectors by cosine: exactly in tiles, or in the nearest cells of an inverted file.

Vectors and queries meet in tiles of bounded size, each of which one task multiplies and cuts to the k best of each query, so
neither side is broadcast and no pair of rows is shuffled. The inverted file's cells are fitted by k-means on a bounded sample and
cover every row; a query looks into its nearest cells, and looking into all of them is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import materialize

#: Vectors and queries of a tile.
VECTORS, QUERIES = 8192, 1024
#: Vectors in expectation from which cells are fitted, and the most cells.
SAMPLE, CELLS = 20_000, 4096


def matrix(column) -> np.ndarray:
    """Rows of a list column as unit vectors; null and zero vectors are zero."""
    rows = [np.zeros(0) if v is None else np.asarray(v, float) for v in column]
    width = max([len(r) for r in rows], default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _best(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Of a tile of vectors and one of queries, the k most similar of each query."""
        out = []
        if len(left) and len(right):
            v, q = matrix(left["embedding"]), matrix(right["embedding"])
            width = min(v.shape[1], q.shape[1])
            similar = np.floor(1 / (2 - v[:, :width] @ q[:, :width].T) * 10000 + 0.5) / 10000
            items, by = left["item"].to_numpy(), np.argsort(left["item"].to_numpy(), kind="stable")
            for j, query in enumerate(right["query"]):
                column = similar[by, j]
                column = np.where(items[by] == query, -1.0, column)
                cut = np.partition(column, len(column) - k)[len(column) - k] if len(column) > k else -0.5
                near = np.flatnonzero((column >= cut) & (column >= 0))
                near = near[np.argsort(-column[near], kind="stable")][:k]
                out.append(pd.DataFrame({"query": query, "item": items[by][near], "similarity": column[near]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "item": [], "similarity": []})

    return run


def _tiled(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, item, similarity, rank) of vectors (item, embedding, cell) and queries (query, embedding, cell) that share a cell."""
    tiles = lambda df, name, size: df.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    shape = materialize(tiles(vectors, "down", VECTORS).join(tiles(queries, "across", QUERIES), "cell"), "tiles")
    known = F.broadcast(shape) if shape.count() <= CELLS else shape
    deal = lambda df, key, own, other: df.join(known, "cell").withColumn(own[0], F.pmod(F.xxhash64(key), F.col(own[1])).cast("int")).withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1)))
    left = deal(vectors, "item", ("row", "down"), ("col", "across")).select("cell", "row", "col", "item", "embedding")
    right = deal(queries, "query", ("col", "across"), ("row", "down")).select(*[F.col(c).alias(c) for c in ("cell", "row", "col", "query", "embedding")])  # names of its own: both sides may come from one table
    kinds = dict(right.dtypes)["query"], dict(left.dtypes)["item"]
    key = ["cell", "row", "col"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_best(k), f"query {kinds[0]}, item {kinds[1]}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "item"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, item, similarity, rank): the k nearest of ``vectors`` (item, embedding) to each of ``queries`` (query, embedding), but for itself.

    Similarity is 1 / (1 + distance), to four digits; equal ones by item. All queries meet all vectors, in tiles.
    """
    one = lambda df: df.withColumn("cell", F.lit(0))
    return _tiled(one(vectors), one(queries), k)


@dataclass
class Cells:
    """An inverted file: (item, embedding, cell) of every vector, and the cells' unit centres."""

    rows: DataFrame
    centres: np.ndarray

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """As ``exact``, in the ``probes`` nearest cells of each query; without ``probes`` in all."""
        if probes is None or probes >= len(self.centres):
            return exact(self.rows.drop("cell"), queries, k)
        found = _nearest(queries, "query", self.centres, probes)
        return _tiled(self.rows, found.select("query", "embedding", F.explode("cells").alias("cell")), k)


def _nearest(df: DataFrame, key: str, centres: np.ndarray, n: int) -> DataFrame:
    """(key, embedding, cells): the ``n`` cells whose centres are nearest."""
    shipped = df.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1).to_pylist())
            near = np.zeros((len(v), n), np.int32)
            if v.size:
                near = np.argsort(-(v @ shipped.value[:, : v.shape[1]].T), axis=1, kind="stable")[:, :n].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(near), pa.list_(pa.int32()))], [key, "embedding", "cells"])

    kinds = dict(df.dtypes)
    return df.select(key, "embedding").mapInArrow(run, f"{key} {kinds[key]}, embedding {kinds['embedding']}, cells array<int>")


def fit(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Unit centres of ``cells`` groups of unit vectors, by k-means from centres drawn far apart."""
    if not len(sample):
        return np.zeros((0, 0))
    centres = [sample[0]]
    far = 1 - sample @ centres[0]
    for _ in range(min(cells, len(sample)) - 1):
        centres.append(sample[int(far.argmax())])
        far = np.minimum(far, 1 - sample @ centres[-1])
    found = np.array(centres)
    for _ in range(rounds):
        at = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, at, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), found)
    return found


def inverted_file(vectors: DataFrame, cells: int = 64, sample: int = SAMPLE) -> Cells:
    """The inverted file of ``vectors`` (item, embedding). Cells are fitted on at most ``sample`` vectors in expectation, drawn by a hash of the item; every vector is in one."""
    if cells > CELLS:
        raise ValueError(f"at most {CELLS} cells")
    count = max(1, vectors.count())
    drawn = vectors.where(F.pmod(F.xxhash64("item"), F.lit(1 << 30)) < int(min(1.0, sample / count) * (1 << 30))).orderBy(F.xxhash64("item"))
    centres = fit(matrix(drawn.select("embedding").toArrow().column(0).to_pylist()), cells)
    if not len(centres):
        return Cells(vectors.withColumn("cell", F.lit(0)), np.zeros((1, 1)))
    placed = _nearest(vectors, "item", centres, 1).select("item", "embedding", F.get("cells", F.lit(0)).alias("cell"))
    return Cells(materialize(placed, "cells"), centres)
