"""Token files (operator 7): flat unsigned integers, 64-bit document offsets, memory-mapped.

A range partition of the documents by id becomes one shard of three files in the
shared folder: ``.bin`` (ids of all its documents in a row, unsigned 16-bit where the
vocabulary fits, else 32-bit), ``.idx`` (64-bit offsets, one more than documents) and
``.doc`` (64-bit document ids). A manifest row per shard gives its counts; where a
shard begins in the whole corpus is the prefix sum over the manifest. A task attempt
writes files of its own name; the manifest, which Spark commits once for each task, names
those of one attempt. An attempt that fails removes its files.

Null text counts as empty and gives the end id alone; documents with equal id follow
each other in text order; null ids come first and read back as null. An empty table
gives no shard and no rows. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm import common, tokens

NULL_ID = -(1 << 63)
MANIFEST = "shard long, path string, item int, n_docs long, n_tokens long"


def _filesystem(uri: str):
    return pa.fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Write all documents in ascending id order under ``path``; the manifest, one row per shard."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encoder = TaskContext.get(), tokens.encoder(vocabulary)
        store, folder = _filesystem(path)
        store.create_dir(folder, recursive=True)
        name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}"
        sizes, ids = [], []
        try:
            with store.open_output_stream(f"{folder}/{name}.bin") as out:
                for batch in batches:
                    flat, n = encoder.encode(batch.column(1).to_pylist())
                    out.write(flat.tobytes())
                    sizes.append(n)
                    ids.append(batch.column(0).fill_null(NULL_ID).to_numpy())
            offsets = np.cumsum(np.concatenate([[0], *sizes]), dtype=np.int64)
            for kind, data in (("idx", offsets), ("doc", np.concatenate([np.zeros(0, np.int64), *ids]))):
                with store.open_output_stream(f"{folder}/{name}.{kind}") as out:
                    out.write(data.astype("<i8").tobytes())
        except BaseException:
            for kind in ("bin", "idx", "doc"):
                if store.get_file_info(f"{folder}/{name}.{kind}").type != pa.fs.FileType.NotFound:
                    store.delete_file(f"{folder}/{name}.{kind}")
            raise
        if len(offsets) > 1:
            yield pa.RecordBatch.from_pylist([{"shard": context.partitionId(), "path": f"{path}/{name}", "item": encoder.kind.itemsize, "n_docs": len(offsets) - 1, "n_tokens": int(offsets[-1])}], pa.schema([("shard", pa.int64()), ("path", pa.string()), ("item", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.materialize(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(shard, MANIFEST), "manifest")


def mapped(path: str, kind: str, first: int, count: int) -> np.ndarray:
    """``count`` items from ``first`` on of a shard's file: memory-mapped, or that byte range of a remote store."""
    store, name = _filesystem(path)
    item = np.dtype(kind).itemsize
    if not count:
        return np.zeros(0, kind)
    if store.type_name == "local":
        return np.memmap(name, kind, "r", first * item, (count,))
    with store.open_input_file(name) as file:
        return np.frombuffer(file.read_at(count * item, first * item), kind)


def read(manifest: DataFrame, block: int = 512) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    The manifest has a row per shard, so its prefix sum is one small window.
    """

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                n = min(block, row.n_docs - row.first)
                offsets = mapped(f"{row.path}.idx", "<i8", row.first, n + 1).astype(np.int64)
                ids = mapped(f"{row.path}.doc", "<i8", row.first, n)
                flat = mapped(f"{row.path}.bin", f"<u{row.item}", int(offsets[0]), int(offsets[-1] - offsets[0]))
                crc = [zlib.crc32(flat[a:b].astype("<u4")) for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(np.where(ids == NULL_ID, 0, ids), "Int64"), "null": ids == NULL_ID, "start": row.base + offsets[:-1], "n_tokens": np.diff(offsets), "ids_crc32": crc})

    order = Window.orderBy("shard")
    based = manifest.withColumn("base", F.sum("n_tokens").over(order) - F.col("n_tokens"))
    blocks = based.select("path", "item", "base", "n_docs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(block).cast("long"))).alias("first"))
    found = blocks.repartition(blocks.sparkSession.sparkContext.defaultParallelism * 4, "path", "first").mapInPandas(documents, "doc_id long, null boolean, start long, n_tokens long, ids_crc32 long")
    return found.select(F.when(~F.col("null"), F.col("doc_id")).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    return read(write(common.documents(spark, sf_dir), f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"))


QUERIES = {"op7_token_files": op7_token_files}
ORACLES: dict[str, str] = {}
