"""Streams: keyed ingestion and counts of signals, as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from recollect.functions.text import context_label
from recollect.session import shared_dir


def contexts(turns: DataFrame) -> DataFrame:
    """Context nodes of a stream of turns (conv_id, turn, role, text); keys make repeated delivery harmless."""
    key = F.concat_ws(":", F.lit("conv"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return turns.select(key.alias("node"), context_label("text").alias("label"), "text", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now, from the last checkpoint on, exactly once to files."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """The rows of one run over all available input."""
    import uuid

    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    append(stream, f"{base}/rows", f"{base}/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def run_windows(spark: SparkSession, stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The latest row of each of ``keys`` after one run over all available input, windows that are still open too.

    Each batch's changed rows are written under the batch's number, so a batch that runs twice counts once.
    """
    import uuid

    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    put = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")
    put(spark.createDataFrame([], stream.schema), -1)
    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{base}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")


def signal_windows(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, total) per window; events of a window that the watermark has passed are too late."""
    marked = events.withWatermark("ts", late)
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
