"""Session settings, and tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether files that a job shuffled are deleted when it ends, and not only when the driver has collected its plan.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build(app: str = "recollect", **extra: str) -> SparkSession:
    """A session with UTC, adaptive planning and Arrow; ``extra`` are further settings."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", **extra}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where a local session has none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """What a write shuffles is needed no more once it has ended, so the rounds of an iterative operator do not pile up on the disks."""
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; iterative operators cut their lineage so."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, once nothing reads it any more; other files that ``df`` reads stay."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if not re.search(r"-[0-9a-f]{32}$", path):
            continue
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def keyed(df: DataFrame, key: str, name: str, dealt: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder in buckets of ``key`` and read it back; joins on the key then move only their other side.

    ``dealt`` tells that ``df`` has been repartitioned by the key into as many parts as a shuffle has.
    """
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _cleaned(spark):
        (df if dealt else df.repartition(parts, key)).write.bucketBy(parts, key).sortBy(key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name, format="parquet")
    return spark.table(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table, its timestamps without zone read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({f.name: df[f.name].cast("timestamp") for f in df.schema if f.dataType.typeName() == "timestamp_ntz"})
