"""What the operators share: the documents table, written intermediate tables, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that has none (tests, a laptop) gets a temporary folder; a cluster without one is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as no column of ``columns`` has."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        found.append(name)
    return found


def beside(docs: DataFrame, read: str, keep: list[str], run, results: list[tuple[str, str]]) -> DataFrame:
    """The columns ``keep`` of ``docs``, whatever their names, and ``results`` (name, type), which ``run`` makes.

    ``run`` maps Arrow batches of the column ``read`` and the kept ones to batches of the kept and the new ones. A kept column may
    not have the name of a result.
    """
    if clash := {c.lower() for c in keep} & {n.lower() for n, _ in results}:
        raise ValueError(f"kept columns have the names of results: {sorted(clash)}")
    told = docs.select(F.col(f"`{read}`").alias("read"), *[F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)])
    ddl = [f"{name} {kind}" for name, kind in told.dtypes[1:]] + [f"new_{i} {kind}" for i, (_, kind) in enumerate(results)]
    return told.mapInArrow(run, ", ".join(ddl)).toDF(*keep, *[n for n, _ in results])


def crc_fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


#: A key with more than this part of the rows is hot; there are fewer hot keys than its inverse.
HOT = 1 / 1000


def with_least(rows: DataFrame, key: str, value: str, least: str) -> DataFrame:
    """``rows`` with ``least``, the least ``value`` of the rows of their ``key`` (rows with a null key are left out).

    The minimum is combined before its shuffle. Rows of a hot key are joined where they lie, by a broadcast of
    fewer than 1 / ``HOT`` keys; only the others are shuffled by key, so no task holds a hot key's rows.
    ``rows`` is read three times: hand over a written table.
    """
    low = materialize(rows.groupBy(key).agg(F.min(value).alias(least), F.count("*").alias("n_of_key")), "least")
    bound = (low.agg(F.sum("n_of_key")).first()[0] or 0) * HOT
    hot = F.broadcast(low.where(F.col("n_of_key") > bound).drop("n_of_key"))
    rest = low.where(F.col("n_of_key") <= bound).drop("n_of_key")
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(rest, key))


def hot_join(rows: DataFrame, side: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``side``, whose column ``weight`` tells how many of the ``total`` rows have its key.

    Rows of a hot key are joined where they lie, by a broadcast of the fewer than 1 / ``HOT`` such keys; only the others
    are shuffled. ``rows`` is read three times and ``side`` twice: hand over written tables. Null keys meet nothing.
    """
    bound = total * HOT
    hot = F.broadcast(side.where(F.col(weight) > bound))
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on).distinct(), on, "left_anti").join(side.where(F.col(weight) <= bound), on))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node it reaches.

    Alternating large-star and small-star steps; each step is ``with_least`` over a table
    written to the shared folder, so lineage stays short and a node with very many
    neighbours is in no single task. Empty edges give no rows.
    """
    pairs = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, "u", "v", "m").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = with_least(materialize(large, "edges"), "u", "v", "m").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e"))
        pairs = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
