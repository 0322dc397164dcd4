"""Evaluations that go on where they stopped: results are committed by key under a fingerprint of the settings and of each key's input.

A folder holds ``fingerprint=F/rows/run=R`` (results) and ``fingerprint=F/done/run=R`` (key, input). Rows are written before
the keys that they settle, so what a lost run leaves behind without its keys is never read; other settings make another fingerprint, and a
key whose input has changed is computed again.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.session import materialize


def fingerprint(settings: dict) -> str:
    """A name for a set of settings, whatever their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


def inputs(rows: DataFrame, key: str) -> DataFrame:
    """(key, input): a fingerprint of each key's rows, whatever their order; repeated rows count."""
    h = lambda seed: F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in sorted(rows.columns)]).cast("decimal(38,0)")
    return rows.groupBy(key).agg(F.concat_ws(":", F.count("*"), F.sum(h(1)), F.sum(h(2))).alias("input"))


class Evaluation:
    """Results of ``compute`` by key; ``compute`` maps rows to a table that has the key and the columns of ``schema``."""

    def __init__(self, path: str, settings: dict, key: str, schema: str, compute: Callable[[DataFrame], DataFrame]):
        self.path, self.key, self.schema, self.compute = f"{path.rstrip('/')}/fingerprint={fingerprint(settings)}", key, schema, compute

    def _read(self, spark, name: str, schema: T.StructType) -> DataFrame:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        schema = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
        return spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}") if found else spark.createDataFrame([], schema)

    def _done(self, rows: DataFrame) -> DataFrame:
        """(key, input, run): the last committed run of each key and input."""
        spark = rows.sparkSession
        schema = T.StructType([T.StructField(self.key, rows.schema[self.key].dataType), T.StructField("input", T.StringType())])
        return self._read(spark, "done", schema).groupBy(self.key, "input").agg(F.max("run").alias("run"))

    def missing(self, rows: DataFrame) -> DataFrame:
        """(key, input) of the keys of ``rows`` for which nothing is committed."""
        return inputs(rows, self.key).join(self._done(rows), [self.key, "input"], "left_anti")

    def run(self, rows: DataFrame, parts: int = 1) -> int:
        """Compute what is missing, in ``parts`` commits; how many keys were computed."""
        todo = materialize(self.missing(rows), "todo")
        for part in range(parts):
            mine = todo.where(F.pmod(F.xxhash64(self.key), F.lit(parts)) == part)
            if mine.isEmpty():
                continue
            run = f"{uuid.uuid1().time:020d}-{uuid.uuid4().hex[:8]}"
            self.compute(rows.join(mine.select(self.key), self.key, "left_semi")).write.parquet(f"{self.path}/rows/run={run}")
            mine.write.parquet(f"{self.path}/done/run={run}")
        return todo.count()

    def results(self, rows: DataFrame) -> DataFrame:
        """The committed results of the present inputs of ``rows``."""
        current = inputs(rows, self.key).join(self._done(rows), [self.key, "input"]).select(self.key, "run")
        found = self._read(rows.sparkSession, "rows", T.StructType.fromDDL(self.schema))
        return found.join(current, [self.key, "run"]).drop("run")
