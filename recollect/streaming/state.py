"""Keyed state in streams: counters that call for work when they fill, and queues that are drained by size or by a timer.

State lies in the stream's checkpoint, so a stream that is stopped and started again goes on where it was and delivers each row once
to a sink that commits by batch. The session needs the RocksDB state store (``with_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """``spark`` with the state store that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class Due(StatefulProcessor):
    """Counts a key's rows in order and gives those at which the counter fills: after ``first``, then every ``every``."""

    def __init__(self, order: list[str], every: int, first: int | None = None):
        self.order, self.every, self.first = order, every, every if first is None else first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        n = int(self.count.get()[0]) if self.count.exists() else 0
        place = pd.Series(range(n + 1, n + 1 + len(got)), index=got.index) - self.first
        self.count.update((n + len(got),))
        yield got[(place >= 0) & (place % self.every == 0)]

    def close(self) -> None:
        pass


class Tasks(StatefulProcessor):
    """As ``Due`` for several tasks (name, every, first) of one counter: rows with ``task``. It takes rows as they are, since most keys have few."""

    def __init__(self, order: list[str], tasks: list[tuple[str, int, int]]):
        self.order, self.tasks = order, tasks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        got = sorted(rows, key=lambda r: [(r[c] is None, r[c]) for c in self.order])
        before = self.count.get()
        n = int(before[0]) if before else 0
        self.count.update((n + len(got),))
        for name, every, first in self.tasks:
            start = first - n - 1 if n < first else (first - n - 1) % every
            for r in got[start::every]:
                yield Row(**r.asDict(), task=name)

    def close(self) -> None:
        pass


class Drain(StatefulProcessor):
    """A queue of nodes that wait for their vectors: full batches leave at once, the rest when ``seconds`` have passed since the first came."""

    def __init__(self, batch: int = 256, seconds: float = 30.0):
        self.batch, self.wait = batch, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "node string")
        self.timer = handle.getValueState("timer", "at long")

    def _leave(self, key, nodes: list[str]) -> Iterator[pd.DataFrame]:
        if nodes:
            yield pd.DataFrame({"shard": [key[0]] * len(nodes), "node": pd.Series(nodes, dtype=object)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = [r[0] for r in self.queue.get()] if self.queue.exists() else []
        waiting += [n for df in rows for n in sorted(df["node"])]
        full = len(waiting) // self.batch * self.batch
        self.queue.clear()
        if waiting[full:]:
            self.queue.put([(n,) for n in waiting[full:]])
            if not self.timer.exists():
                at = timerValues.getCurrentProcessingTimeInMs() + self.wait
                self.handle.registerTimer(at)
                self.timer.update((at,))
        yield from self._leave(key, waiting[:full])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = [r[0] for r in self.queue.get()] if self.queue.exists() else []
        self.queue.clear()
        self.timer.clear()
        yield from self._leave(key, waiting)

    def close(self) -> None:
        pass


def due(log: DataFrame, key: str, order: list[str], every: int = 50, first: int | None = None) -> DataFrame:
    """The stream ``log`` at the rows of each key at which its counter fills; rows of one batch count in ``order``, batches as they come."""
    return log.groupBy(key).transformWithStateInPandas(Due(order, every, first), log.schema, "Append", "None")


def due_tasks(log: DataFrame, key: str, order: list[str], tasks: list[tuple[str, int, int]]) -> DataFrame:
    """The rows of ``due`` for each of ``tasks`` (name, every, first), with ``task``: one counter and one pass for all."""
    schema = T.StructType([*log.schema.fields, T.StructField("task", T.StringType())])
    return log.groupBy(key).transformWithState(Tasks(order, tasks), schema, "Append", "None")


def drained(pending: DataFrame, batch: int = 256, seconds: float = 30.0) -> DataFrame:
    """(shard, node) of the stream ``pending`` (shard, node), held back until a shard has ``batch`` of them or ``seconds`` have passed.

    Spread nodes over shards by a hash, so that no queue grows with the whole memory. The timers need a stream with a
    processing-time trigger: a run over what is available now does not end while timers are used.
    """
    kind = dict(pending.dtypes)["shard"]
    return pending.groupBy("shard").transformWithStateInPandas(Drain(batch, seconds), f"shard {kind}, node string", "Append", "ProcessingTime")
