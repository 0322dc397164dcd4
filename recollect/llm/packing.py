"""Packing by minimum bin slack (operator 6).

Every document is cut into pieces of the window's length and one remainder. Pieces of
equal length are alike, so the corpus enters the plan as a histogram: at most one
count for each length up to the window. For each window the largest remaining
length is fixed, and a subset-sum dynamic programme over a bitset finds the multiset of
remaining lengths that comes closest to the capacity; backtracking gives its counts. The multiset is
used as often as the counts and the tokens allow. Where it leaves slack, the largest remaining
pieces are laid out in a stream and cut at the slacks' ends, so the windows are full; less than one
window is left in the end, and forms sequences whose lengths are powers of two. So no sequence needs padding.

Ranks of pieces within a length are formed in buckets of bounded size, and a piece's
sequence follows from its length and rank. Null text counts as empty and is packed as
its end id; repeated rows are packed each. An empty table gives no rows. Columns other
than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm import common, tokens

WINDOW = 2048
#: Pieces of one length that a task ranks together.
BUCKET = 1_000
#: At so many cut pieces at most, their list is broadcast (under 1 MB).
FEW = 10_000


def fill(counts: dict[int, int], capacity: int) -> tuple[dict[int, int], int]:
    """The multiset of lengths within ``counts`` whose sum is nearest to ``capacity`` from below, and the slack."""
    mask, reach, before = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= capacity), reverse=True):
        before.append((length, reach))
        left, k = min(counts[length], capacity // length), 1
        while left:
            k = min(k, left)
            reach |= (reach << (k * length)) & mask
            left, k = left - k, 2 * k
        if reach >> capacity & 1:
            break
    total = best = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, reach in reversed(before):
        c = next(c for c in range(total // length + 1) if reach >> (total - c * length) & 1)
        if c:
            used[length] = c
            total -= c * length
    return used, capacity - best


def plan(counts: dict[int, int], capacity: int = WINDOW) -> tuple[list[tuple[dict[int, int], int, int, dict[int, int]]], dict[int, int]]:
    """Patterns (length -> count, times used, slack, pieces taken for cutting: length -> count), and the counts left over.

    The pieces left over, and what the patterns' cuts leave of theirs, are less than ``capacity`` together.
    """
    counts, patterns, stock = {x: n for x, n in counts.items() if n}, [], 0
    left = sum(x * n for x, n in counts.items())
    while counts:
        largest = max(counts)
        counts[largest] -= 1
        used, slack = fill(counts, capacity - largest)
        counts[largest] += 1
        used[largest] = used.get(largest, 0) + 1
        times = min(counts[x] // c for x, c in used.items())
        if slack:
            times = min(times, (left + stock) // capacity)
        if not times:
            break
        for x, c in used.items():
            counts[x] -= c * times
        taken: dict[int, int] = {}
        for x in sorted(counts, reverse=True):
            if stock >= slack * times:
                break
            taken[x] = min(counts[x], -((stock - slack * times) // x))
            counts[x] -= taken[x]
            stock += taken[x] * x
        stock -= slack * times
        patterns.append((used, times, slack, {x: n for x, n in taken.items() if n}))
        counts = {x: n for x, n in counts.items() if n}
        left = sum(x * n for x, n in counts.items())
    return patterns, counts


def places(patterns, rest, capacity: int = WINDOW):
    """Where the pieces go: rank intervals of each length, and the slots that the stream of cut pieces fills.

    An interval has its first rank, whether it is in the stream, its first sequence (in the stream: position),
    the copies in a sequence and the offset of the first. Slots have a first position, a size, a first sequence and an offset.
    """
    table: dict[int, list[tuple[int, int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    slots: list[tuple[int, int, int, int]] = []
    sequence = position = filled = 0

    def lay(pieces: dict[int, int]) -> None:
        nonlocal position
        for x in sorted(pieces, reverse=True):
            table.setdefault(x, []).append((taken.get(x, 0), 1, position, 1, 0))
            taken[x] = taken.get(x, 0) + pieces[x]
            position += pieces[x] * x

    for used, times, slack, cut in patterns:
        offset = 0
        for x in sorted(used, reverse=True):
            table.setdefault(x, []).append((taken.get(x, 0), 0, sequence, used[x], offset))
            taken[x] = taken.get(x, 0) + used[x] * times
            offset += used[x] * x
        lay(cut)
        if slack:
            slots.append((filled, slack, sequence, offset))
            filled += slack * times
        sequence += times
    lay(rest)
    for bit in reversed(range(capacity.bit_length())):
        if position - filled >> bit & 1:
            slots.append((filled, 1 << bit, sequence, 0))
            filled, sequence = filled + (1 << bit), sequence + 1
    return {x: np.array(rows, np.int64).T for x, rows in table.items()}, np.array(slots, np.int64).reshape(-1, 4).T


def cuts(start: np.ndarray, length: int, slots: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces at positions ``start`` of the stream cut at the slots' ends: rows, sequences, offsets, shifts, lengths."""
    rows, done = np.arange(len(start)), np.zeros(len(start), np.int64)
    while len(rows):
        at = start[rows] + done
        first, size, sequence, offset = slots[:, np.searchsorted(slots[0], at, "right") - 1]
        nth, into = np.divmod(at - first, size)
        take = np.minimum(size - into, length - done)
        yield rows, sequence + nth, offset + into, done, take
        done = done + take
        rows, done = rows[done < length], done[done < length]


def encoded(docs: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str | None) -> DataFrame:
    """(uid, doc_id, doc_tokens, ids, crcs of the pieces) of every row, written to the shared folder."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        for batch in batches:
            flat, sizes = encoder.encode(batch.column(2).to_pylist())
            ends, wide = np.cumsum(sizes).tolist(), flat.astype("<u4")
            crcs = [[zlib.crc32(wide[i : min(i + capacity, b)]) for i in range(a, b, capacity)] for a, b in zip([0, *ends], ends, strict=False)]
            raw = [flat[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.array(raw, pa.binary()), pa.array([flat.itemsize] * len(raw), pa.int32()), pa.array(crcs, pa.list_(pa.int64()))], ["uid", "doc_id", "doc_tokens", "ids", "item", "crcs"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.materialize(rows.mapInArrow(encode, "uid long, doc_id long, doc_tokens long, ids binary, item int, crcs array<long>"), "ids")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = WINDOW, bucket: int = BUCKET, few: int = FEW, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    table = encoded(docs, id_col, text_col, capacity, vocabulary)
    items = table.select("uid", "doc_id", "doc_tokens", F.posexplode("crcs").alias("piece", "ids_crc32"))
    items = items.select("uid", "doc_id", "doc_tokens", "ids_crc32", (F.col("piece").cast("long") * capacity).alias("start"))
    items = items.withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - F.col("start")))
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}
    patterns, rest = plan(counts, capacity)
    where, slots = places(patterns, rest, capacity)
    buckets = F.create_map(*[F.lit(v) for x, n in sorted(counts.items()) if n > bucket for v in (x, -(-n // bucket))]) if any(n > bucket for n in counts.values()) else F.lit(None).cast("map<bigint,bigint>")
    items = items.withColumn("salt", F.pmod(F.xxhash64("uid", "start"), F.coalesce(F.try_element_at(buckets, F.col("length")), F.lit(1)).cast("long")))
    per = items.groupBy("length", "salt").count()
    by = Window.partitionBy("length").orderBy("salt")
    per = per.select("length", "salt", (F.sum("count").over(by) - F.col("count")).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("uid", "start")
    ranked = items.withColumn("rank", F.row_number().over(within).cast("long") - 1).join(per, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    schema = "uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut boolean, nullid boolean"

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, rows in batch.groupby("length", sort=False):
                rank = rows["rank"].to_numpy()
                begin, stream, at, copies, offset = where[length][:, np.searchsorted(where[length][0], rank, "right") - 1]
                whole = stream == 0
                if whole.any():
                    nth, slot = np.divmod((rank - begin)[whole], copies[whole])
                    yield rows[whole].assign(sequence_id=at[whole] + nth, offset=offset[whole] + slot * length, cut=False)
                rows = rows[~whole]
                for i, sequence, into, shift, n in cuts((at + (rank - begin) * length)[~whole], length, slots):
                    found = rows.iloc[i]
                    yield found.assign(sequence_id=sequence, offset=into, start=found["start"].to_numpy() + shift, cut=n < length, length=n)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in assign(batches):
            yield out[["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cut", "nullid"]]

    placed = ranked.select("uid", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "rank", F.isnull("doc_id").alias("nullid")).mapInPandas(named, schema)
    columns = [F.when(~F.col("nullid"), F.col("doc_id")).alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if not slots.size:
        return placed.select(*columns)
    placed = common.materialize(placed, "placed")
    cut = placed.where("cut").drop("ids_crc32", "cut")
    most = sum(times for _, times, slack, _ in patterns if slack) + slots.shape[1] + sum(sum(x.values()) for *_, x in patterns) + sum(rest.values())
    cut = F.broadcast(cut) if most <= few else cut

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            crc = [zlib.crc32(np.frombuffer(r["ids"], f"<u{r['item']}")[r["start"] : r["start"] + r["length"]].astype("<u4").tobytes()) for r in rows]
            kept = batch.select(["doc_id", "nullid", "start", "length", "doc_tokens", "sequence_id", "offset"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(crc, pa.int64())], [*kept.schema.names, "ids_crc32"])

    found = table.select("uid", "ids", "item").join(cut, "uid").mapInArrow(sums, "doc_id long, nullid boolean, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long")
    return placed.where("not cut").select(*columns).unionByName(found.select(*columns))


def op6_min_bin_slack(spark, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))


QUERIES = {"op6_min_bin_slack": op6_min_bin_slack}
ORACLES: dict[str, str] = {}
