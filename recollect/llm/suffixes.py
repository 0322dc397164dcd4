"""Repeated passages by sparse suffix arrays (operator 9).

A suffix is kept only where a minimiser lies: the least hash among ``MIN_WORDS - GRAM + 1``
neighbouring ``GRAM``-word grams. Every passage of ``MIN_WORDS`` words holds such a
window, and equal passages keep equal positions. Of the kept suffixes those whose gram
occurs again elsewhere are sorted by their gram's hash and their words (as 32-bit hashes, compared as bytes), so that
suffixes of one gram stand together. Each suffix gives the hashes of the windows of ``MIN_WORDS`` words that hold its gram; a
window that another text gives too is part of a passage, and overlapping windows are joined.
The sort deals by hashes of the gram and of the suffix, the text and the
position, so a passage that a third of all documents share spreads over many tasks, and the sampled keys are short. Windows of a gram that one
batch holds whole are settled there; those of a gram that a batch or task border cuts are also
compared by their hash over all batches. Documents with equal texts are handled as one text and are
passages as a whole.

A passage counts if it occurs in another document; repeats within one document alone do
not. Null and short texts have none; every row of the same text gets its passages. An empty table gives
no rows. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm import common

MIN_WORDS, GRAM = 50, 20
#: A gram of so many rows at most waits for the next batch; one of more is cut.
HOLD = 1 << 14
BLOCK = 1 << 21
_P, _Q = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up = np.full(n, base, np.uint64)
    down = np.full(n, inverse, np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _cache or len(_cache[base][0]) < n:
        _cache[base] = _powers(base, max(n, BLOCK + 1))
    return _cache[base][0][:n], _cache[base][1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[start:end] for each range."""
    up, down = _power(base, len(values))
    sums = np.r_[np.uint64(0), np.cumsum(values * up)]
    return _mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in a row, and where each text's begin (one more than texts)."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.r_[True, gap, True].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    hashes = _ranges(raw.astype(np.uint64) + np.uint64(1), starts, ends, _P)
    begin = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    return hashes, np.searchsorted(starts, begin)


def _sliding(x: np.ndarray, n: int, f, fill) -> np.ndarray:
    """f over x[i : i + n]; the end is padded with ``fill``."""
    x = np.r_[x, np.full(n, fill, x.dtype)]
    width, out = 1, x
    while 2 * width <= n:
        out = f(out[: len(out) - width], out[width:])
        width *= 2
    more = n - width
    return f(out[: len(out) - more], out[more:])[: len(x) - n] if more else out[: len(x) - n]


def minimisers(hashes: np.ndarray, begin: np.ndarray, min_words: int = MIN_WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the minimisers within all words, and their grams' hashes."""
    n, window = len(hashes), min_words - gram + 1
    if n < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n)
    ends = np.repeat(begin[1:], np.diff(begin))
    inside = at + gram <= ends
    grams = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    grams[inside] = _ranges(hashes, at[inside], at[inside] + gram, _Q)
    least = _sliding(grams, window, np.minimum, np.iinfo(np.uint64).max)
    least[at + min_words > ends] = 0
    greatest = _sliding(least[::-1], window, np.maximum, 0)[::-1]
    chosen = np.flatnonzero((greatest == grams) & inside)
    return chosen, grams[chosen]


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > BLOCK:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield first, held


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _seeds(min_words: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(gram, text, position) of each minimiser, and (null, text, words) of each text."""
        for batch in batches:
            th = batch.column(0).to_numpy()
            for first, texts in _blocks(_bytes(batch.column(1))):
                hashes, begin = word_hashes(texts)
                at, grams = minimisers(hashes, begin, min_words, gram)
                doc = np.searchsorted(begin, at, "right") - 1
                seed = pa.concat_arrays([pa.array(grams.view(np.int64)), pa.nulls(len(texts), pa.int64())])
                key = np.r_[th[first + doc], th[first : first + len(texts)]]
                yield pa.RecordBatch.from_arrays([seed, pa.array(key), pa.array(np.r_[at - begin[doc], np.diff(begin)].astype(np.int64))], ["seed", "th", "pos"])

    return run


def _suffixes(min_words: int, gram: int):
    before = min_words - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(right, left, text, position): the words from each position on, and those before it backwards, as far as a window reaches."""
        for batch in batches:
            th, listed = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, texts in _blocks(_bytes(batch.column(1))):
                hashes, begin = word_hashes(texts)
                words = (hashes >> np.uint64(32)).astype(">u4")
                forth, back, n = words.tobytes(), words[::-1].tobytes(), len(words)
                rows = [(th[first + d], p, a + p, a, b) for d, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)) for p in listed[first + d]]
                for i in range(0, len(rows), 4096):
                    part = rows[i : i + 4096]
                    right = [forth[4 * at : 4 * min(at + min_words, b)] for _, _, at, _, b in part]
                    left = [back[4 * (n - at) : 4 * min(n - at + before, n - a)] for _, _, at, a, _ in part]
                    yield pa.RecordBatch.from_arrays([pa.array(right, pa.binary()), pa.array(left, pa.binary()), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64())], ["right", "left", "th", "pos"])

    return run


def _matrix(column: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(x) // 4 for x in column])
    return np.frombuffer(b"".join(x.ljust(4 * width, b"\0") for x in column), ">u4").reshape(-1, width), lens


def windows(rows: list[tuple], min_words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, hash) of every window of ``min_words`` that holds a row's gram."""
    before = min_words - gram
    right, rlen = _matrix([r[0] for r in rows], min_words)
    left, llen = _matrix([r[1] for r in rows], before) if before else (np.zeros((len(rows), 0), ">u4"), np.zeros(len(rows), int))
    strip = np.concatenate([left[:, ::-1], right], axis=1).astype(np.uint64) + np.uint64(1)
    up, down = _power(_P, before + min_words)
    sums = np.concatenate([np.zeros((len(rows), 1), np.uint64), np.cumsum(strip * up, axis=1, dtype=np.uint64)], axis=1)
    at = np.arange(before + 1)
    hashes = _mix((sums[:, at + min_words] - sums[:, at]) * down[at])
    row, first = np.nonzero((before - at <= llen[:, None]) & (at + gram <= rlen[:, None]))
    return row, np.array([r[3] for r in rows])[row] - before + first, hashes[row, first]


def shared(rows: list[tuple], min_words: int, gram: int, cut: np.ndarray) -> list[tuple]:
    """(null, text, first word, end) of what rows of two texts have in common, and of the rows in ``cut`` (hash, text, first word, null) for the other batches.

    Windows that are found here stand for all their rows: the least and the greatest text, without a first word.
    """
    row, start, key = windows(rows, min_words, gram)
    if not len(row):
        return []
    th = np.array([r[2] for r in rows])[row]
    order = np.lexsort((th, key))
    row, start, key, th = row[order], start[order], key[order], th[order]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    last = np.r_[edge[1:], len(key)] - 1
    two = th[edge] != th[last]
    here = np.repeat(two, last - edge + 1)
    low, high = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), -1)
    np.minimum.at(low, row[here], start[here])
    np.maximum.at(high, row[here], start[here])
    some = np.flatnonzero(high >= 0).tolist()
    out: set[tuple] = {(None, rows[i][2], a, b + min_words) for i, a, b in zip(some, low[some].tolist(), high[some].tolist(), strict=True)}
    named, opened = key.view(np.int64), cut[row]
    alone = np.flatnonzero(opened & ~here)
    out.update(zip(named[alone].tolist(), th[alone].tolist(), start[alone].tolist(), [None] * len(alone), strict=True))
    for ends in (edge, last):
        known = ends[two & opened[edge]]
        out.update((k, t, None, None) for k, t in zip(named[known].tolist(), th[known].tolist(), strict=True))
    return list(out)


SHARED = "key long, th long, start long, end long"


def _compare(min_words: int, gram: int):
    def found(rows: list[tuple], head: bool, tail: bool) -> pa.RecordBatch:
        """``head``, ``tail``: the first or last gram's rows may go on in another batch or task."""
        cut = np.array([head and r[4] == rows[0][4] or tail and r[4] == rows[-1][4] for r in rows])
        got = shared(rows, min_words, gram, cut)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], pa.int64()) for k in range(4)], ["key", "th", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head = [], True
        for batch in batches:
            rows = held + list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            if not rows:
                continue
            last = rows[-1][4]
            begin = next((i + 1 for i in range(len(rows) - 1, -1, -1) if rows[i][4] != last), 0)
            if len(rows) - begin > HOLD:
                yield found(rows, head, True)
                held, head = [], True
            else:
                if begin:
                    yield found(rows[:begin], head, False)
                    head = False
                held = rows[begin:]
        if held:
            yield found(held, head, True)

    return run


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching [start, end) of equal ``keys`` joined."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    ahead = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", (F.coalesce(ahead, F.lit(-1)) < F.col("start")).cast("int"))
    return fresh.withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, start_word, end_word, n_words) of every passage of ``min_words`` and more that another document holds."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text, F.length(text)).alias("th"), text.alias("text"))
    seeds = common.materialize(rows.select("th", "text").mapInArrow(_seeds(min_words, gram), "seed long, th long, pos long"), "seeds")
    names = common.materialize(rows.select("doc_id", "th"), "names")
    again = seeds.where("seed is not null").groupBy("seed").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a < b").select("seed")
    again = common.materialize(again, "again")
    places = seeds.join(again, "seed").groupBy("th").agg(F.collect_set("pos").alias("at"))
    groups = names.groupBy("th").agg(F.count("*").alias("copies"), F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("id"))
    chosen = places.join(groups, "th").select("th", "id", "at")
    keyed = rows.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).drop("doc_id")
    picked = keyed.join(chosen, ["th", "id"]).dropDuplicates(["th", "id"]).select("th", "text", "at")
    suffixes = picked.mapInArrow(_suffixes(min_words, gram), "right binary, left binary, th long, pos long")
    keyed = suffixes.select("*", F.xxhash64(F.substring("right", 1, 4 * gram)).alias("gram"), F.xxhash64("right").alias("suffix"))
    dealt = keyed.repartitionByRange("gram", "suffix", "th", "pos").drop("suffix").sortWithinPartitions("gram", "right", "left", "th", "pos")
    compared = common.materialize(dealt.mapInArrow(_compare(min_words, gram), SHARED), "matches")
    cut = compared.where("key is not null")
    across = common.materialize(cut.groupBy("key").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a < b").select("key"), "across")
    extra = cut.where("start is not null").join(across, "key").select("th", "start", (F.col("start") + min_words).alias("end"))
    whole = seeds.where("seed is null").select("th", F.col("pos").alias("words")).dropDuplicates(["th"]).join(groups.where("copies > 1"), "th").where(F.col("words") >= min_words).select("th", F.lit(0).cast("long").alias("start"), F.col("words").alias("end"))
    spans = compared.where("key is null").select("th", "start", "end").unionByName(extra).union(whole)
    found = common.materialize(islands(spans, ["th"]).join(groups.select("th", "copies"), "th"), "passages")
    return common.hot_join(names, found, ["th"], "copies", names.count()).select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"))


def op9_sparse_suffix_array(spark, sf_dir: str) -> DataFrame:
    return repeated(common.documents(spark, sf_dir))


QUERIES = {"op9_sparse_suffix_array": op9_sparse_suffix_array}
ORACLES: dict[str, str] = {}
