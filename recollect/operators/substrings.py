"""Substring search by postings: which texts contain a word anywhere, by equi-joins instead of comparing every word with every text.

A text's postings are its distinct runs of one, two and three characters. A word of up to three characters is such a run itself; of a longer
one the run that the fewest texts have gives the candidates, and ``contains`` decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import materialize

#: Longest runs.
RUN = 3
#: Words up to this number are broadcast; more are joined by a shuffle.
FEW = 10_000
#: Runs up to this number are looked for inside of each text's array of runs; more meet the texts' exploded runs in a join.
SOME = 2_000


def runs(text: Column, n: int) -> Column:
    """All runs of ``n`` characters; characters are split once, so long texts cost in proportion to their length."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(text) - (n - 1), F.lit(1))), lambda i: F.concat(*[F.get(text, i - 1 + k) for k in range(n)]))


def postings(texts: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(run, node) of ``texts`` (node, text): each distinct run of a text once, or those ``wanted`` alone. Write it where many searches follow."""
    sizes = sorted({len(r) for r in wanted}) if wanted is not None else range(1, RUN + 1)
    split = texts.where("text <> ''").select("node", F.split("text", "").alias("c"))
    if wanted is not None:
        hits = [F.array_intersect(runs(F.col("c"), n), F.array(*[F.lit(r) for r in wanted if len(r) == n])) for n in sizes]
        return split.select("node", F.explode(F.concat(*hits) if hits else F.array().cast("array<string>")).alias("run"))
    every = F.concat(*[runs(F.col("c"), n) for n in sizes])
    return split.select("node", F.explode(F.array_distinct(F.filter(every, lambda r: r.isNotNull()))).alias("run"))


#: Words up to this number are looked for in each text one by one.
ALONE = 16
#: Pieces of texts whose words a task remembers.
KNOWN = 500_000


def newest(texts: DataFrame, words: DataFrame, limit: int, index: DataFrame | None = None) -> DataFrame:
    """(word, node, at): of the texts of ``texts`` (node, text, at) that contain a word of ``words`` the ``limit`` newest by ``at``, then by node.

    All texts are looked through; a task keeps no more than the newest of each word, so what is shuffled grows with the words. ``index`` is as for
    ``search``, which takes the place of the pass over the texts, as it does for more than ``FEW`` words.
    """
    asked = words.where("word <> ''").select("word").distinct()
    some = sorted(r["word"] for r in asked.limit(FEW + 1).collect()) if index is None else []
    if index is not None or len(some) > FEW:
        found = search(texts, asked, index).join(texts.select("node", "at"), "node")
    elif len(some) <= ALONE:
        within = F.filter(F.array(*map(F.lit, some)).cast("array<string>"), lambda w: F.contains("text", w))
        found = texts.select("node", "at", F.explode(within).alias("word"))
    else:
        kinds = dict(texts.dtypes)
        pieces = texts.where("text is not null").select("node", "at", "text")
        found = pieces.mapInArrow(_leading(some, limit), f"word string, node {kinds['node']}, at {kinds['at']}")
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("at"), "node"))
    return found.select("word", "node", "at").withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def _leading(words: list[str], limit: int):
    """The newest texts of each word among those of a task; a word without a space lies in a piece between spaces, and most pieces come again."""
    number = {w: i for i, w in enumerate(words)}
    spaced, heads = [w for w in words if " " in w], {}
    for w in words:
        heads.setdefault(w[:2], set()).add(len(w))

    def held_by(piece: str) -> tuple[int, ...]:
        found = {number[c] for c in piece if c in number}
        for i in range(len(piece) - 1):
            for k in heads.get(piece[i : i + 2], ()):
                if (w := piece[i : i + k]) in number:
                    found.add(number[w])
        return tuple(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        best: list[list] = [[] for _ in words]
        floor = [-(1 << 63)] * len(words)
        schema = None
        for batch in batches:
            schema = batch.schema
            times = [-(1 << 63) if at is None else at for at in batch.column(1).cast(pa.int64()).to_pylist()]
            rows = zip(times, batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for at, node, text in sorted(rows, key=lambda r: -r[0]):  # the newest first: most of the others are then too old for most words
                held = {number[w] for w in spaced if w in text}
                for piece in set(text.split(" ")):
                    if (found := known.get(piece)) is None:
                        if len(known) >= KNOWN:
                            known.clear()
                        found = known[piece] = held_by(piece)
                    if found:
                        held.update(found)
                for w in held:
                    if at >= floor[w]:
                        best[w].append((-at, node))
                        if len(best[w]) >= 2 * limit:
                            best[w] = sorted(best[w])[:limit]
                            floor[w] = -best[w][-1][0]
        if schema is not None:
            rows = [(words[w], node, None if at == 1 << 63 else -at) for w, own in enumerate(best) for at, node in sorted(own)[:limit]]
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], schema.field(0).type), pa.array([r[2] for r in rows], pa.int64()).cast(schema.field(1).type)]
            yield pa.RecordBatch.from_arrays(columns, ["word", "node", "at"])

    return run


def search(texts: DataFrame, words: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(word, node) of every text of ``texts`` (node, text) that contains a word of ``words`` (word), empty ones left out.

    ``index`` are written ``postings`` of the same texts; without it those of the runs that the words need are made for this search.
    """
    asked = words.where("word <> ''").select("word").distinct()
    small = F.broadcast if asked.count() <= FEW else (lambda df: df)
    split = asked.select("word", F.split("word", "").alias("c"))
    own = F.when(F.size("c") <= RUN, F.array("word")).otherwise(runs(F.col("c"), RUN))
    parts = split.select("word", F.explode(F.array_distinct(own)).alias("run"))
    if index is None:
        some = [r["run"] for r in parts.select("run").distinct().limit(SOME + 1).collect()]
        index = materialize(postings(texts, some if len(some) <= SOME else None).join(small(parts.select("run").distinct()), "run", "left_semi"), "postings")
    met = index.join(small(parts.select("run").distinct()), "run", "left_semi")
    uses = met.groupBy("run").agg(F.count("*").alias("n"))
    rarest = parts.join(uses, "run", "left").groupBy("word").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0).cast("long")), "run")).alias("run"))
    found = met.join(small(rarest), "run").select("word", "node")
    exact = found.where(F.length("word") <= RUN)
    longer = found.where(F.length("word") > RUN).join(texts.select("node", "text"), "node").where(F.contains("text", F.col("word")))
    return exact.unionByName(longer.select("word", "node"))
