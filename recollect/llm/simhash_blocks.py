"""Document fingerprints (operator 2): SimHash, and search by permuted block tables. Built-in functions only.

Terms are pairs of neighbouring words of the lower-cased text; a term votes with its
hash's bits and weighs as many characters as its words have, 24 at most, so
frequent short words count little. 32 sums of 64-bit lanes hold the votes of all
64 bits. Equal texts have equal fingerprints, and a fingerprint needs its text alone.

The search cuts a fingerprint into ``radius + 2`` blocks. Two fingerprints within the
radius agree on some two blocks, so a table for each choice of two, keyed by those
blocks, finds all of them; a pair is taken in the first table that holds it, so
nothing is found twice and nothing needs to be made distinct.

Null text counts as empty; a text without words has fingerprint zero. The next document is
that of the next greater id; where rows repeat an id, the least of their texts. Rows
with null id have no next document and lose their last quarter. An empty table gives no rows.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm import common
from recollect.llm.simhash_tiles import SPACE, majority, vote

HEAVIEST = 24
RADIUS = 3


def words(text):
    return F.split(F.btrim(F.lower(text), F.lit(SPACE)), r"[\x20\x09-\x0D]+")


def votes(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys`` and the fingerprint of ``text_col``; ``keys`` tell rows apart."""
    split = rows.select(*keys, words(F.col(text_col)).alias("w"))
    pairs = split.select(*keys, F.inline_outer(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))))
    pairs = pairs.where("b is not null or a is not null")
    weight = F.least(F.length("a") + F.coalesce(F.length("b"), F.lit(0)), F.lit(HEAVIEST)).cast("long")
    hashed = pairs.select(*keys, F.xxhash64("a", "b").alias("h"), weight.alias("weight"))
    return hashed.groupBy(*keys).agg(*vote(F.col("h"), F.col("weight")), F.sum("weight").alias("n")).select(*keys, majority(F.col("n")).alias("fp"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint long) of every row."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return votes(rows, ["uid", "doc_id"], "text").select("doc_id", F.col("fp").alias("fingerprint"))


def following(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) of distinct ids; the last one's next is the first.

    Ids are dealt by range; where a range ends, the next range's first id follows. That
    table has a row for each partition.
    """
    dealt = common.materialize(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    inside = dealt.select("doc_id", "part", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")).alias("next_id"))
    firsts = dealt.groupBy("part").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(order), F.min("first").over(whole)).alias("after"))
    return inside.join(firsts, "part").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, key, doc_id, next_id, text, edited): the last quarter of each text replaced by the next document's beginning.

    Texts are shuffled once by id, and both joins read that exchange (their inputs have the same columns and no filter); of
    each text a quarter at most goes on to the document before it. Rows without an id are keyed by their row.
    """
    uid = F.monotonically_increasing_id()
    rows = docs.select(uid.alias("uid"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("_"), uid.cast("string"))).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).hint("merge")
    sizes = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.length(text_col), F.lit(0))).alias("chars"))
    next_of = common.materialize(sizes.join(following(sizes.select("doc_id")), "doc_id"), "next")
    before = next_of.select(F.col("next_id").cast("string").alias("key"), F.col("doc_id").cast("string").alias("before"), F.floor(F.col("chars") / 4).cast("int").alias("k"))
    begin = F.struct(F.expr("left(text, k)").alias("head"), "uid").alias("begin")
    heads = rows.join(before.hint("merge"), "key").select(F.col("before").alias("key"), begin).groupBy("key").agg(F.min("begin").getField("head").alias("head"))
    named = next_of.select(F.col("doc_id").cast("string").alias("key"), "doc_id", "next_id")
    joined = rows.join(named.hint("merge"), "key", "left").join(heads.hint("merge"), "key", "left")
    quarter = F.floor(F.length("text") / 4).cast("int")
    left = F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))")
    return joined.select("uid", "key", "doc_id", "next_id", "text", F.concat(left, F.substring(F.coalesce("head", F.lit("")), F.lit(1), quarter)).alias("edited"))


def likeness(a, b):
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64


def masks(radius: int) -> list[int]:
    """The bits of each table's two blocks, as signed 64-bit integers."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [m - (1 << 64) if (m := sum(c)) >> 63 else m for c in combinations(blocks, 2)]


def search(classes: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, fp, n) for all of ``classes`` (distinct fp, n rows of it) within ``radius`` of each of ``queries`` (distinct query)."""
    tables = masks(radius)
    keyed = lambda df, c: df.withColumn("t", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(tables)]))).select("*", "t.i", "t.key").drop("t")
    differ = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(tables)])
    left, right = keyed(queries, "query").alias("q"), keyed(classes, "fp").alias("c")
    on = (F.col("q.i") == F.col("c.i")) & (F.col("q.key") == F.col("c.key")) & (F.bit_count(differ) <= radius) & (first == F.col("c.i"))
    return right.join(left, on).select("query", "fp", "n")


def op2_simhash_blocks(spark, sf_dir: str) -> DataFrame:
    """``n_within``: for every document whose id is divisible by 50, the other rows within three bits."""
    rows = edited(common.documents(spark, sf_dir))
    both = rows.select("uid", "key", "doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("v")).select("*", "v.which", "v.text").drop("v")
    keys = ["uid", "key", "doc_id", "next_id", "n_chars", "edited_sha256"]
    found = votes(both, [*keys, "which"], "text")
    pick = lambda i: F.max(F.when(F.col("which") == i, F.col("fp")))
    found = common.materialize(found.groupBy(*keys).agg(pick(0).alias("fp"), pick(1).alias("edited_fp")), "fingerprints")
    classes = found.groupBy("fp").agg(F.count("*").alias("n"))
    near = search(classes, found.where("doc_id % 50 = 0").select(F.col("fp").alias("query")).distinct()).groupBy("query").agg((F.sum("n") - 1).alias("n_within"))
    after = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("next_id")).agg(F.min("fp").alias("next_fp"))
    joined = found.join(after, "next_id", "left").join(near.withColumnRenamed("query", "fp"), "fp", "left")
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return joined.select("doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), F.when(F.col("doc_id") % 50 == 0, F.col("n_within")).alias("n_within"))


QUERIES = {"op2_simhash_blocks": op2_simhash_blocks}
ORACLES: dict[str, str] = {}
