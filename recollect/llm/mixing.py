"""Mixing sources to target weights (operator 3): Poisson replication.

A source's rate is its target share of the mixed corpus over its share of the corpus,
measured in code points over all documents. Each document is copied as often as a Poisson
variable of that mean says, which is found by inverting the distribution at a hash of
the seed and the id; copies are spread over the whole corpus by the order of another hash.
A rate below one leaves some documents out: that is the sampling asked for.

By default a source's target weight is the square root of its size. Null sources form one source
of their own and stay null; null text has size 0; a source of size 0 has rate 1. Rows with equal ids are copied
equally often. An empty table gives no rows. Other columns, whatever their names, are carried along unchanged,
but those with the names of the two new ones (``copy`` and ``shuffle_key``, or what ``names`` says) are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import common

SEED = "mix"
#: As many sources at most are broadcast with their distributions (under 10 MB): those with the most rows.
FEW = 2_000


def rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, rate, rows) of every source; ``weights`` are relative target shares, a source without one has 0."""
    size = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0)).cast("double").alias("size"), F.count("*").alias("rows"))
    size = common.materialize(size, "sizes")
    weight = F.pow("size", F.lit(temperature))
    if weights is not None:
        weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for s, w in weights.items() for x in (s, float(w))]), F.col("source")), F.lit(0.0)) if weights else F.lit(0.0)
    weighed = size.withColumn("weight", weight)
    total = weighed.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    share = F.col("weight") / F.lit(total["weight"] or 1.0) * F.lit(epochs * (total["size"] or 0.0))
    return weighed.select("source", F.when(F.col("size") > 0, share / F.col("size")).otherwise(F.lit(float(epochs))).alias("rate"), "rows")


def distributions(table: DataFrame) -> DataFrame:
    """(source, rate, below): the cumulated probabilities of 0, 1, 2 ... copies, up to far beyond the mean."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    log = F.lit(0.0)
    terms = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(log.alias("log"), F.exp(-F.col("rate")).alias("sum"), F.array(F.exp(-F.col("rate"))).alias("below")),
        lambda s, k: _step(s, k),
        lambda s: s["below"],
    )
    return table.withColumn("below", F.when(F.col("rate") > 0, terms).otherwise(F.array(F.lit(1.0))))


def _step(s, k):
    log = s["log"] + F.ln("rate") - F.ln(k.cast("double"))
    total = s["sum"] + F.exp(log - F.col("rate"))
    return F.struct(log.alias("log"), total.alias("sum"), F.concat(s["below"], F.array(total)).alias("below"))


def uniform(*parts):
    """A number in [0, 1) from an MD5 of the parts' text: 13 hexadecimal digits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, names: tuple[str, str] = ("copy", "shuffle_key"), **target) -> DataFrame:
    """``docs`` with ``copy`` (from 1) and ``shuffle_key``, or what ``names`` calls them, in the order of that key.

    The distributions of the ``FEW`` sources with the most rows are broadcast; each other source has less than
    a ``FEW``-th of all rows, and is joined by a shuffle.
    """
    found = rates(docs, source_col, text_col, **target)
    most = found.orderBy(F.desc("rows"), "source").limit(FEW).select("source")
    table = distributions(found).select("source", "below")
    heavy, light = (table.join(F.broadcast(most.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")), how) for how in ("left_semi", "left_anti"))
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    number, place = names
    keyed = docs.select(F.struct(*columns).alias("row"), F.col(source_col).cast("string").alias("from"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("ident"))
    same = F.col("from").eqNullSafe(F.col("source"))
    joined = keyed.join(F.broadcast(heavy), same, "left")
    if not light.isEmpty():
        joined = joined.where("below is not null").unionByName(joined.where("below is null").drop("source", "below").join(light.hint("merge"), same))
    n = F.size(F.filter("below", lambda c: c <= F.col("u")))
    counted = joined.withColumn("u", uniform(F.lit(seed), F.col("ident"))).withColumn("n", n).where("n > 0")
    copies = counted.select("row", "ident", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    mixed = copies.select("row.*", F.col("copy").alias(number), F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), "ident", F.col("copy").cast("string"))).alias(place))
    return mixed.repartitionByRange(place).sortWithinPartitions(place)


def op3_poisson_mix(spark, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir).select("doc_id", "text", "lang", "source", "n_chars"))


SQL = """
WITH sizes AS (SELECT source AS s, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS size FROM documents GROUP BY 1),
total AS (SELECT sum(size) AS size, sum(pow(size, 0.5)) AS weight FROM sizes),
rates AS (SELECT s, CASE WHEN sizes.size > 0 THEN pow(sizes.size, 0.5) / total.weight * total.size / sizes.size ELSE 1.0 END AS rate FROM sizes, total),
terms AS (SELECT s, k, exp(-rate + k * ln(rate) - lgamma(k + 1.0)) AS p FROM (SELECT s, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM rates)),
below AS (SELECT s, list(c ORDER BY k) AS cs FROM (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM terms) GROUP BY 1),
drawn AS (SELECT *, CAST(concat('0x', substr(md5(concat('mix:', CAST(doc_id AS VARCHAR))), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, len(list_filter(cs, lambda c: c <= u)) AS n FROM drawn d JOIN below b ON b.s IS NOT DISTINCT FROM d.source),
copied AS (SELECT * EXCLUDE (n), unnest(range(1, n + 1)) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy, md5(concat('mix:order:', CAST(doc_id AS VARCHAR), ':', CAST(copy AS VARCHAR))) AS shuffle_key
FROM copied
"""

QUERIES = {"op3_poisson_mix": op3_poisson_mix}
ORACLES = {"op3_poisson_mix": SQL}
