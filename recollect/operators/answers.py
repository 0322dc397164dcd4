"""Extractive answers and a learned re-scorer."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import r4

REFUSE = 0.15
#: Signals that a scorer needs at least.
ENOUGH = 50


def words(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), F.lit(1)))


def sentences(x: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(x, r"([.!?])[ \t\r\n]+", "$1\n"), "\n"), lambda s: F.trim(s) != "")


def best_sentence(questions: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, answer, score): of a key's texts the sentence that shares most words with the question, long ones less; null if too few."""
    q = questions.select(key, words(F.col("question")).alias("__q"))
    s = texts.select(key, F.explode(sentences(F.col("text"))).alias("sentence")).join(q, key)
    share = F.size(F.array_intersect(words(F.col("sentence")), "__q")).cast("double") / F.greatest(F.size("__q"), F.lit(1))
    scored = s.withColumn("score", r4(share / (1 + 0.002 * F.greatest(F.length("sentence") - 80, F.lit(0)))))
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("minus"), "sentence")).alias("b"))
    return best.select(key, F.when(-F.col("b.minus") >= REFUSE, F.col("b.sentence")).alias("answer"), (-F.col("b.minus")).alias("score"))


def train_scorer(signals: DataFrame) -> PipelineModel | None:
    """A model of (text, used 0/1) on TF-IDF; None where there are too few signals or one class alone."""
    seen = signals.agg(F.count("*").alias("n"), F.sum("used").alias("used")).first()
    if seen["n"] < ENOUGH or not seen["used"] or seen["used"] == seen["n"]:
        return None
    stages = [RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\W+"), HashingTF(inputCol="words", outputCol="tf", numFeatures=1 << 14), IDF(inputCol="tf", outputCol="features", minDocFreq=2), LogisticRegression(labelCol="used", maxIter=20, regParam=0.01)]
    return Pipeline(stages=stages).fit(signals.select("text", F.col("used").cast("double").alias("used")))


def adjust(rows: DataFrame, model: PipelineModel | None, score: str) -> DataFrame:
    """``rows`` (text, score) with ``adjusted``: the score moved by the model's opinion, 0.3 at most, within 0 and 1."""
    if model is None:
        return rows.withColumn("adjusted", F.col(score))
    out = model.transform(rows)
    opinion = 0.3 * (2 * vector_to_array("probability")[1] - 1)
    return out.withColumn("adjusted", r4(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score) + opinion)))).select(*rows.columns, "adjusted")
