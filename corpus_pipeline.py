"""The corpus pipeline: language, near-duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import common, langid, mixing, packing, pii, simhash_tiles

#: A document whose language is no likelier than this, or that has no letter, is rejected.
MIN_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the model learns from their own ``lang`` column.

    Null texts and those without a letter go; a null ``lang`` is learnt from by none and judged like any other. Repeated rows and
    rows without id are judged each. Where no row has a ``lang`` there is no model and every row goes; an empty table stays empty.
    """
    columns = docs.columns
    lang, score = common.unused(columns, "lang_pred", "score")
    found = langid.predict(docs, langid.fit(docs), columns, names=(lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= MIN_SCORE)).select(*[F.col(f"`{c}`") for c in columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by op8's contract: 3-word shingles, at most 2 of 64 bits apart.

    Copies whose fingerprints are further apart stay, most of them even at a five-word similarity
    of 0.8 and more; the README gives the measured share.
    """
    return simhash_tiles.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by their kinds; ``n_chars`` follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in a global random order.

    Null sources are one source; a null text has size 0; rows with equal ids are repeated equally often. Columns of any
    name stay as they are; an empty table stays empty.
    """
    names = tuple(common.unused(docs.columns, "copy", "shuffle_key"))
    return mixing.mix(docs, names=names).select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    Null and empty texts have their end id alone; equal rows, copies and rows without id are packed each. Other columns are
    not read. An empty table gives no piece.
    """
    return packing.pack(docs)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: a trained model, components, and a tokenizer; tested against brute-force versions.
ORACLE_SQL = None
