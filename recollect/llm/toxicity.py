"""Toxicity (operator 1): non-negative positive-unlabelled learning in numpy.

Confirmed toxic examples and unlabelled text train three linear classifiers over the
presence of words and of their beginnings. The risk is pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)): where the
corrected negative part falls below zero its gradient is reversed, as in the
non-negative estimator. Each classifier sees another half of the unlabelled text; a soft
threshold keeps their weights sparse; a text's score is the mean of their
probabilities. The class prior pi is a parameter, by default the toxic share among the labelled
training rows.

At most ``positives`` toxic and ``unlabelled`` other documents train (in expectation, chosen
by a hash of the id); terms are those in at least ``least`` of them, so the sample bounds their number. Null and empty texts have no words and get the bias' score.
Without any confirmed example every score is 0. Rows with null id are neither trained on
nor held out; repeated rows are scored each; an empty table gives no rows. Columns
other than those named are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import common

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of words that are terms beside the words.
STEMS = (4, 5)


def terms(text: str | None) -> set[str]:
    """Words, and the beginnings of longer ones: insults are inflected and compounded."""
    words = set(WORD.findall((text or "").lower()))
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sorted(terms(t)) for t in batch.column(2).to_pylist()], pa.list_(pa.string()))], ["positive", "h", "terms"])


def risk(sp: np.ndarray, su: np.ndarray, prior: float, beta: float = 0.0) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The risk of scores of positive and unlabelled rows, its negative part, and the descent's gradients by both scores."""
    sigmoid = lambda s: 1 / (1 + np.exp(-np.clip(s, -50, 50)))
    negative = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
    gp, gu, back = -prior * sigmoid(-sp) / len(sp), sigmoid(su) / len(su), -prior * sigmoid(sp) / len(sp)
    value = prior * np.logaddexp(0, -sp).mean() + max(0.0, negative)
    return (value, negative, gp + back, gu) if negative >= -beta else (value, negative, -back, -gu)


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, steps: int = 300, rate: float = 0.05, l1: float = 3e-4, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier by the non-negative risk estimate (logistic loss, Adam, soft threshold)."""

    def matrix(rows):
        lens = np.array([len(r) for r in rows])
        flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        return flat, np.repeat(np.arange(len(rows)), lens), len(rows)

    def scores(m, w, b):
        return np.bincount(m[1], w[m[0]], minlength=m[2]) + b

    def gradient(m, g):
        return np.bincount(m[0], g[m[1]], minlength=size), g.sum()

    p, u = matrix(positive), matrix(unlabelled)
    w, b = np.zeros(size), math.log(prior / (1 - prior))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        _, _, by_p, by_u = risk(scores(p, w, b), scores(u, w, b), prior, beta)
        gw, gb = gradient(p, by_p)
        hw, hb = gradient(u, by_u)
        g = np.r_[gw + hw, gb + hb]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:size], b - step[size]
        cut = rate * l1 / (np.sqrt(v[:size] / (1 - 0.999**t)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - cut, 0)
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = 2000, unlabelled: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", least: int = 3) -> tuple[dict[str, tuple[float, ...]], tuple[float, ...]]:
    """Words' weights and the biases of the classifiers, from training rows only.

    The sampled ids of toxic documents are as many as ``positives`` at most in expectation, so they are broadcast.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic"))
    found = marked.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
    if not found["toxic"]:
        return {}, ()
    prior = min(max(prior or found["toxic"] / found["n"], 0.005), 0.5)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    count = rows.count()
    below = lambda rate: F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, rate) * (1 << 30))
    toxic = marked.where("toxic = 1").where(below(positives / found["toxic"])).select("id", F.lit(True).alias("positive"))
    drawn = rows.join(F.broadcast(toxic), "id", "left").withColumn("drawn", below(unlabelled / max(count, 1))).where("positive or drawn")
    sample = drawn.select(F.explode(F.filter(F.array(F.when(F.col("positive"), True), F.when(F.col("drawn"), False)), lambda x: x.isNotNull())).alias("positive"), F.xxhash64("id").alias("h"), "text")
    table = sample.mapInArrow(_terms, "positive boolean, h long, terms array<string>").toArrow()
    data = sorted(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), table.column(2).to_pylist(), strict=True))
    frequency = Counter(t for _, _, ts in data for t in ts)
    words = {t: i for i, (t, n) in enumerate(sorted(frequency.items(), key=lambda x: (-x[1], x[0]))) if n >= least}
    encode = lambda ts: np.array([words[t] for t in ts if t in words], np.int64)
    p = [encode(ts) for positive, _, ts in data if positive]
    u = [encode(ts) for positive, _, ts in data if not positive]
    if not p or not u:
        return {}, ()
    halves = [u[0::2] or u, u[1::2] or u, u]
    models = [nnpu(p, half, len(words), prior) for half in halves]
    weights = {t: tuple(float(w[i]) for w, _ in models) for t, i in words.items() if any(w[i] for w, _ in models)}
    return weights, tuple(b for _, b in models)


def score(docs: DataFrame, weights: dict, biases: tuple, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns and (score, predicted) of every row; a kept column may not have such a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weights.keys()
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                hits = [weights[t] for t in terms(text) & known]
                sums = [b + math.fsum(h[k] for h in hits) for k, b in enumerate(biases)]
                out.append(sum(1 / (1 + math.exp(-max(-500.0, s))) for s in sums) / len(sums) if sums else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())], [*batch.schema.names[1:], "new_0", "new_1"])

    return common.beside(docs, text_col, keep, run, [("score", "double"), ("predicted", "int")])


def op1_toxicity_nnpu(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    fold = common.crc_fold("doc_id", 5)
    weights, biases = fit(docs.where(fold != 0), labels.where(fold != 0))
    return score(docs.select("doc_id", "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out")), weights, biases, ["doc_id", "held_out"])


QUERIES = {"op1_toxicity_nnpu": op1_toxicity_nnpu}
ORACLES: dict[str, str] = {}
