"""Language identification (operator 5): sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased text are hashed into 2**16 features.
Document frequencies are counted over all training documents; the weights are
trained with follow-the-regularised-leader (proximal, elastic net) on a sample of at
most ``per_lang`` training documents a language in expectation, chosen by a hash of
the id; every fifth of them is kept aside to fit the temperature of the softmax.
Term frequency is relative to the text's n-grams, so a score is a mean over a text
of any length and needs one pass over it.

Null text, and text without a letter, gives ``und`` with score 0. Where no labelled
training document exists every text is ``und``. Rows with null id are never
trained on and are not held out; repeated rows are scored each. An empty table gives
no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import common

ORDERS, BITS = 3, 16
SIZE = 1 << BITS
BLOCK = 1 << 18
FACTORS = (2654435761, 2246822519, 3266489917)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (SIZE + 1, languages): weight times inverse document frequency; the last row is zero
    bias: np.ndarray
    temperature: float


def blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """Blocks of about a quarter of a million characters: (document of each piece, where it starts, features by order, n-grams of each piece).

    A longer text is cut into pieces that share their edges' n-grams once.
    """
    doc, piece, own, held = [], [], [], 0

    def out():
        lens = np.array([len(p) for p in piece])
        starts = np.r_[0, np.cumsum(lens)[:-1]]
        codes = np.frombuffer("".join(piece).encode("utf-32-le", "surrogatepass"), "<u4")
        ahead = [np.r_[codes[n:], np.zeros(n, np.uint32)] for n in range(ORDERS)]
        features, total = [], np.zeros(len(piece), np.int64)
        mixed = np.zeros(len(codes), np.uint32)
        for n in range(ORDERS):
            mixed = mixed + ahead[n] * np.uint32(FACTORS[n])
            x = (((mixed ^ (mixed >> np.uint32(15))) + np.uint32(n * 40503)) * np.uint32(668265263) >> np.uint32(32 - BITS)).astype(np.int32)
            limit = np.maximum(np.minimum(np.array(own), lens - n), 0)
            total += limit
            for j in range(1, ORDERS + 2):
                at = lens - limit >= j
                x[(starts + lens - j)[at]] = SIZE
            features.append(x)
        return np.array(doc), starts, features, total

    for i, text in enumerate(texts):
        text = f" {text.lower()} "
        for a in range(0, len(text), BLOCK):
            p = text[a : a + BLOCK + ORDERS - 1]
            doc.append(i)
            piece.append(p)
            own.append(min(BLOCK, len(p)))
            held += len(p)
            if held >= BLOCK:
                yield out()
                doc, piece, own, held = [], [], [], 0
    if piece:
        yield out()


def sums(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Mean of the table's rows over each text's n-grams."""
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    for doc, starts, features, n in blocks(texts):
        values = table.take(features[0], axis=0)
        for x in features[1:]:
            values += table.take(x, axis=0)
        np.add.at(total, doc, np.add.reduceat(values, starts, axis=0))
        np.add.at(count, doc, n)
    return total / np.maximum(count, 1)[:, None]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition: (feature, documents that have it); feature -1 counts the documents."""
    df, docs, mark = np.zeros(SIZE + 1, np.int64), 0, np.zeros(SIZE + 1, bool)
    for batch in batches:
        last = None
        for doc, starts, features, _ in blocks(batch.column(0).to_pylist()):
            ends = [*starts[1:].tolist(), len(features[0])]
            for i, a, b in zip(doc.tolist(), starts.tolist(), ends, strict=True):
                if i != last:
                    df += mark
                    mark[:] = False
                    docs, last = docs + 1, i
                for x in features:
                    mark[x[a:b]] = True
        df += mark
        mark[:] = False
    found = np.flatnonzero(df[:SIZE])
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, found], pa.int32()), pa.array(np.r_[docs, df[found]], pa.int64())], ["feature", "docs"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, calibrate, features, counts) of each text."""
    for batch in batches:
        texts, parts = batch.column(2).to_pylist(), {}
        for doc, starts, features, _ in blocks(texts):
            ends = [*starts[1:].tolist(), len(features[0])]
            for i, a, b in zip(doc.tolist(), starts.tolist(), ends, strict=True):
                parts.setdefault(i, []).extend(x[a:b] for x in features)
        unique = [np.unique(np.concatenate(parts[i]), return_counts=True) for i in range(len(texts))]
        unique = [(u[u < SIZE], c[u < SIZE]) for u, c in unique]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([u for u, _ in unique], pa.list_(pa.int32())), pa.array([c for _, c in unique], pa.list_(pa.int64()))], ["lang", "calibrate", "features", "counts"])


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, alpha=0.3, beta=1.0, l1=0.02, l2=1e-3, epochs=3, seed=5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (SIZE, classes) and bias of a softmax regression, by proximal FTRL with an elastic net."""
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))
    weights = lambda i: np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            y, i, x = rows[r]
            i, x = np.append(i, SIZE), np.append(x, 1.0)
            w = weights(i)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weights(np.arange(SIZE + 1))
    return w[:SIZE], w[SIZE]


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(s: np.ndarray, y: np.ndarray) -> float:
    """The softmax temperature of least log loss."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(-4, 3, 141))
    loss = [-np.mean(np.log(np.maximum(softmax(s / t)[np.arange(len(y)), y], 1e-12))) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = 800) -> Model | None:
    """A model of the labelled rows of ``docs``; None where there are none."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("h")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    langs = sorted(counts)
    df = rows.select("text").mapInArrow(_frequencies, "feature int, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).toArrow()
    feature, docs_with = df.column("feature").to_numpy(), df.column("docs").to_numpy()
    total = int(docs_with[feature == -1].sum())
    idf = np.full(SIZE, np.log(1.0 + total) + 1)
    idf[feature[feature >= 0]] = np.log((1.0 + total) / (1.0 + docs_with[feature >= 0])) + 1
    rate = F.create_map(*[F.lit(v) for lang in langs for v in (lang, min(1.0, per_lang / counts[lang]))])
    chosen = rows.where(F.pmod("h", F.lit(1 << 20)) < F.element_at(rate, F.col("lang")) * (1 << 20))
    sample = chosen.select("lang", (F.pmod(F.shiftright("h", 24), F.lit(5)) == 0).alias("calibrate"), "text").mapInArrow(_sparse, "lang string, calibrate boolean, features array<int>, counts array<long>").toArrow()
    rows = []
    for lang, aside, f, c in zip(*(sample.column(k) for k in sample.column_names), strict=True):
        i, c = f.values.to_numpy(), c.values.to_numpy()
        rows.append((langs.index(lang.as_py()), aside.as_py(), i, c / max(c.sum(), 1) * idf[i]))
    rows.sort(key=lambda r: (r[0], len(r[2]), r[2].tolist()))
    scale = 1 / max(np.mean([np.sqrt((x * x).sum()) for _, _, _, x in rows]), 1e-9) if rows else 1.0
    train = [(y, i, x * scale) for y, aside, i, x in rows if not aside] or [(y, i, x * scale) for y, _, i, x in rows]
    weights, bias = ftrl(train, len(langs))
    aside = [(y, x * scale @ weights[i] + bias) for y, a, i, x in rows if a]
    t = temperature(np.array([s for _, s in aside]).reshape(-1, len(langs)), np.array([y for y, _ in aside], int))
    return Model(langs, np.vstack([weights * idf[:, None] * scale, np.zeros(len(langs))]).astype(np.float32), bias, t)


def predict(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns and (lang_pred, score), or what ``names`` calls them, of every row; a kept column may not have such a name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model else []
            if known:
                p = softmax((sums([texts[i] for i in known], model.table) + model.bias) / model.temperature)
                lang[known], score[known] = np.array(model.langs, object)[p.argmax(axis=1)], p.max(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names[1:], "new_0", "new_1"])

    return common.beside(docs, text_col, keep, run, [(names[0], "string"), (names[1], "double")])


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    fold = common.crc_fold("doc_id", 4)
    model = fit(docs.where(fold != 2))
    return predict(docs.select("doc_id", "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out")), model, ["doc_id", "held_out"])


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict[str, str] = {}
