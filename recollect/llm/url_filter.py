"""URL filters (operator 12): rules by longest match, gradient-boosted trees on lexical features for all other URLs.

A rule ``host/path`` fits its host and all subdomains of it where the URL's path starts with the rule's path; the
longest rule that fits decides. URLs that a rule decides are the labelled ones: trees are boosted on them (logistic
loss, Newton steps, histograms of quantile bins) and judge the URLs without a rule.

Features are lexical: lengths of the URL and its parts, depth of the path, labels of the host, share of digits,
entropy, parameters, and statistics of the suffixes (last label and last two labels of the host, ending of the path):
how many URLs have the suffix and which part of its labelled ones is blocked. These statistics count all rows. They
lie in a table of 2**16 hashed suffixes, so their size is fixed; a training row sees only the counts of the
other folds. The trees learn from at most ``train_rows`` labelled URLs in expectation, drawn by a hash of the URL.

Null URLs, and URLs without ``://``, have an empty host and path, which no rule fits; they are judged like any other. Without labelled
URLs, or with one verdict alone among them, all others get that verdict (``allow`` if there is none). Repeated rows are judged each, rows with null id
too. An empty table gives no rows. Only the columns named are read; a kept column may have any name
but those of the results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import common

ALLOW, BLOCK = "allow", "block"
#: Rules are handed to every task, so their number is bounded.
MAX_RULES = 100_000
BITS, FOLDS = 16, 5
BUCKETS = 1 << BITS
#: Weight of the prior in a suffix's share of blocked URLs.
SMOOTHING = 10.0
PARTS = re.compile(r"(?s)\A.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?(#)?")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Features before those of the suffixes.
PLAIN = ["length", "host_length", "path_length", "query_length", "depth", "labels", "hyphens", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "parameters", "fragment"]
SUFFIXES = 3


def parts(url: str | None) -> tuple[str, str, str, bool]:
    """Host (A-Z lower-cased), path, query, and whether there is a fragment."""
    found = PARTS.match(url) if url else None
    return (found[1].translate(LOWER), found[2], found[3] or "", found[4] is not None) if found else ("", "", "", False)


class Rules:
    """Rules by host; of those that fit a URL the longest wins."""

    def __init__(self, rules: list[tuple[str, str]]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are handed to every task")
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(LOWER), []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The rule that decides and its verdict, or two nulls."""
        best, at = None, 0
        while host:
            for start, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
            at = host.find(".", at) + 1
            if not at:
                break
        return best or (None, None)


def _entropy(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, digits, and entropy in bits a byte of each text."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    lens = np.array([len(d) for d in data])
    flat = np.frombuffer(b"".join(data), np.uint8)
    row = np.repeat(np.arange(len(data)), lens)
    key, count = np.unique(row * 256 + flat, return_counts=True)
    total = np.maximum(lens, 1)
    p = count / total[key >> 8]
    bits = np.bincount(key >> 8, -p * np.log2(p), minlength=len(data))
    digits = np.bincount(row, (flat >= 48) & (flat <= 57), minlength=len(data))
    return lens, digits, bits


def plain(urls: list[str | None]) -> np.ndarray:
    """The features ``PLAIN`` of each URL."""
    split = [parts(u) for u in urls]
    length, digits, bits = _entropy([u or "" for u in urls])
    host_length, host_digits, host_bits = _entropy([s[0] for s in split])
    columns = [
        length, host_length, [len(s[1]) for s in split], [len(s[2]) for s in split],
        [sum(map(bool, s[1].split("/"))) for s in split], [s[0].count(".") + 1 if s[0] else 0 for s in split], [s[0].count("-") for s in split],
        digits / np.maximum(length, 1), host_digits / np.maximum(host_length, 1), bits, host_bits,
        [s[2].count("&") + 1 if s[2] else 0 for s in split], [s[3] for s in split],
    ]
    return np.array(columns, float).T.reshape(len(urls), len(PLAIN))


def suffixes(urls: list[str | None]) -> np.ndarray:
    """(URLs, 3) hashed suffixes: last label and last two labels of the host, ending of the path."""
    out = np.zeros((len(urls), SUFFIXES), np.int64)
    seen: dict[str, int] = {}

    def bucket(text: str) -> int:
        if (found := seen.get(text)) is None:
            found = seen[text] = zlib.crc32(text.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)
        return found

    for i, (host, path, _, _) in enumerate(map(parts, urls)):
        labels, name = host.rsplit(".", 2), path.rpartition("/")[2]
        out[i] = bucket("1" + labels[-1]), bucket("2" + ".".join(labels[-2:])), bucket("." + name.rpartition(".")[2] if "." in name else "")
    return out


def _fold(urls: list[str | None]) -> np.ndarray:
    return np.array([zlib.crc32(b"fold" + (u or "").encode("utf-8", "surrogatepass")) % FOLDS for u in urls], np.int64)


def _counts():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a partition: (bucket, fold, URLs, labelled, blocked)."""
        table = np.zeros((BUCKETS * FOLDS, 3), np.int64)
        for batch in batches:
            urls = batch.column(0).to_pylist()
            known, bad = (batch.column(1).is_valid().to_numpy(zero_copy_only=False), batch.column(1).fill_null(False).to_numpy(zero_copy_only=False))
            at = (suffixes(urls) * FOLDS + _fold(urls)[:, None]).ravel()
            each = np.repeat(np.c_[np.ones(len(urls), np.int64), known, bad].astype(np.int64), SUFFIXES, axis=0)
            np.add.at(table, at, each)
        found = np.flatnonzero(table[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(table[found, k]) for k in range(3))], ["slot", "urls", "labelled", "blocked"])

    return run


@dataclass
class Trees:
    """Boosted trees of one depth as arrays: inner nodes in breadth-first order, then leaves."""

    edges: list[np.ndarray]  # borders of each feature's bins
    feature: np.ndarray  # (trees, inner nodes)
    border: np.ndarray  # (trees, inner nodes): bins up to this one go left
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], axis=1).astype(np.int16) if len(x) else np.zeros((0, len(self.edges)), np.int16)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of the class 1."""
        binned, total, rows, inner = self.bins(x), np.full(len(x), self.base), np.arange(len(x)), self.feature.shape[1]
        for feature, border, leaf in zip(self.feature, self.border, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and at.size and at[0] < inner:
                at = 2 * at + 1 + (binned[rows, feature[at]] > border[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Gradient-boosted trees for the logistic loss.

    A split must leave a sum of second derivatives of ``least`` / 4 (that of ``least`` undecided rows) on both sides; a node without such a split of positive
    gain sends all rows left.
    """
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    p = min(max(y.mean(), 1e-6), 1 - 1e-6)
    model = Trees(edges, np.zeros((trees, (1 << depth) - 1), np.int64), np.full((trees, (1 << depth) - 1), np.iinfo(np.int16).max, np.int64), np.zeros((trees, 1 << depth)), math.log(p / (1 - p)))
    binned, score = model.bins(x).astype(np.int64), np.full(len(x), model.base)
    width, features = bins + 1, x.shape[1]
    cells = binned + np.arange(features) * width
    for t in range(trees):
        q = 1 / (1 + np.exp(-score))
        g, h = q - y, np.maximum(q * (1 - q), 1e-12)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            slot = ((at - first)[:, None] * features * width + cells).ravel()
            sums = [np.bincount(slot, np.repeat(v, features), minlength=nodes * features * width).reshape(nodes, features, width).cumsum(axis=2) for v in (g, h)]
            left_g, left_h = sums
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
            gain[(left_h < least / 4) | (all_h - left_h < least / 4)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            splits = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            inner = first + np.flatnonzero(splits)
            model.feature[t, inner], model.border[t, inner] = best[splits] // width, best[splits] % width
            at = 2 * at + 1 + (binned[np.arange(len(x)), model.feature[t, at]] > model.border[t, at])
        at -= (1 << depth) - 1
        leaf_g, leaf_h = (np.bincount(at, v, minlength=1 << depth) for v in (g, h))
        model.leaf[t] = -rate * leaf_g / (leaf_h + l2)
        score += model.leaf[t][at]
    return model


@dataclass
class Model:
    counts: np.ndarray  # (BUCKETS, FOLDS, 3): URLs, labelled, blocked
    prior: float
    trees: Trees | None

    def features(self, urls: list[str | None], held: bool) -> np.ndarray:
        """All features; with ``held`` a URL's own fold is left out of the suffixes' counts."""
        at = suffixes(urls)
        seen = self.counts.sum(axis=1)[at]
        if held:
            seen = seen - self.counts[at, _fold(urls)[:, None]]
        share = (seen[:, :, 2] + SMOOTHING * self.prior) / (seen[:, :, 1] + SMOOTHING)
        often = np.log1p(seen[:, :, 0] / max(1, self.counts[:, :, 0].sum()) * 1e6)
        return np.hstack([plain(urls), share, often])

    def predict(self, urls: list[str | None]) -> np.ndarray:
        """The probability that each URL is to be blocked."""
        return self.trees.predict(self.features(urls, False)) if self.trees and urls else np.full(len(urls), self.prior)


def fit(labelled: DataFrame, url_col: str = "url", blocked_col: str = "blocked", train_rows: int = 20_000) -> Model:
    """A model of the rows whose ``blocked_col`` (boolean) is not null; the others count in the suffixes' frequencies."""
    rows = labelled.select(F.col(url_col).alias("url"), F.col(blocked_col).cast("boolean").alias("blocked"))
    table = rows.mapInArrow(_counts(), "slot long, urls long, labelled long, blocked long").groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("urls", "labelled", "blocked")]).toArrow()
    counts = np.zeros((BUCKETS * FOLDS, 3), np.int64)
    counts[table.column("slot").to_numpy()] = np.stack([table.column(c).to_numpy() for c in ("urls", "labelled", "blocked")], axis=1)
    counts = counts.reshape(BUCKETS, FOLDS, 3)
    _, known, bad = (int(n) // SUFFIXES for n in counts.sum(axis=(0, 1)))
    model = Model(counts, bad / known if known else 0.0, None)
    if not 0 < bad < known:
        return model
    drawn = rows.where("blocked is not null").where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(min(1.0, train_rows / known) * (1 << 30))).toArrow()
    urls, y = drawn.column(0).to_pylist(), drawn.column(1).to_numpy(zero_copy_only=False).astype(float)
    order = sorted(range(len(urls)), key=lambda i: (urls[i] or "", y[i]))
    if len(order) and 0 < y.sum() < len(y):
        model.trees = boost(model.features([urls[i] for i in order], True), y[order])
    return model


def labelled(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """(url, blocked) of every row; blocked is null where no rule fits."""
    known = Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = [known.find(*parts(u)[:2])[1] for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if v is None else v == BLOCK for v in verdicts], pa.bool_())], ["url", "blocked"])

    return pages.select(F.col(url_col).alias("url")).mapInArrow(run, "url string, blocked boolean")


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: Model, keep: list[str], url_col: str = "url") -> DataFrame:
    """``keep`` columns and (host, path, rule, verdict, score); score is the trees' probability of ``block``."""
    known = Rules(rules)
    shipped = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(0).to_pylist()
            split = [parts(u) for u in urls]
            found, score = [known.find(s[0], s[1]) for s in split], shipped.value.predict(urls)
            verdict = [v or (BLOCK if p >= 0.5 else ALLOW) for (_, v), p in zip(found, score, strict=True)]
            out = [pa.array([s[0] for s in split], pa.string()), pa.array([s[1] for s in split], pa.string()), pa.array([r for r, _ in found], pa.string()), pa.array(verdict, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *out], [*batch.schema.names[1:], *(f"new_{i}" for i in range(5))])

    return common.beside(pages, url_col, keep, run, [("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string"), ("score", "double")])


#: Rules of the query: fixed values.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op12_url_trees(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES, fit(labelled(pages, RULES)), ["page_id"])


QUERIES = {"op12_url_trees": op12_url_trees}
ORACLES: dict[str, str] = {}
