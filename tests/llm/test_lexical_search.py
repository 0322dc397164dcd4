import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from recollect.llm import common, lexical_search as s

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """Every item against every document, in plain Python integers."""
    counts = [(d, Counter(words(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(words(t))
    out = []
    for item, ts in wanted.items():
        found = []
        for d, c in counts:
            m = 10 + (90 * c.total() * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if null else d, -score) for r, (score, null, d) in enumerate(sorted(found)[:k])]
    return Counter(out)


def as_rows(df):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    p = 1 / np.arange(1, 301)
    text = lambda n, lo=0: " ".join(f"W{i + lo}é" if i % 3 else f"w{i + lo}" for i in rng.choice(300, n, p=p / p.sum()))
    docs = [(i, text(int(rng.integers(1, 60)), 100 * (i % 4))) for i in range(700)]
    docs += [(i, docs[3][1]) for i in range(1000, 1040)] + [(None, docs[5][1]), (None, docs[3][1]), (7, docs[7][1]), (7, docs[7][1]), (8000, None), (8001, ""), (8002, "--- !!"), (8003, "w1 w2 " * 30_000)]
    items = [(i, text(12, 100 * (i % 4))) for i in range(60)] + [(60, docs[3][1]), (61, None), (62, ""), (63, "zzz unknown"), (None, "w1, W2É"), (None, "w4"), (5, "w7 w9"), (5, "w7 w9")]
    return docs, items


@pytest.mark.parametrize("k, parts", [(10, 1), (10, 9), (1, 3)])
def test_equals_all_pairs(spark, tables, k, parts):
    docs, items = tables
    got = s.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), spark.createDataFrame(items, "item_id long, text string"), k)
    assert as_rows(got) == brute(docs, items, k)


def test_blocks_small_trees_and_seeds(spark, tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(s, "BLOCK", 9)
    got = s.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3, seeds=50)
    assert as_rows(got) == brute(docs, items, 3)


def test_pairs_are_pruned(tables):
    """Documents of other topics share no node with an item: most pairs of leaves are never scored."""
    docs, items = [], []
    rng = np.random.default_rng(1)
    for topic in range(32):
        docs += [(topic * 1000 + i, " ".join(f"t{topic}w{j}" for j in rng.integers(0, 20, 15))) for i in range(100)]
        items.append((topic, " ".join(f"t{topic}w{j}" for j in range(10))))
    vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, t in items for w in words(t)}))}
    rows = [np.unique([vocabulary[w] for w in words(t) if w in vocabulary], return_counts=True) for _, t in docs]
    lists = [np.unique([vocabulary[w] for w in words(t)]) for _, t in items]
    weight = np.r_[0.0, np.full(len(vocabulary), 3000.0)]
    root, directions = s.item_tree(lists, weight)
    found = s.Search(s.Block(root, weight, directions, len(items), len(docs), 15 * len(docs), 10, np.zeros(len(items))))
    found.add(np.array([d for d, _ in docs]), np.zeros(len(docs), bool), np.full(len(docs), 15), np.r_[0, np.cumsum([len(i) for i, _ in rows])], np.concatenate([i for i, _ in rows]), np.concatenate([c for _, c in rows]))
    assert found.scored < 0.2 * len(docs) * len(items)
    assert all((found.best[t][2] // 1000 == t).all() and len(found.best[t][2]) == 10 for t in range(32))


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in s.op13_dual_tree(spark, sf).collect())
    assert got == sorted(con.execute(s.SQL).fetchall()) and len(got) > 300


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5, "y")], "doc_id long, text string, rank string, n int, term string")
    items = spark.createDataFrame([(1, "A", "z")], "item_id long, text string, doc_id string")
    assert as_rows(s.ranked(docs, items)) == brute([(1, "a b")], [(1, "A")], 10)
    assert s.ranked(docs.limit(0), items).count() == 0 and s.ranked(docs, items.limit(0)).count() == 0
    assert s.ranked(docs, items).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
