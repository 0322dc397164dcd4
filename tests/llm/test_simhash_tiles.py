import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from recollect.llm import common, simhash_tiles


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, f"{fps[i]:016x}", low[find(i)]) for i, (d, _) in enumerate(rows))


def test_against_brute_force(spark, sf):
    docs = common.documents(spark, sf)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    base = "one two three four five six seven eight nine ten eleven twelve " * 30
    rows += [(10**6 + i, t) for i, t in enumerate(["", None, "  \t\n", "A", "a b", "A  B", "É x y z", *[base + f"w{k}" for k in range(25)], base, base])]
    got = simhash_tiles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=8)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("same", [True, False])
def test_forest_keeps_components(same):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 12, 150, dtype=np.uint64)
    b = a if same else rng.integers(0, 1 << 12, 90, dtype=np.uint64)
    x, y = simhash_tiles._forest(a, b, same, 1)
    import itertools

    def comps(edges):
        label = {v: v for v in {*a.tolist(), *b.tolist()}}
        for _ in range(200):
            for u, v in edges:
                label[u] = label[v] = min(label[u], label[v])
        return label

    links = [(u, v) for u, v in itertools.product(a.tolist(), b.tolist()) if (u ^ v).bit_count() <= 1]
    assert comps(links) == comps(list(zip(x.tolist(), y.tolist(), strict=True)))


def test_empty_and_extra_columns(spark):
    schema = "doc_id long, text string, fingerprint int, key string, fp long"
    assert simhash_tiles.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = simhash_tiles.near_duplicates(spark.createDataFrame([(3, "x y z", 1, "k", 2), (3, "x y z", 1, "k", 2), (None, "x y z", 1, "k", 2)], schema)).toPandas()
    assert len(got) == 3 and set(got.component_id) == {3}


def test_components_chain(spark):
    edges = spark.createDataFrame(pd.DataFrame({"a": range(40), "b": range(1, 41)}))
    got = common.components(edges).toPandas()
    assert len(got) == 41 and set(got.root) == {0}


def test_components_of_hubs_and_chains(spark):
    rng = np.random.default_rng(5)
    hub = [(5000, int(x)) for x in rng.choice(5000, 3000, replace=False)]
    loose = [(10_000 + int(x), 10_000 + int(y)) for x, y in rng.integers(0, 3000, (2500, 2))]
    edges = hub + loose + [(i, i + 7) for i in range(20_000, 20_100)]
    label = {v: v for e in edges if e[0] != e[1] for v in e}
    while True:
        before = dict(label)
        for u, v in edges:
            if u != v:
                label[u] = label[v] = min(label[u], label[v])
        if label == before:
            break
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(label) and {r["node"]: r["root"] for r in got} == label


@pytest.mark.parametrize("rows", [[], [(1, 5), (1, 3), (2, 9), (None, 1)], [(1, i) for i in range(50)] + [(i, i) for i in range(2, 3000)]])
def test_with_least(spark, rows):
    frame = common.materialize(spark.createDataFrame(rows, "k long, v long"), "rows")
    least = {k: min(v for x, v in rows if x == k) for k, _ in rows[:51]} | {k: v for k, v in rows[51:]}
    assert sorted(map(tuple, common.with_least(frame, "k", "v", "m").collect())) == sorted((k, v, least[k]) for k, v in rows if k is not None)


def test_columns_of_the_caller_stay(spark):
    names = ["id", "_id", "key", "key_of", "spans", "least", "__key", "__id", "a.b"]
    docs = spark.createDataFrame([(i, t, *[100 + i] * len(names)) for i, t in enumerate(["write to me@example.org now", "quite another text with many words", None])], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = simhash_tiles.keep_first(docs)
    assert got.columns == docs.columns and got.count() == 3
    assert all(r[2:] == (100 + r["doc_id"],) * len(names) for r in got.collect())


@pytest.mark.parametrize("rows, on", [(3000, 1000), (3000, 0)])
def test_hot_rows_stay_where_they_lie(spark, rows, on):
    """A third of the rows has one key: no task holds them, whatever the number of tasks."""
    frame = common.materialize(spark.createDataFrame([(7 if i < on else 100 + i, i) for i in range(rows)], "k long, v long").repartition(12), "rows")
    side = common.materialize(frame.groupBy("k").agg(common.F.count("*").alias("n"), common.F.min("v").alias("low")), "side")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = common.hot_join(frame, side, ["k"], "n", rows)
        most = max(r["count"] for r in got.groupBy(common.F.spark_partition_id()).count().collect())
    finally:
        for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    least = {k: min(r["v"] for r in frame.collect() if r["k"] == k) for k in (7,)} if on else {}
    assert most < rows / 3 and sorted(map(tuple, got.select("k", "v", "low").collect())) == sorted((7 if i < on else 100 + i, i, least.get(7, i) if i < on else i) for i in range(rows))


def test_third_of_texts_equal(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "the same words again and again" if i % 3 == 0 else " ".join(f"w{x}" for x in rng.integers(0, 500, 12)) if i % 3 == 1 else None) for i in range(3600)]
    got = simhash_tiles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == 3600 and all(by[i] == i % 3 for i in range(3600) if i % 3 != 1)
    kept = simhash_tiles.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(by.values()))
