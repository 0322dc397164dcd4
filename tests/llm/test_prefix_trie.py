import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import prefix_trie as t

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = convs.get(head, [])[:h] + own[h:]
    return out


def brute(convs):
    """Every node with its members, by plain dictionaries."""
    members = defaultdict(set)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].add(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c in members[k] if len(convs[c]) == len(k)))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(k)) for k, m in members.items())


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def as_rows(df):
    return sorted(tuple(r[c] for c in NAMES) for r in df.collect())


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(11)
    rows = []
    for c in range(450):
        kind = c % 9
        s = [("user", f"t{rng.integers(0, 3)}é😀"[: int(rng.integers(1, 6))]) for _ in range(int(rng.integers(0, 7)))]
        if kind < 3:
            s = [("user", "hello")] * 2 + s[: kind * 2]
        if kind == 4:
            s = [("user", "hello"), ("assistant", "again")]
        rows += [(c, i, *x) for i, x in enumerate(s)]
    deep = [("user", f"step {i}") for i in range(700)]
    rows += [(1000 + c, i, *x) for c in range(4) for i, x in enumerate(deep[: 700 - 150 * c] + [("user", f"end {c}")])]
    rows += [(-5, 0, "user", "hello"), (-250, 1, None, "x"), (-250, None, "user", None), (-250, 1, None, None), (None, 0, "user", "hello"), (77, 3, "user", "same"), (77, 3, "user", "same"), (77, 3, "a", "same"), (2_000_000_000_001, 9, "user", "z" * 40_000)]
    return rows


@pytest.mark.parametrize("hold, parts", [(1 << 14, 3), (20, 7), (1, 5)])
def test_equals_plain_dictionaries(spark, made, monkeypatch, hold, parts):
    """Also where every component is split by joins (``hold`` 1), and where conversations cross the borders of tasks."""
    monkeypatch.setattr(t, "HOLD", hold)
    monkeypatch.setattr(t, "CHUNK", 64)
    rows = made if hold > 1 else [r for r in made if r[0] is None or r[0] % 7 == 0][:300]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        turns = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        assert as_rows(t.conversation_trie(turns, texts=False)) == brute(ordered(rows))
        if hold == 20:
            found, convs = t.rebuilt(t.sequences(turns))
            assert as_rows(t.trie(t.prefixes(found, convs, ["kind", "at"]))) == brute(rebuild(ordered(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_texts_and_clashing_names(spark, made):
    rows = made[:300]
    turns = spark.createDataFrame(rows, SCHEMA).withColumns({"at": F.lit("x"), "a": F.lit("y"), "kind": F.lit(1.5)})
    got = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in t.conversation_trie(turns).collect()}
    for (c, d), last in got.items():
        assert last == ((None, None) if d == 0 else ordered(rows)[c][d - 1])


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert t.conversation_trie(empty).count() == 0
    assert t.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


def test_decomposition_against_plain_sums():
    rng = np.random.default_rng(0)
    for kind in ("random", "chain", "star", "forest"):
        n = 400
        parent = {"random": [-1] + [int(rng.integers(0, i)) for i in range(1, n)], "chain": list(range(-1, n - 1)), "star": [-1] + [0] * (n - 1), "forest": [-1 if i % 40 == 0 else int(rng.integers(i - i % 40, i)) for i in range(n)]}[kind]
        depth = []
        for p in parent:
            depth.append(0 if p < 0 else depth[p] + 1)
        values = rng.integers(-5, 9, (n, 2))
        expect = values.copy()
        for i in range(n - 1, 0, -1):
            if parent[i] >= 0:
                expect[parent[i]] += expect[i]
        assert (t.decompose(np.array(parent), np.array(depth), values) == expect).all()


def test_carry_over_borders_of_tasks(spark):
    """One conversation over all tasks: places and keys are those of a run in one task."""
    rows = spark.range(5000).select(F.lit(3).cast("long").alias("conv_id"), (F.xxhash64("id")).alias("a"), F.xxhash64("id", F.lit(2)).alias("b"), "id")
    got = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got.append(sorted(map(tuple, t.scan(rows.repartition(8), [F.col("id")], ["id"], "t").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    one, many = got
    assert one == many and [r[1] for r in one] == list(range(5000))


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    expect = con.execute(f"SELECT {', '.join(NAMES)} FROM ({t.SQL})").fetchall()
    assert as_rows(t.op11_prefix_trie(spark, sf)) == sorted(expect) and len(expect) > 300
