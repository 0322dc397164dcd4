import hashlib
import itertools

import re

import xxhash

from recollect.llm import common, simhash_blocks


def plain(text):
    """The fingerprint over Python integers: chained XXH64 of word pairs, weights, strict majority."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    votes, total = [0] * 64, 0
    for a, b in itertools.zip_longest(words, words[1:]) if len(words) < 2 else [*zip(words, words[1:]), (words[-1], None)]:
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        h = xxhash.xxh64_intdigest(b.encode(), h) if b is not None else h
        weight = min(len(a) + len(b or ""), 24)
        total += weight
        for bit in range(64):
            votes[bit] += weight * (h >> bit & 1)
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > total)


def test_fingerprints_against_plain_python(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in common.documents(spark, sf).select("doc_id", "text").collect()] + [(10**6 + i, t) for i, t in enumerate(["", None, "one", "One two", "a b a b a b", " lead\ttab\x0bx ", "ÀÉ ß 字"])]
    got = {r["doc_id"]: r["fingerprint"] % (1 << 64) for r in simhash_blocks.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: plain(t) for d, t in rows}


def test_contract_columns(spark, sf, monkeypatch):
    got = simhash_blocks.op2_simhash_blocks(spark, sf).toPandas().set_index("doc_id").sort_index()
    rows = sorted(tuple(r) for r in common.documents(spark, sf).select("doc_id", "text").collect())
    prints = {r["doc_id"]: f"{r['fingerprint'] % (1 << 64):016x}" for r in simhash_blocks.fingerprints(common.documents(spark, sf)).collect()}
    edits = []
    for i, (d, t) in enumerate(rows):
        k = len(t) // 4
        edits.append((d, t[: len(t) - k] + rows[(i + 1) % len(rows)][1][:k]))
    edited = {r["doc_id"]: f"{r['fingerprint'] % (1 << 64):016x}" for r in simhash_blocks.fingerprints(spark.createDataFrame(edits, "doc_id long, text string")).collect()}
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    for i, (d, t) in enumerate(rows):
        r = got.loc[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edits[i][1].encode()).hexdigest()
        assert r.fingerprint == prints[d] and r.edited_fingerprint == edited[d]
        assert r.near_edited == 1 - bits(prints[d], edited[d]) / 64
        assert r.near_next == 1 - bits(prints[d], prints[rows[(i + 1) % len(rows)][0]]) / 64
        if d % 50 == 0:
            assert r.n_within == sum(bits(prints[d], x) <= 3 for x in prints.values()) - 1
    assert got.near_edited.mean() > got.near_next.mean() + 0.1


def test_search_is_complete(spark):
    import random

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    near = [x ^ sum(1 << b for b in rng.sample(range(64), k)) for x in base for k in (0, 1, 2, 3, 4)]
    every = sorted({x - (1 << 64) if x >> 63 else x for x in base + near})
    queries = every[::3]
    classes = spark.createDataFrame([(x, 1) for x in every], "fp long, n int")
    got = sorted((r["query"], r["fp"]) for r in simhash_blocks.search(classes, spark.createDataFrame([(q,) for q in queries], "query long")).collect())
    assert got == sorted((q, x) for q, x in itertools.product(queries, every) if ((q ^ x) % (1 << 64)).bit_count() <= 3)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "a b c d"), (9, "x " * 50_000), (9, "z")]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int").write.parquet(f"{tmp_path}/documents.parquet")
    got = simhash_blocks.op2_simhash_blocks(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2)} == {"0" * 16}
    empty = spark.createDataFrame([], "doc_id long, text string")
    empty.write.parquet(f"{tmp_path}/e/documents.parquet")
    assert simhash_blocks.op2_simhash_blocks(spark, f"{tmp_path}/e").count() == 0
