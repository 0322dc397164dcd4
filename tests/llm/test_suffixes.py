import random
import re

import numpy as np
import pytest

from recollect.llm import common, suffixes

WORDS = 50


def brute(rows):
    """Words covered by windows of 50 words that a document with another row also holds."""
    split = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for _, t in rows]
    where = {}
    for i, w in enumerate(split):
        for a in range(len(w) - WORDS + 1):
            where.setdefault(b" ".join(w[a : a + WORDS]), set()).add(i)
    out = []
    for i, w in enumerate(split):
        covered = np.zeros(len(w) + 1, bool)
        for a in range(len(w) - WORDS + 1):
            if len(where[b" ".join(w[a : a + WORDS])]) > 1:
                covered[a : a + WORDS] = True
        edge = np.flatnonzero(np.diff(np.r_[False, covered].astype(int)))
        out += [(rows[i][0], int(a), int(b), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return sorted(out, key=str)


def made():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 5)))
    passages = [" ".join(word() for _ in range(n)) for n in (50, 51, 60, 140, 49, 400)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts.append(" ".join(word() for _ in range(rng.randint(5, 120))))
            if rng.random() < 0.5:
                parts.append(rng.choice(passages))
        rows.append((i, "\n".join(parts)))
    rows += [(100 + i, rows[3][1]) for i in range(5)] + [(200 + i, rows[5][1] + " more " + word() * 3) for i in range(20)]
    return [*rows, (300, None), (301, ""), (301, ""), (302, passages[3]), (302, passages[3]), (None, passages[3] + " end"), (303, "x " * 3000)]


def test_against_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, start int, th string").repartition(3)
    got = sorted((tuple(r) for r in suffixes.repeated(docs).collect()), key=str)
    assert got == brute(rows)


def test_documents(spark, sf):
    docs = common.documents(spark, sf)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    expect, got = brute(rows), sorted((tuple(r) for r in suffixes.repeated(docs).collect()), key=str)
    assert {r[0] for r in got} == {r[0] for r in expect}
    assert sum(r[3] for r in got) >= 0.999 * sum(r[3] for r in expect)


def test_every_window_holds_a_minimiser():
    rng = np.random.default_rng(1)
    hashes = rng.integers(1, 1 << 62, 3000, dtype=np.uint64)
    begin = np.array([0, 10, 59, 109, 1000, 3000])
    at, _ = suffixes.minimisers(hashes, begin)
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        for i in range(a, b - 49):
            assert ((at >= i) & (at <= i + 30)).any()
    assert len(at) < 3000 * 0.09
    texts = [b"a bb  c\n", b"", b"  ", b"bb"]
    h, begin = suffixes.word_hashes(texts)
    assert begin.tolist() == [0, 3, 3, 3, 4] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_empty(spark):
    assert suffixes.repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents_equal_brute_force(spark, sf):
    docs = common.documents(spark, sf)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in suffixes.repeated(docs).collect()), key=str) == brute(rows)


def test_line_in_most_documents(spark):
    """45 words in 12,000 documents; pairs share 8 words before or after them, and what stands on the other side parts them."""
    rng = random.Random(3)
    some = lambda n: " ".join(f"{rng.randrange(1 << 40):x}" for _ in range(n))
    line, rows = some(45), []
    for i in range(6000):
        near = some(8)
        for k in range(2):
            planted = i % 200 == 0
            before = f"{some(10)} {near if planted and i % 400 else some(8)}"
            after = f"{near if planted and not i % 400 else some(8)} {some(10)}"
            rows.append((2 * i + k, f"{before} {line} {after}"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    expect = brute(rows)
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (1, 7):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = sorted((tuple(r) for r in suffixes.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()), key=str)
            assert len(got) == 60 and got == expect
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize(("families", "decoys", "shortest"), [(24, 3, 30), (12, 15, 40)])
def test_decoys_below_the_threshold_hide_nothing(spark, families, decoys, shortest):
    """Overlapping windows of 50 to 60 words of a family's text, among pieces of it that are too short."""
    rng = random.Random(families)
    some = lambda n: [f"{rng.randrange(1 << 40):x}" for _ in range(n)]
    rows = []
    for _ in range(families):
        text = some(130)
        for _ in range(12):
            n = rng.randint(50, 60)
            a = rng.randrange(len(text) - n)
            pieces = [text[a : a + n]]
            for _ in range(decoys):
                m = rng.randint(shortest, 49)
                b = rng.randint(max(0, a - m + 20), min(a + n - 20, len(text) - m))
                pieces.append(text[b : b + m])
            rows += [(0, " ".join(some(rng.randint(3, 15)) + p + some(rng.randint(3, 15)))) for p in pieces]
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = sorted((tuple(r) for r in suffixes.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()), key=str)
    assert got == brute(rows) and got


def test_very_long_text(spark):
    rng = random.Random(1)
    words = [f"{rng.randrange(1 << 40):x}" for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[70_000:70_080])), (3, " ".join(words[5:54])), (4, "a " * 60_000), (5, "a " * 51)]
    got = sorted((tuple(r) for r in suffixes.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_third_of_texts_equal(spark):
    """The rows of a text that a third of the documents are stay where they lie, and all are found."""
    line = " ".join(f"word{i}" for i in range(70))
    rows = [(i, line if i % 3 == 0 else f"own {i} " + " ".join(f"x{i}y{k}" for k in range(60))) for i in range(3000)]
    got = suffixes.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(i, 0, 70, 70) for i in range(0, 3000, 3)]
