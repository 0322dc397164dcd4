import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from recollect.llm import common, packing, token_files, tokens

ODD = ["it's 5.5, <|endoftext|>x A<|ENDOFTEXT|> áb İstanbul ΣΑΣ, ﬁ.", "é. don't, 'tis... ok,, x²³ ½.", "\x1c a\x85b\xa0c, µ. ª, ß.\r\n\tq.", "", " ", None, "a.\n\nb.,\n", "x', y'S. z'LL, '", "a_. b _, c !. d", "à\xadb \xa0x Àé ÿ ¡x", "x" * 5000, "word " * 9000]


@pytest.fixture(scope="module")
def rows(spark, sf):
    found = [tuple(r) for r in common.documents(spark, sf).select("doc_id", "text").collect()]
    return found + [(10**6 + i, t) for i, t in enumerate(ODD)]


@pytest.fixture(scope="module")
def ids(rows):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    return {d: library.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_files_round_trip(spark, rows, ids, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in token_files.read(token_files.write(docs, f"{tmp_path}/t"), block=7).collect())
    order = sorted(ids)
    starts = dict(zip(order, itertools.accumulate([0] + [len(ids[d]) for d in order]), strict=False))
    assert got == [(d, starts[d], len(ids[d]), crc(ids[d])) for d in order]


def check_packing(got, ids, capacity):
    parts, at = {}, {}
    for r in got:
        parts.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        assert r["ids_crc32"] == crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(parts) == set(ids)
    for d, found in parts.items():
        assert [s for s, _ in sorted(found)] == [0, *itertools.accumulate(n for _, n in sorted(found))][:-1]
        assert sum(n for _, n in found) == len(ids[d])
    for found in at.values():
        found.sort()
        assert [o for o, _ in found] == [0, *itertools.accumulate(n for _, n in found)][:-1]
        total = sum(n for _, n in found)
        assert total == capacity or total & (total - 1) == 0 and total < capacity


@pytest.mark.parametrize(("capacity", "bucket", "few"), [(2048, 20_000, 10_000), (64, 5, 0)])
def test_packing_is_exact(spark, rows, ids, capacity, bucket, few):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_packing(packing.pack(docs, capacity=capacity, bucket=bucket, few=few).collect(), ids, capacity)


@pytest.mark.parametrize("counts", [{1500: 1000}, {700: 1000}, {1100: 500, 900: 500}, {1500: 100, 600: 100, 37: 10}, {2048: 3, 2047: 2}, {5: 3}, {1: 5000}])
def test_every_window_is_filled_by_the_nearest_multiset(counts):
    patterns, rest = packing.plan(counts)
    left, stock, windows = dict(counts), 0, 0
    for used, times, slack, cut in patterns:
        largest = max(x for x, n in left.items() if n)
        assert times > 0 and largest in used and sum(x * n for x, n in used.items()) + slack == packing.WINDOW
        others = {x: n - (x == largest) for x, n in left.items()}
        assert packing.fill(others, packing.WINDOW - largest)[1] == slack
        for x, n in used.items():
            left[x] -= n * times
        for x, n in cut.items():
            left[x] -= n
            stock += x * n
        stock -= slack * times
        windows += times
        assert stock >= 0 and min(left.values()) >= 0
    assert {x: n for x, n in left.items() if n} == rest
    total = sum(x * n for x, n in counts.items())
    assert windows == total // packing.WINDOW and stock + sum(x * n for x, n in rest.items()) == total % packing.WINDOW


def test_random_histograms_keep_every_token():
    rng = np.random.default_rng(8)
    for _ in range(60):
        capacity = int(rng.integers(2, 90))
        counts = {int(x): int(n) for x, n in zip(rng.integers(1, capacity + 1, 6), rng.integers(1, 60, 6), strict=True)}
        where, slots = packing.places(*packing.plan(counts, capacity), capacity)
        at = {}
        for x, n in counts.items():
            rank = np.arange(n)
            begin, stream, first, copies, offset = where[x][:, np.searchsorted(where[x][0], rank, "right") - 1]
            for r in rank[stream == 0]:
                nth, slot = divmod(int(r - begin[r]), int(copies[r]))
                at.setdefault(int(first[r]) + nth, []).append((int(offset[r]) + slot * x, x))
            held = (first + (rank - begin) * x)[stream == 1]
            done = np.zeros(len(held), np.int64)
            for i, sequence, into, shift, size in packing.cuts(held, x, slots):
                assert (done[i] == shift).all()
                done[i] += size
                for s, o, k in zip(sequence.tolist(), into.tolist(), size.tolist(), strict=True):
                    at.setdefault(s, []).append((o, k))
            assert (done == x).all()
        sizes = []
        for found in at.values():
            found.sort()
            assert [o for o, _ in found] == [0, *itertools.accumulate(k for _, k in found)][:-1]
            sizes.append(sum(k for _, k in found))
        assert all(s == capacity or s & (s - 1) == 0 for s in sizes)
        assert sizes.count(capacity) >= sum(x * n for x, n in counts.items()) // capacity


def test_cut_windows_on_documents(spark):
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    rows = [(i, " ".join(["one two three"] * 11)) for i in range(150)] + [(1000 + i, "four five " * 20) for i in range(37)]
    ids = {d: library.encode(t, add_special_tokens=False).ids + [1] for d, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for few in (10_000, 0):
        check_packing(packing.pack(docs, capacity=50, bucket=20, few=few).collect(), ids, 50)


def test_another_vocabulary_is_left_to_the_library(spark, rows, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    ids = {d: library.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_packing(packing.pack(docs, vocabulary=path).collect(), ids, packing.WINDOW)
    got = {r["doc_id"]: r["ids_crc32"] for r in token_files.read(token_files.write(docs, f"{tmp_path}/b", vocabulary=path)).collect()}
    assert got == {d: crc(x) for d, x in ids.items()}


def test_blocks_and_a_small_cache_change_nothing(rows, ids, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 7)
    monkeypatch.setattr(tokens, "BLOCK", 100)
    flat, sizes = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY)).encode([t for _, t in rows])
    assert flat.tolist() == [i for d, _ in rows for i in ids[d]] and sizes.tolist() == [len(ids[d]) for d, _ in rows]


def test_files_with_null_and_repeated_ids(spark, tmp_path):
    rows = [(None, "z"), (None, None), (3, "b"), (3, "a"), (3, "a"), (-5, "c d")]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = token_files.read(token_files.write(docs, f"{tmp_path}/n"), block=2).orderBy("start").collect()
    order = [(None, None), (None, "z"), (-5, "c d"), (3, "a"), (3, "a"), (3, "b")]
    found = [library.encode(t or "", add_special_tokens=False).ids + [1] for _, t in order]
    assert [r["doc_id"] for r in got] == [d for d, _ in order]
    assert [r["ids_crc32"] for r in got] == [crc(x) for x in found]
    assert [r["start"] for r in got] == [0, *itertools.accumulate(len(x) for x in found)][:-1]


def test_packing_equal_lengths_and_repeats(spark):
    docs = spark.createDataFrame([(i % 40, "one two three four five six") for i in range(80)] + [(None, "x")], "doc_id long, text string")
    got = packing.pack(docs, capacity=16).collect()
    assert sum(r["length"] for r in got) == 80 * 7 + 2
    sizes = {}
    for r in got:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert all(n & (n - 1) == 0 for n in sizes.values()) and any(r["doc_id"] is None for r in got)


def test_fill_is_the_least_slack():
    rng = np.random.default_rng(5)
    for _ in range(200):
        lengths = rng.integers(1, 30, 7).tolist()
        counts = {x: lengths.count(x) for x in lengths}
        used, slack = packing.fill(counts, 40)
        best = max(sum(c) for k in range(8) for c in itertools.combinations(lengths, k) if sum(c) <= 40)
        assert sum(x * n for x, n in used.items()) == best == 40 - slack
        assert all(n <= counts[x] for x, n in used.items())


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, start int, ids string")
    assert packing.pack(docs).count() == 0
    assert token_files.read(token_files.write(docs, f"{tmp_path}/t")).count() == 0
