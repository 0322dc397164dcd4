import hashlib
import re

import numpy as np
import pytest

from recollect.llm import common, pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": all(int(p) <= 255 for p in v.split(".")) if kind == "ip" else False, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in BASE.items()}


ODD = [
    None, "", "a@b.c%x@d.e", "1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.01 1.2.3", "é😀 4111 1111-1111 1111, +49 (30) 1234-567 x", "+1 743 555-3824)) ...",
    "9" * 5_000, "a" * 9_000, "a.b" * 3_000 + "@x", "x@" + "y." * 20_000 + "z", "4111111111111111 " * 2000, "tel (743) 555-3824 or 743-555-3824", "joe [at] example [dot] com", "\x00 +1234567890 \x01",
    "123456789012345678901234567890123456789.1.2.3", "user@host", "@@a@b..c@d.ef.",
]


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [tuple(r) for r in common.documents(spark, sf).select("doc_id", "text").collect()] + [(10**6 + i, t) for i, t in enumerate(ODD)] + [(None, "a@b.cd"), (10**6, "a@b.cd")]


def test_base_spans(spark, rows, tmp_path):
    spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, start int, kind string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op10_pii_weak(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    expect = []
    for d, t in rows:
        b = base(t)
        listed = [f"{k}:{s}:{e}" for k in BASE for s, e in b[k]]
        expect.append((str(d), *[len(b[k]) for k in BASE], hashlib.sha256(",".join(listed).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == sorted(expect)
    every = {(str(r["doc_id"]), r["n_email"]): r["spans"] for r in got}
    for d, t in rows:
        b = base(t)
        assert {f"{k}:{s}:{e}" for k in BASE for s, e in b[k]} <= set(every[str(d), len(b["email"])].split(",")) | {""}
    national = every[str(10**6 + 11), 0].split(",")
    assert "phone:4:18" in national


def test_redaction(spark, rows):
    docs = spark.createDataFrame([(*r, "keep") for r in rows], "doc_id long, text string, key string")
    got = pii.redact(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    clean = {(r["doc_id"], r["text"]) for r in got.collect()}
    assert (10**6 + 4, "é😀 <card>, <phone> x") in clean
    for d, t in rows:
        if not re.search(r"[0-9@\[]", t or ""):
            assert (d, t) in clean
    assert all(not any(base(t)[k] for k in ("email", "card", "phone")) for d, t in clean if d is not None and d < 10**6)


def test_labels_follow_reliable_labelers():
    patterns = [((1, 1, 1, 1, 1), 60), ((1, 1, 0, 1, 1), 30), ((-1, -1, 0, 1, -1), 70), ((-1, 1, 0, -1, -1), 20), ((1, -1, 0, 1, 1), 5)]
    prior, tables = pii.reliabilities(patterns)
    assert pii.posterior(prior, tables, (1, 1, 1, 1, 1)) > 0.95 > 0.05 > pii.posterior(prior, tables, (-1, -1, 0, 1, -1))
    w = pii.classifier([("base", v, n, pii.posterior(prior, tables, v)) for v, n in patterns])
    dot = lambda v: sum(a * b for a, b in zip(w, pii.features("base", v), strict=True))
    assert dot((1, 1, 1, 1, 1)) > 0 > dot((-1, -1, 0, 1, -1))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.spans(docs).count() == 0 and pii.redact(docs).count() == 0
    assert pii.redact(spark.createDataFrame([(1, "no data here")], "doc_id long, text string")).first()["text"] == "no data here"


def test_columns_of_the_caller_stay(spark):
    names = ["id", "_id", "key", "key_of", "spans", "least", "__key", "__id", "a.b"]
    docs = spark.createDataFrame([(i, t, *[100 + i] * len(names)) for i, t in enumerate(["write to me@example.org now", "quite another text with many words", None])], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = pii.redact(docs)
    assert got.columns == docs.columns and got.count() == 3
    assert all(r[2:] == (100 + r["doc_id"],) * len(names) for r in got.collect())


def plain_spans(found):
    """Spans of each row by a plain expectation-maximisation, a plain gradient descent, and a look at every candidate."""
    kept = set()
    for kind in pii.KINDS:
        mine = [r for r in found if r["kind"] == kind]
        if not mine:
            continue
        votes = np.array([[r[name] for name in pii.LABELERS] for r in mine])
        soft = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
        for _ in range(60):
            prior = min(max((soft.sum() + 1) / (len(mine) + 2), 0.01), 0.99)
            odds = np.full(len(mine), np.log(prior / (1 - prior)))
            for j in range(votes.shape[1]):
                chance = {}
                for y, p in ((1, soft), (0, 1 - soft)):
                    counts = {v: 1 + p[votes[:, j] == v].sum() for v in (-1, 0, 1)}
                    chance[y] = {v: c / sum(counts.values()) for v, c in counts.items()}
                odds += np.array([np.log(chance[1][v] / chance[0][v]) for v in votes[:, j]])
            soft = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        x = np.c_[np.ones(len(mine)), [r["form"] == "wide" for r in mine], votes == 1, votes == -1].astype(float)
        w = np.zeros(x.shape[1])
        for _ in range(400):
            w -= x.T @ (1 / (1 + np.exp(-x @ w)) - soft) / len(mine) + 1e-3 * w
        kept |= {(r["uid"], kind, r["start"], r["end"]) for r, s in zip(mine, x @ w, strict=True) if s >= 0}
    out = {}
    for r in found:
        out.setdefault(r["uid"], (r["doc_id"], [], []))
        if r["base"]:
            out[r["uid"]][1].append((pii.KINDS.index(r["kind"]), r["start"], r["end"]))
        elif r["kind"] is not None and (r["uid"], r["kind"], r["start"], r["end"]) in kept:
            out[r["uid"]][2].append((pii.KINDS.index(r["kind"]), r["start"], r["end"]))
    named = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))
    return sorted((str(d), named(b + [m for m in more if not any(x[1] < m[2] and m[1] < x[2] for x in b)])) for d, b, more in out.values())


def test_all_spans_of_the_query(spark, rows, tmp_path):
    """Base and added spans of the whole query against a plain version of the method over the same candidates."""
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r["doc_id"]), r["spans"]) for r in pii.op10_pii_weak(spark, str(tmp_path)).collect())
    expect = plain_spans(pii.candidates(common.documents(spark, str(tmp_path))).collect())
    assert got == expect
    assert any(len(s.split(",")) > sum(len(v) for v in base(dict((str(d), t) for d, t in rows).get(d)).values()) for d, s in got if s)
