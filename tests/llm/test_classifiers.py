import math
import numpy as np
import pytest

from recollect.llm import common, langid, toxicity


@pytest.fixture(scope="module")
def langs(spark):
    return langid.op5_language_id(spark, "/root/testdata/sf0.01").toPandas()


def test_language_held_out(spark, langs):
    truth = common.documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang").toPandas().set_index("doc_id").lang
    held = langs[langs.held_out]
    assert len(langs) == len(truth) and (held.lang_pred == held.doc_id.map(truth)).mean() > 0.98
    assert held.score.between(0, 1).all()


def test_sums_against_brute_force():
    rng = np.random.default_rng(0)
    table = np.vstack([rng.normal(size=(langid.SIZE, 3)), np.zeros(3)])
    texts = ["Hello", "", "é", "a b " * 400_000, "xyz " * 3]
    got = langid.sums(texts, table)

    def feature(gram):
        mixed = 0
        for c, f in zip(gram, langid.FACTORS, strict=False):
            mixed = (mixed + ord(c) * f) % (1 << 32)
        return (((mixed ^ mixed >> 15) + (len(gram) - 1) * 40503) % (1 << 32) * 668265263 % (1 << 32)) >> 32 - langid.BITS

    for i in (0, 1, 2, 4):
        t = f" {texts[i].lower()} "
        rows = [table[feature(t[a : a + n])] for n in (1, 2, 3) for a in range(len(t) - n + 1)]
        assert np.allclose(got[i], np.mean(rows, axis=0))
    whole = langid.sums(["a b " * 400], table)[0]
    assert np.allclose(got[3], whole, atol=0.01)


def test_language_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 40)]
    odd = [(100, None, None, "s"), (None, "", "en", "s"), (101, "123 !", "fr", "s"), (102, "the " * 50_000, None, "s"), (102, "the dog", None, "s"), (102, "the dog", None, "s")]
    docs = spark.createDataFrame(rows + odd, schema)
    model = langid.fit(docs)
    got = langid.predict(docs.drop("score"), model, ["doc_id"]).collect()
    assert len(got) == len(rows) + len(odd)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["lang_pred"])
    assert by[100] == by[101] == by[None] == {"und"} and by[102] == {"en"} and by[0] == {"en"} and by[1] == {"fr"}
    empty = spark.createDataFrame([], schema)
    assert langid.fit(empty) is None and langid.predict(empty.drop("score"), None, ["doc_id"]).count() == 0


def test_temperature_recovers_scale():
    rng = np.random.default_rng(2)
    s = rng.normal(size=(4000, 3)) * 2
    y = np.array([rng.choice(3, p=p) for p in langid.softmax(s)])
    assert abs(np.log(langid.temperature(s * 5, y) / 5)) < 0.15


def test_toxicity_held_out(spark):
    got = toxicity.op1_toxicity_nnpu(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas().set_index("doc_id").toxic
    held = got[got.held_out & got.doc_id.isin(labels.index)]
    toxic = held.doc_id.map(labels) == 1
    assert (held.predicted == toxic).mean() > 0.9 and held.score.between(0, 1).all()
    assert held[toxic].score.mean() > held[~toxic].score.mean() + 0.3
    assert (got.predicted == (got.score >= 0.5)).all()


def test_risk_is_non_negative():
    rng = np.random.default_rng(3)
    positive = [np.array([0, *rng.integers(1, 50, 5)]) for _ in range(200)]
    unlabelled = [np.array([0, *rng.integers(1, 50, 5)]) if i % 5 == 0 else rng.integers(1, 50, 6) for i in range(1000)]
    w, b = toxicity.nnpu(positive, unlabelled, 50, 0.2)
    value = lambda rows: np.array([w[r].sum() + b for r in rows])
    assert np.median(value(positive)) > 0 > np.median(value([r for r in unlabelled if 0 not in r])) and w[0] == w.max()


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (None, "scum", 5.0), (3, "x " * 90_000, 5.0), (3, "x", 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (2, 0)], "doc_id long, toxic int")
    weights, biases = toxicity.fit(docs, labels)
    assert weights == {} and toxicity.score(docs, weights, biases, ["doc_id"]).agg({"score": "max"}).first()[0] == 0
    known = toxicity.score(docs, {"scum": (9.0,)}, (-3.0,), ["doc_id"]).collect()
    assert {r["doc_id"] for r in known if r["predicted"]} == {None} and len(known) == 5
    assert toxicity.score(docs.limit(0), {}, (), ["doc_id"]).count() == 0


def test_risk_and_gradient_on_both_sides_of_zero():
    rng = np.random.default_rng(3)
    seen = set()
    for shift in (-4.0, 0.0, 4.0):
        sp, su, prior = rng.normal(shift, 2, 7), rng.normal(-1, 2, 9), 0.4
        plus = prior * sum(math.log1p(math.exp(-s)) for s in sp) / 7
        minus = sum(math.log1p(math.exp(s)) for s in su) / 9 - prior * sum(math.log1p(math.exp(s)) for s in sp) / 7
        value, negative, by_p, by_u = toxicity.risk(sp, su, prior)
        assert math.isclose(value, plus + max(0.0, minus)) and math.isclose(negative, minus)
        seen.add(minus >= 0)
        part = (lambda p, u: prior * np.logaddexp(0, -p).mean() + np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()) if minus >= 0 else (lambda p, u: prior * np.logaddexp(0, p).mean() - np.logaddexp(0, u).mean())
        for i in range(7):
            e = np.eye(7)[i] * 1e-6
            assert abs((part(sp + e, su) - part(sp - e, su)) / 2e-6 - by_p[i]) < 1e-6
        for i in range(9):
            e = np.eye(9)[i] * 1e-6
            assert abs((part(sp, su + e) - part(sp, su - e)) / 2e-6 - by_u[i]) < 1e-6
    assert seen == {True, False}


def test_training_parts_toxic_from_clean():
    rng = np.random.default_rng(6)
    positive = [np.unique(np.r_[rng.integers(0, 5, 2), rng.integers(20, 60, 6)]) for _ in range(80)]
    clean = [np.unique(rng.integers(20, 60, 8)) for _ in range(180)]
    w, b = toxicity.nnpu(positive, clean + positive[:20], 60, 0.1)
    score = lambda r: w[r].sum() + b
    assert np.mean([score(r) > 0 for r in positive]) > 0.9 and np.mean([score(r) > 0 for r in clean]) < 0.05


def test_ftrl_against_a_plain_version(monkeypatch):
    size, classes, alpha, beta, l1, l2 = 12, 3, 0.3, 1.0, 0.02, 1e-3
    monkeypatch.setattr(langid, "SIZE", size)
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(classes)), np.sort(rng.choice(size, 4, replace=False)), rng.random(4)) for _ in range(40)]
    weights, bias = langid.ftrl(rows, classes, alpha, beta, l1, l2, epochs=2, seed=9)
    z, n = {}, {}

    def weight(i, c):
        a = z.get((i, c), 0.0)
        return 0.0 if abs(a) <= l1 else -(a - math.copysign(l1, a)) / ((beta + math.sqrt(n.get((i, c), 0.0))) / alpha + l2)

    order = np.random.default_rng(9)
    for _ in range(2):
        for r in order.permutation(len(rows)):
            y, at, x = rows[r]
            inputs = [*zip(at.tolist(), x.tolist(), strict=True), (size, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in inputs for c in range(classes)}
            s = [sum(v * w[i, c] for i, v in inputs) for c in range(classes)]
            total = sum(math.exp(t) for t in s)
            for i, v in inputs:
                for c in range(classes):
                    g = v * (math.exp(s[c]) / total - (c == y))
                    before = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[i, c]
                    n[i, c] = before + g * g
    plain = np.array([[weight(i, c) for c in range(classes)] for i in range(size + 1)])
    assert np.allclose(weights, plain[:size]) and np.allclose(bias, plain[size])


def test_kept_columns_of_any_name(spark):
    """A caller's columns named like the operators' own ones stay as they are; names of results are refused."""
    docs = spark.createDataFrame([(i, f"the cat {i} and the dog", "en" if i % 2 else "fr", f"own {i}", 1.5, i) for i in range(40)], "doc_id long, text string, lang string, __text string, `a.b` double, _text long")
    keep = ["doc_id", "__text", "a.b", "_text", "text"]
    for got in (langid.predict(docs, langid.fit(docs), keep), toxicity.score(docs, {}, (), keep)):
        assert got.columns[:5] == keep and {(r[0], r[1], r[2], r[3], r[4]) for r in got.collect()} == {(i, f"own {i}", 1.5, i, f"the cat {i} and the dog") for i in range(40)}
    with pytest.raises(ValueError):
        langid.predict(docs.withColumnRenamed("__text", "Score"), None, ["doc_id", "Score"])
    with pytest.raises(ValueError):
        toxicity.score(docs.withColumnRenamed("__text", "predicted"), {}, (), ["doc_id", "predicted"])


def test_language_query_row_by_row(spark, langs):
    """The whole query against the model's formula, text by text."""
    docs = common.documents(spark, "/root/testdata/sf0.01")
    model = langid.fit(docs.where(common.crc_fold("doc_id", 4) != 2))
    got = langs.set_index("doc_id")
    for r in docs.select("doc_id", "text").collect():
        row = got.loc[r["doc_id"]]
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert row.lang_pred == "und" and row.score == 0
            continue
        s = (langid.sums([r["text"]], model.table)[0] + model.bias) / model.temperature
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert row.lang_pred == model.langs[int(p.argmax())] and abs(row.score - p.max()) < 1e-4


def test_toxicity_query_row_by_row(spark):
    """The whole query against a plain sum of the weights of each text's words and their beginnings."""
    sf = "/root/testdata/sf0.01"
    docs, labels = common.documents(spark, sf).select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    fold = common.crc_fold("doc_id", 5)
    weights, biases = toxicity.fit(docs.where(fold != 0), labels.where(fold != 0))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.op1_toxicity_nnpu(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        words, word = set(), ""
        for c in (r["text"] or "").lower() + " ":
            if c.isalnum() and not c.isdigit() and not c.isnumeric():
                word += c
                continue
            if word:
                words |= {word, *(word[:n] + "*" for n in (4, 5) if len(word) > n)}
            word = ""
        sums = [b + sum(weights[w][k] for w in words if w in weights) for k, b in enumerate(biases)]
        score = sum(1 / (1 + math.exp(-max(-500.0, s))) for s in sums) / len(sums)
        assert abs(got[r["doc_id"]][0] - score) < 1e-9 and got[r["doc_id"]][1] == int(got[r["doc_id"]][0] >= 0.5)
