import itertools
import re

import corpus_pipeline
import pytest

from recollect.llm import common, tokens
from tests.llm.test_simhash_tiles import fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = common.documents(spark, sf).select("*")
    extra = [(10**6 + i, t, "en", "s", 1) for i, t in enumerate([None, "", "12 34", "mail joe@example.com now", "mail joe@example.com now"])]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.materialize(stage(spark, out[-1], sf), name))
    return out


def test_columns(stages):
    for got in stages[1:-1]:
        assert got.columns == stages[0].columns


def test_language_keeps_clean_documents(stages):
    before, after = ({r["doc_id"]: r["text"] for r in s.collect()} for s in stages[:2])
    assert {d for d in before if d not in after} == {d for d, t in before.items() if not re.search(r"[^\W\d_]", t or "")}
    assert all(before[d] == t for d, t in after.items())


def test_one_of_each_group_stays(stages):
    before, after = ({r["doc_id"]: r["text"] for r in s.collect()} for s in stages[1:3])
    prints = {d: fingerprint(t) for d, t in before.items()}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert set(after) == {find(d) for d in prints} and all(before[d] == t for d, t in after.items())


def test_personal_data_is_replaced(stages):
    before, after = ({r["doc_id"]: r["text"] for r in s.collect()} for s in stages[2:4])
    assert before.keys() == after.keys() and after[10**6 + 3] == "mail <email> now"
    assert all(t == before[d] or re.search("<(email|ip|card|phone)>", t) for d, t in after.items())


def test_mixture_and_packing(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    mixed = [(r["doc_id"], r["text"]) for r in stages[4].collect()]
    assert all(before[d] == t for d, t in mixed)
    pieces = stages[5].collect()
    length = {d: int(tokens.encoder().encode([t])[1][0]) for d, t in set(mixed)}
    assert sum(r["length"] for r in pieces) == sum(length[d] for d, _ in mixed)
    assert all(r["doc_tokens"] == length[r["doc_id"]] for r in pieces)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and corpus_pipeline.ORACLE_SQL is None


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, copy int, __text string, shuffle_key string, `a.b` int"


def test_odd_rows_go_through(spark, tmp_path):
    rows = [(None, "no id here", "en", None, None, "s", 1), (None, "no id here", "en", None, None, "s", 1), (1, None, None, None, None, None, None), (2, "x y z", None, "a", 5, "s", 2), (2, "x y z", None, "a", 5, "s", 2), (3, "call +49 30 1234567 " + "w " * 30_000, "en", "a", 5, "s", 3), (4, "", "en", "b", 0, "s", 4)]
    rows = [(*r, f"t{r[0]}", f"k{r[0]}", 7) for r in rows]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = common.documents(spark, str(tmp_path))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.columns, common.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == before
        assert all((r["__text"], r["shuffle_key"], r["a.b"]) == (f"t{r['doc_id']}", f"k{r['doc_id']}", 7) and r["copy"] in (1, 2, 3, 4) for r in docs.collect())
        if name == "near_duplicates":
            assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["2", "3", "None"]
        if name == "personal_data":
            assert docs.where("doc_id = 3").first()["text"].startswith("call <phone> w")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[:2] == ["doc_id", "start"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
