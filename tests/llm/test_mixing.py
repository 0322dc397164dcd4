import math
from collections import Counter

import duckdb
import pytest

from recollect.llm import common, mixing


def test_counts_follow_the_rates(spark):
    names = ["__n", "n", "u", "row", "ident", "below", "from", "rows"]
    docs = spark.createDataFrame([(i, "x" * 100, "a" if i % 10 else "b", "copy?", *[i] * len(names)) for i in range(5000)], "doc_id long, text string, source string, copy string, " + ", ".join(f"`{n}` int" for n in names))
    got = mixing.mix(docs, weights={"a": 1.0, "b": 1.0})
    assert got.where(" or ".join(f"`{n}` <> doc_id" for n in names)).isEmpty()
    n = Counter(r["source"] for r in got.select("source").collect())
    assert abs(n["a"] - 2500) < 6 * 50 and abs(n["b"] - 2500) < 6 * math.sqrt(5 * 2500)
    per = Counter(r["doc_id"] for r in got.where("source = 'b'").collect())
    share = Counter(per.get(i, 0) for i in range(0, 5000, 10))
    for k in range(8):
        expect = 500 * math.exp(-5) * 5**k / math.factorial(k)
        assert abs(share[k] - expect) < 6 * math.sqrt(expect) + 3


def test_inversion_is_exact(spark):
    table = mixing.distributions(spark.createDataFrame([("a", 0.0), ("b", 0.3), ("c", 40.0)], "source string, rate double")).collect()
    for r in table:
        total = 0.0
        for k, c in enumerate(r["below"]):
            total += math.exp(-r["rate"] + (k * math.log(r["rate"]) if k else 0) - math.lgamma(k + 1)) if r["rate"] else float(k == 0)
            assert math.isclose(c, total, rel_tol=1e-9)
        assert r["below"][-1] > 1 - 1e-12


def test_against_sql(spark, sf):
    got = sorted(tuple(r) for r in mixing.op3_poisson_mix(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert got == sorted(con.execute(mixing.SQL).fetchall())


@pytest.mark.parametrize("few", [mixing.FEW, 3, 0])
def test_many_sources_and_high_rates_against_sql(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW", few)
    rows = [(i, "y" * 30_000, "en", f"s{i % 9}", 1) for i in range(900)] + [(5000, "z", "en", "tiny", 1), (5000, "z", "en", "tiny", 1), (5001, "n" * 50, None, None, 2), (5002, "e" * 70, None, "", 2), (5003, None, None, "none", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expect = con.execute(mixing.SQL).fetchall()
    key = lambda r: str(r)
    assert sorted((tuple(r) for r in mixing.op3_poisson_mix(spark, str(tmp_path)).collect()), key=key) == sorted(expect, key=key)
    assert Counter(r[3] for r in expect)["tiny"] > 800


@pytest.mark.parametrize("few", [mixing.FEW, 0])
def test_odd_rows(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW", few)
    schema = "doc_id long, text string, source string, shuffle_key int"
    docs = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "a", "s", 2), (3, "", "t", 3)], schema)
    got = mixing.mix(docs, epochs=3.0).collect()
    assert {r["source"] for r in got} <= {None, "s", "t"}
    assert sum(r["doc_id"] == 1 for r in got) % 2 == 0
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0


def test_order_is_global(spark, sf):
    keys = [r["shuffle_key"] for r in mixing.mix(common.documents(spark, sf)).select("shuffle_key").collect()]
    assert keys == sorted(keys)
