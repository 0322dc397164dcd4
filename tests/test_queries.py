"""Every registered query of the engine against its SQL, on the smallest tables."""

from datetime import date, datetime

import duckdb
import pyarrow as pa
import pytest

from recollect.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def rows(table: pa.Table) -> list[tuple]:
    def plain(v):
        if isinstance(v, float):
            return None if v != v else round(v, 9) + 0.0
        if isinstance(v, date):
            return (v if isinstance(v, datetime) else datetime(v.year, v.month, v.day)).replace(tzinfo=None)
        return v

    columns = [table.column(c).to_pylist() for c in sorted(table.column_names)]
    return sorted(tuple(str(plain(v)) for v in r) for r in zip(*columns, strict=True))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, sql, name):
    got, expect = QUERIES[name](spark, sf).toArrow(), sql.sql(ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(expect.column_names)
    assert rows(got) == rows(expect)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.queries().keys() >= QUERIES.keys() and __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_stream_counts_every_window(spark, sf):
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = events.groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    expect, got = ({(r["start"], r["event_type"]): (r["n"], round(r["total"], 6)) for r in df.collect()} for df in (batch, QUERIES["stream_signal_counts"](spark, sf)))
    assert got == expect
