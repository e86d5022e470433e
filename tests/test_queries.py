"""Every registered query against its SQL, and against itself on shuffled input."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscope.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, int):
        return v
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    return str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in found), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["f01_bm25_topk", "e08_issue_queue", "g01_membership_change", "d12_co_occurrence", "j02_idempotent_intake", "f05_latest_per_key"])
def test_result_is_the_same_for_shuffled_input(spark, sf, tmp_path, name):
    for t in TABLES:
        spark.read.parquet(f"{sf}/{t}.parquet").orderBy(F.rand(3)).repartition(3).write.parquet(f"{tmp_path}/{t}.parquet")
    a, b = QUERIES[name](spark, sf), QUERIES[name](spark, str(tmp_path))
    assert rows(a.columns, a.collect()) == rows(b.columns, b.collect())


def test_budgets_take_every_line(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", F.col("l_linenumber").cast("int"))
    found = QUERIES["f04_budget_allocation"](spark, sf).select("doc_id", "ord")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, lines.collect()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert {*__spark_entry__.oracle_sql()} <= {*__spark_entry__.queries()}
