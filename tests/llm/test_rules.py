"""Rules of the subpackage as such."""

import os
import re

from folioscope.llm.queries import QUERIES, SQL

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_all_queries_and_their_sql():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14)) and {*SQL} <= {*QUERIES}


def test_native_operators_run_no_python(spark, sf):
    for n in (2, 4, 6, 12):
        name = next(k for k in QUERIES if k.startswith(f"op{n}_"))
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_nothing_else_imports_the_subpackage():
    for d, _, files in os.walk(os.path.join(ROOT, "folioscope")):
        if os.path.basename(d) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(d, f)) as h:
                        assert "folioscope.llm" not in h.read(), f


def test_results_with_duckdb(spark, sf):
    import duckdb

    c = duckdb.connect()
    for name in ("documents", "embeddings"):
        c.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    for name, sql in SQL.items():
        want = c.sql(sql)
        df = QUERIES[name](spark, sf)
        assert sorted(df.columns) == sorted(want.columns)
        order = sorted(df.columns)
        plain = lambda r: tuple(str(x) for x in r)
        assert sorted(map(plain, df.select(*order).collect())) == sorted(map(plain, want.select(", ".join(order)).fetchall())), name
