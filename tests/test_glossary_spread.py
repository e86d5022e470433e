"""Glossaries are made where their documents lie; ids that documents share still make one note of them."""

import re

from pyspark.sql import functions as F

from folioscope.operators import terms
from folioscope.plans import registry
from folioscope.sizes import parted


def documents(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_texts_of_own_ids_are_not_shuffled(spark, sf):
    df = registry.QUERIES["h09_glossary"](spark, sf)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    assert "text" in plan.toString()
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert not re.search(r"hashpartitioning\((?!__)", final)


def test_shared_ids_make_one_note(spark, tmp_path):
    rows = [(1, "en", "alpha beta gamma\nshort\ndelta epsilon zeta"), (1, "en", "eta theta iota\n\nkappa lambda mu nu"), (1, "fr", "one two three"), (2, "en", None), (3, None, "four five six"), (3, None, "seven eight nine")]
    got = sorted((r.doc_id, r.term) for r in registry.QUERIES["h09_glossary"](spark, documents(spark, tmp_path, rows)).collect())
    assert got == sorted([(1, "alpha (beta)"), (1, "eta (theta)"), (1, "ZETs vs delta"), (1, "MUs vs kappa"), (1, "one (two)"), (3, "four (five)"), (3, "seven (eight)")])


def test_parted_tells_shared_keys(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "x"), (None, "y"), (4, None)], "k long, v string")
    alone, shared = parted(d, "k")
    assert sorted(r.v or "" for r in alone.collect()) == ["", "a"] and sorted(r.v for r in shared.collect()) == ["a", "b", "x", "y"]


def test_sections_end_where_the_pattern_ended(spark):
    texts = ["## Glossary\n- **a**: b\n## End\n- **c**: d", "x\n## 7. Glossary \t\n* **a / b** ： c\n## Glossary\n- **no**: no", "## Glossary\n## End\n- **a**: b", "## Glossary\n- **last**: line\n", "no heading", "# Glossary\n- **a**: b", None, "y## Glossary\n- **a**: b"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    pattern = terms.HEADING + r"([\s\S]*?)(?:\n## |$)"
    old = d.select("doc_id", F.regexp_extract("text", pattern, 1).alias("s")).select("doc_id", F.explode(F.arrays_zip(*[F.regexp_extract_all("s", F.lit(terms.LINE), F.lit(k)).alias(n) for k, n in ((1, "t"), (2, "d"))])).alias("x")).select("doc_id", F.trim("x.t"), F.trim("x.d"))
    got = sorted(map(tuple, terms.glossary(d).collect()))
    assert got == sorted(map(tuple, old.collect())) and len(got) == 4


def test_forms_are_made_once(spark, sf):
    plan = registry.QUERIES["e12_merged_counts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Glossary[" not in plan  # what is counted reads a table of forms
