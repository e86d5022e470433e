"""The catalogue's export and accepted merges, by hand."""

import hashlib
import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folioscope.operators import terms
from folioscope.sources import sinks


def test_export_takes_metadata_from_records_and_gives_a_receipt(spark, tmp_path):
    schema = "work_id string, title string, authors array<string>, year int, pdf_key string, pdf_bytes decimal(10,2), journal string, record struct<authors: array<string>, publication_year: int, source: string, type: string>"
    rows = [("w2", 'a "q", b', ["X Y", "Z"], 2001, "k2", Decimal("12.00"), "J", None), ("w1", None, None, None, "k1", Decimal("1.50"), "", (["A", "B"], 1999, "S", "article")), ("w3", "no pdf", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = {r.work_id: r for r in sinks.catalogue_rows(df).collect()}
    assert list(got["w1"].asDict()) == sinks.CATALOGUE and len(sinks.CATALOGUE) == 24 and set(got) == {"w1", "w2"}
    assert (got["w1"].authors, got["w1"].year, got["w1"].journal, got["w1"].document_type, got["w1"].pdf_bytes, got["w1"].title) == ("A; B", "1999", "S", "article", "1.5", "")
    assert (got["w2"].authors, got["w2"].year, got["w2"].journal, got["w2"].document_type, got["w2"].pdf_bytes) == ("X Y; Z", "2001", "J", "", "12")
    path = f"{tmp_path}/out"
    receipt = sinks.export_catalogue(df, path)
    assert (receipt["rows"], receipt["scanned"], receipt["columns"]) == (2, 3, sinks.CATALOGUE)
    for p in receipt["parts"]:
        with open(os.path.join(path, p["part"]), "rb") as f:
            data = f.read()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (p["bytes"], p["sha256"])
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.export_catalogue(df, path)
    assert sinks.export_catalogue(df, path, force=True)["rows"] == 2


def test_merges_need_a_shared_name_of_several_words(spark):
    c = [("asd", "term", ["ASD", "autism spectrum disorders"]), ("autism", "term", ["Autism Spectrum Disorder", "autism"]), ("shank3", "gene", ["SHANK3", "big scaffold protein"]), ("scaffold", "term", ["Big scaffold protein"]), ("no", "term", ["NO"]), ("no2", "term", ["NO", "nitric oxide"])]
    merges = [("asd", "autism"), ("scaffold", "shank3"), ("no", "no2"), ("asd", "nowhere")]
    got = {(r.source, r.target): r.reason for r in terms.safe_merges(spark.createDataFrame(c, "slug string, kind string, forms array<string>"), spark.createDataFrame(merges, "source string, target string")).collect()}
    assert got == {("asd", "autism"): None, ("scaffold", "shank3"): terms.GENE, ("no", "no2"): terms.UNSHARED, ("asd", "nowhere"): terms.UNKNOWN}


def test_a_report_of_any_size_is_pages_of_bounded_rows(spark):
    df = spark.createDataFrame([(i, f"</script>{i}", f"2024-01-{i % 20 + 1:02d}") for i in range(25)], "key long, t string, day string")
    pages = sinks.html_pages(df, "<t>", "key", most=10, date="day")
    html = {r.page: r.html for r in pages.collect()}
    assert sorted(html) == [0, 1, 2] and all(h.count("</script>") == 1 and "&lt;t&gt;" in h for h in html.values())
    assert [len(sinks.report_parts(html[i])[2]) for i in range(3)] == [10, 10, 5] and sinks.report_parts(html[2])[:2] == ("2024-01-01", "2024-01-20")
    rows = [(r.page, r.first, r.last, json.loads(r.row)) for r in sinks.page_parts(pages).collect()]
    assert sorted((p, r["key"], r["t"]) for p, _, _, r in rows) == [(i // 10, i, f"</script>{i}") for i in range(25)] and {(f, l) for _, f, l, _ in rows} == {("2024-01-01", "2024-01-20")}
    assert sinks.html_pages(df.limit(0), "t", "key", date="day").count() == 0


def test_report_query_holds_more_suppliers_than_a_page(spark, tmp_path):
    from folioscope.plans import registry

    spark.range(10_050).selectExpr("id as s_suppkey", "'S' || id as s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    got = registry.QUERIES["b07_html_report"](spark, str(tmp_path)).agg(F.count("*"), F.count_distinct("key"), F.every("alone"), F.every("refused")).first()
    assert tuple(got) == (10_050, 10_050, True, True)
