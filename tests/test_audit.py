"""The nine-field audit by hand."""

from folioscope.operators import audit

SCHEMA = (
    "work_id string, title string, openalex_title string, year string, openalex_year int, authors array<string>, openalex_authors array<string>, journal string, openalex_venue string, type string, openalex_type string, "
    "pmid string, pmid_openalex string, pmcid string, pmcid_openalex string, referenced_works array<string>, openalex_referenced_works array<string>, is_open_access boolean, openalex_is_oa boolean"
)
SAME = ("A title!", "a TITLE", "2001", 2001, ["Ng, J."], ["Jo Ng"], "Cell", "cell", "article", "Article", "PMID:7", "https://x.org/7", "PMC1", "pmc1", ["W1", "https://x.org/W2"], ["W2", "W1"], False, False)


def row(i, **other):
    names = [c.split()[0] for c in SCHEMA.split(", ")][1:]
    return (f"w{i}", *(dict(zip(names, SAME)) | other).values())


def test_forms_are_compared_and_what_has_none_is_incomparable(spark):
    rows = [
        row(1), row(2, year="2002", title=None), row(3, year="1999", openalex_is_oa=True), row(4, year="about 2001", openalex_authors=["The X Consortium"]), row(5, is_open_access=None, openalex_referenced_works=["W1", "bad"]),
        row(6, journal="", openalex_title="other", pmid="8"), row(7, openalex_title="other"), row(8, openalex_title="other"), row(9, openalex_title="other", openalex_referenced_works=[], openalex_authors=["Ng"] * 30), row("a" * 300, title=None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.field: r for r in audit.coverage(df).collect()}
    t, y, o = got["title"], got["year"], got["oa"]
    assert (t.catalogue, t.openalex, t.missing_present, t.both_present, t.compared, t.differing, t.samples) == (8, 10, 2, 8, 8, 4, "w6,w7,w8")
    assert (y.compared, y.differing, y.one_year, y.more_years) == (10, 3, 1, 1)  # one value is no number
    assert (o.catalogue, o.both_present, o.differing) == (9, 9, 1)  # False is a value
    assert (got["authors"].incomparable, got["references"].incomparable, got["references"].openalex, got["journal"].catalogue, got["pmid"].differing) == (1, 1, 9, 9, 1)
    m = audit.list_marks(df).first()
    assert (m.authors_at_cap, m.references, m.invalid_references) == (1, 18, 1)
    assert {r.differing for r in audit.coverage(df.limit(0)).collect()} == set()


def test_samples_sort_and_explode_no_rows(spark):
    plan = audit.coverage(spark.createDataFrame([row(1)], SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and "GlobalLimit 3" in plan
