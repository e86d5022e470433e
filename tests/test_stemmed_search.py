"""The search by stems in one pass, against the stored index of stems."""

from folioscope.operators import postings, search
from folioscope.plans import registry
from tests.test_postings import corpus


def test_forms_of_stems_find_what_the_stemmed_index_finds(spark, tmp_path, monkeypatch):
    notes, queries = corpus(spark)
    sections = search.indexed(notes)
    scored, _ = postings.top(postings.build(sections, f"{tmp_path}/index", True), queries, 5)
    want = sorted(map(tuple, search.best_sections(scored, 5).collect()))
    asked, forms = postings.stemmed(sections, queries)
    assert {r.word for r in forms.where("term = 'run'").collect()} == {"running", "runs", "run"}
    for listed in (search.LISTED, 0):
        monkeypatch.setattr(search, "LISTED", listed)
        assert sorted(map(tuple, search.best_sections(search.bm25(sections, asked, forms), 5).collect())) == want


def test_the_stemmed_query_stores_no_index_of_words_that_no_question_asks_for(spark, sf, monkeypatch):
    monkeypatch.setattr(postings, "build", None)
    assert registry.QUERIES["h04_stemmed_search"](spark, sf).count() > 0
