"""The stored index: stems of the published examples, and pruned search against the whole one."""

import random

from folioscope.operators import postings, search

#: The examples of the algorithm's paper.
EXAMPLES = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan
falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit
sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll by by a1s a1s is is""".split()


def test_stems_are_those_of_the_paper(spark):
    words = EXAMPLES[::2]
    got = {r.term: r.stem for r in postings.stems(spark.createDataFrame([(w,) for w in words], "term string")).collect()}
    assert [(w, got[w]) for w in words] == list(zip(words, EXAMPLES[1::2]))


def corpus(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["running", "runs", "run"]
    pick = lambda n: " ".join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(n))
    notes = [(i, "\n".join(pick(rng.randint(1, 25)) for _ in range(rng.randint(1, 6))), pick(2)) for i in range(300)]
    notes += [(900 + i, notes[7][1], notes[7][2]) for i in range(9)]  # ties
    queries = [(i, sorted({words[min(int(rng.expovariate(0.05)), len(words) - 1)] for _ in range(rng.randint(1, 4))})) for i in range(30)] + [(99, ["nowhere"]), (98, [])]
    return spark.createDataFrame(notes, "doc_id long, text string, title string"), spark.createDataFrame(queries, "query_id long, terms array<string>")


def test_pruned_search_is_the_whole_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    notes, queries = corpus(spark)
    sections = search.indexed(notes)
    want = sorted(map(tuple, search.best_sections(search.bm25(sections, queries), 5).collect()))
    index = postings.build(sections, f"{tmp_path}/index")
    for listed in (postings.LISTED, 0):
        monkeypatch.setattr(postings, "LISTED", listed)
        scored, opened = postings.top(index, queries, 5)
        assert sorted(map(tuple, search.best_sections(scored, 5).collect())) == want
        counts = opened.agg({"blocks": "sum", "opened": "sum"}).first()
        assert counts["sum(opened)"] < counts["sum(blocks)"]
    monkeypatch.setattr(search, "LISTED", 0)
    assert sorted(map(tuple, search.best_sections(search.bm25(sections, queries), 5).collect())) == want


def test_a_question_reads_only_its_buckets(spark, tmp_path):
    notes, _ = corpus(spark)
    index = postings.build(search.indexed(notes), f"{tmp_path}/index")
    one = spark.createDataFrame([(1, "w3")], "query_id int, term string")
    plan = postings.asked(spark, index, one)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,w3)]" in plan


def test_stemmed_search_meets_other_forms(spark, tmp_path):
    notes = spark.createDataFrame([(1, "the runner is running fast", "x"), (2, "he runs", "y"), (3, "walking", "z")], "doc_id long, text string, title string")
    index = postings.build(search.indexed(notes), f"{tmp_path}/index", stemmed=True)
    scored, _ = postings.top(index, spark.createDataFrame([(1, ["run", "walks"])], "query_id long, terms array<string>"), 5)
    assert sorted(r.doc_id for r in search.best_sections(scored, 5).collect()) == [1, 2, 3]
