"""Operators that SQL can't express, and the cases the tables can't show."""

import io
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import assets, graph, identity, packing, review, search, terms, transitions
from folioscope.plans import registry
from folioscope.sources import readers, sinks
from folioscope.streaming import jobs as S


def test_merge_closure_follows_chains_and_leaves_cycles(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x")], "slug string, target string")
    assert {tuple(r) for r in graph.merge_closure(m).collect()} == {("a", "c"), ("b", "c")}


def test_record_groups_join_over_either_key(spark):
    rng = random.Random(1)
    rows = [(i, f"w{rng.randint(0, 60)}" if i % 3 else None, f"d{rng.randint(0, 60)}" if i % 4 else None) for i in range(120)]
    root = {i: i for i, *_ in rows}
    changed = True
    while changed:
        changed = False
        for i, a, b in rows:
            for j, c, d in rows:
                if (a and a == c) or (b and b == d):
                    low = min(root[i], root[j])
                    changed |= root[i] != low or root[j] != low
                    root[i] = root[j] = low
    got = {r.id: r.root for r in graph.record_groups(spark.createDataFrame(rows, "id long, work string, doi string"), "id", ["work", "doi"]).collect()}
    assert got == root


def test_orphans_with_null_targets(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert [r.doc_id for r in graph.orphans(docs, spark.createDataFrame([(1,), (None,)], "target long")).collect()] == [2]


def test_many_sections_of_one_document_leave_room_for_others(spark):
    notes = spark.createDataFrame([(1, "\n".join(["apple pie"] * 100), "c", "t"), (2, "one apple here", "c", "t"), (3, "nothing", "c", "t")], "doc_id long, text string, category string, title string")
    q = spark.createDataFrame([(0, ["apple"])], "query_id long, terms array<string>")
    got = search.best_sections(search.bm25(search.indexed(notes), q), 2).collect()
    assert sorted(r.doc_id for r in got) == [1, 2]


def test_query_terms_keep_short_identifiers(spark):
    got = spark.createDataFrame([("What is the E3 of it",), ("of it to",), ("Écoles about genes genes",)], "t string").select(T.query_terms("t").alias("q")).collect()
    assert [r.q for r in got] == [["what", "is", "the", "e3", "of", "it"], ["of", "it", "to"], ["ecoles", "genes"]]


@pytest.mark.parametrize("raw,want", [("HbF / F-cells", ["HbF", "F-cells"]), ("PRS (polygenic risk score)", ["PRS", "polygenic risk score"]), ("mg/kg vs. dose", ["mg/kg"])])
def test_aliases(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(terms.aliases(F.col("t")).alias("a")).first().a == want


@pytest.mark.parametrize("raw,want", [("β-Cells", "b-cell"), ("SNPs", "snp"), ("analysis", "analysis"), ("mass", "mass"), ("genes", "gene")])
def test_normal_form(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(terms.normal(F.col("t")).alias("a")).first().a == want


def test_budget_flows_on_and_every_refusal_has_a_reason(spark):
    parts = [(1, 10, 0, 1, 500), (1, 10, 1, 1, 400), (1, 20, 0, 2, 100), (1, 20, 1, 2, 50), (1, 30, 0, 3, 100), (1, 40, 0, 4, 10)]
    got = {(r.doc_id, r.ord): (r.granted, r.reason) for r in packing.allocate(spark.createDataFrame(parts, "question long, doc_id long, ord int, rank int, size long"), 900, 3).collect()}
    assert got == {(10, 0): (500, None), (10, 1): (0, "over share"), (20, 0): (100, None), (20, 1): (50, None), (30, 0): (100, None), (40, 0): (0, "no slot")}


def test_batches_are_first_fit_in_order(spark):
    rng = random.Random(2)
    sizes = [rng.randint(1, 130) for _ in range(200)]
    want, batch, used = [], 0, 0
    for i, s in enumerate(sizes):
        s = min(s, 100)
        if used and used + s > 100:
            batch, used = batch + 1, 0
        used += s
        want.append((i, batch, s))
    df = spark.createDataFrame([("g", i, i, s) for i, s in enumerate(sizes)], "grp string, item long, pos long, size long").repartition(3)
    assert sorted((r.item, r.batch, r.taken) for r in packing.batches(df, 100).collect()) == want


def test_trimming_drops_passages_first(spark):
    rows = [(1, "base", 0, 50), (1, "passage", 0, 40), (1, "excerpt", 0, 30), (1, "excerpt", 1, 30), (2, "base", 0, 200), (3, "base", 0, 1)]
    got = {r.grp: (r.kept, r.dropped, r.bytes) for r in packing.trimmed(spark.createDataFrame(rows, "grp long, kind string, pos long, size long"), 100).collect()}
    assert got == {1: (1, 2, 80), 2: (None, 0, None), 3: (0, 0, 1)}


def archive(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return b.getvalue()


def test_office_readers(spark):
    book = archive({"xl/sharedStrings.xml": "<sst><si><t>gene</t></si><si><t>p</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="AB2"><v>1.5</v></c></row></sheetData></worksheet>'})
    word = archive({"word/document.xml": '<w:document xmlns:w="x"><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:document>'})
    files = spark.createDataFrame([("x.xlsx", book), ("bad", b"no"), ("none", None)], "path string, content binary")
    got = {tuple(r)[:5] for r in readers.spreadsheets(files).collect() if r.error is None}
    assert got == {("x.xlsx", "sheet1", 2, 1, "gene"), ("x.xlsx", "sheet1", 2, 28, "1.5")}
    assert [r.path for r in readers.spreadsheets(files).where("error is not null").collect()] == ["bad"]
    assert [tuple(r)[:5] for r in readers.word_tables(spark.createDataFrame([("d", word)], "path string, content binary")).collect()] == [("d", "table1", 1, 1, "a b")]
    z = spark.createDataFrame([("z.zip", archive({"in/a.csv": "1", "__MACOSX/x": "2"}))], "path string, content binary")
    assert [r.member for r in readers.archive_members(z).collect()] == ["z.zip::in/a.csv"]


def test_xml_readers(spark, tmp_path):
    tei = b"<TEI><teiHeader><title>T</title></teiHeader><text><abstract><p>A  b</p></abstract><head>H</head><p>c</p></text></TEI>"
    got = {r.path: r.markdown for r in readers.tei_markdown(spark.createDataFrame([("a", tei), ("b", b"<x/>"), ("c", b"<"), ("d", None)], "path string, content binary")).collect()}
    assert got == {"a": "# T\n\n## Abstract\n\nA b\n\n## H\n\nc", "b": None, "c": None, "d": None}
    (tmp_path / "c.xml").write_text("<S><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>X</ArticleTitle><Journal><JournalIssue><PubDate><Year>2001</Year></PubDate></JournalIssue></Journal><PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='doi'>10.1/A</ArticleId></ArticleIdList></PubmedData></PubmedArticle></S>")
    assert tuple(readers.citations(spark, str(tmp_path / "c.xml")).first()) == ("7", "X", "2001", "10.1/a", ["Review"])


def test_text_readers(spark, tmp_path):
    (tmp_path / "drafts").mkdir()
    (tmp_path / "a.md").write_text('---\ntitle: "A: b"\n x: no\nyear: 1\nyear: 2\n---\nbody')
    (tmp_path / "drafts" / "b.md").write_text("x")
    p = readers.pages(spark, str(tmp_path))
    fields, body = readers.frontmatter("text")
    r = p.select(fields.alias("f"), body.alias("b")).collect()
    assert len(r) == 1 and r[0].f == {"title": "A: b", "year": "2"} and r[0].b == "body"
    (tmp_path / "t.tsv").write_text("gene\tp\n\nA\t1\nB\t2\na \t3\n")
    assert [r.cells for r in readers.delimited(spark, str(tmp_path / "t.tsv"), "\t", "a").orderBy("line").collect()] == [["gene", "p"], ["A", "1"], ["a ", "3"]]
    (tmp_path / "l.json").write_text('{"step": "x", "n": 1}\n\n{"step": "y"}\n')
    assert sorted((r.step, r.n) for r in readers.json_lines(spark, str(tmp_path / "l.json"), "step string, n long").where("step is not null").collect()) == [("x", 1), ("y", 0)]


def test_front_matter_dialects(spark):
    d = spark.createDataFrame([('---\na: "x \\"y\\""\nb: [1, 2]\njunk\n---\nt',), ("no header",)], "t string")
    one = lambda **how: [r.f for r in d.select(readers.frontmatter("t", **how)[0].alias("f")).collect()]
    assert one(values="json") == [{"a": 'x "y"', "b": "[1, 2]"}, {}]
    assert one(values="raw", known=["b"]) == [{"b": "[1, 2]"}, {}]
    assert one(strict=True) == [None, {}]


def test_doi_dialects(spark):
    d = spark.createDataFrame([("https://doi.org/10.1000/AB%28c%29",), ("junk",), (None,)], "t string")
    got = d.select(T.doi("t").alias("a"), T.doi("t", strict=False).alias("b"), T.decoded_doi("t").alias("c")).collect()
    assert [tuple(r) for r in got] == [("10.1000/ab%28c%29", "10.1000/ab%28c%29", "10.1000/ab(c)"), (None, "junk", None), (None, None, None)]
    with pytest.raises(Exception, match="not a DOI: junk"):
        d.select(T.demanded_doi("t")).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, ["a", "b"]), (1, [])], "id long, tags array<string>")
    sinks.export_csv(df, str(tmp_path / "csv"), "id")
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).fillna("").collect()) == [("1", ""), ("2", "a; b")]
    assert sinks.create_only(df, str(tmp_path / "once")) and not sinks.create_only(df.limit(1), str(tmp_path / "once"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 2
    for run in ("r1", "r2"):
        sinks.publish_tables({"docs": df if run == "r1" else df.where("id = 1")}, str(tmp_path / "index"), run)
    assert sinks.published(spark, str(tmp_path / "index"), "docs").count() == 1
    page = sinks.html_report(spark.createDataFrame([("</script>",)], "t string"), "<t>")
    assert page.count("</script>") == 1 and "&lt;t&gt;" in page
    with pytest.raises(ValueError):
        sinks.html_report(spark.range(5), "x", most=4)
    t = spark.createDataFrame([("x",)], "t string").select(sinks.with_section(sinks.with_section("t", "H", "b"), "H", "b").alias("t")).first().t
    assert t == "x\n\n## H\nb\n"


@pytest.fixture
def log(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rng = random.Random(3)
    rows = [(i, rng.randint(1, 20), rng.choice(["view", "click", "purchase", "error"]), start + timedelta(minutes=i), float(i), i % 7) for i in range(600)]
    schema = "job_id long, member_id long, kind string, at timestamp, seconds double, request long"
    for k in range(3):
        spark.createDataFrame(rows[k * 200 : (k + 1) * 200], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return str(tmp_path / "log"), schema, rows


def run(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_streamed_intake_and_days_are_the_batch_results(spark, log, tmp_path):
    path, schema, rows = log
    first = run(S.first_requests(S.job_stream(spark, path, schema)), "first", "append", tmp_path)
    assert {(r.member_id, r.request) for r in first} == {(r[1], r[5]) for r in rows} and len(first) == len({(r[1], r[5]) for r in rows})
    days = run(S.daily(S.job_stream(spark, path, schema)), "days", "complete", tmp_path)
    batch = spark.read.schema(schema).parquet(path).groupBy(F.date_trunc("day", "at").alias("day"), "kind").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {(r.day, r.kind, r.n) for r in days} == {(r.day, r.kind, r.n) for r in batch}


def test_leases_end_or_expire(spark, tmp_path):
    start = datetime(2024, 1, 1)
    schema = "member_id long, kind string, at timestamp"
    for k, batch in enumerate([[(1, "view", 0), (2, "view", 0)], [(2, "purchase", 1)], [(9, "view", 600)], [(9, "view", 601)]]):
        spark.createDataFrame([(m, kind, start + timedelta(minutes=x)) for m, kind, x in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.member_id, r.status) for r in run(S.leases(stream, 600), "leases", "append", tmp_path)}
    assert (2, "done") in got and (1, "expired") in got


def test_new_objects_are_processed_once(spark, log, tmp_path):
    path, schema, rows = log
    out = str(tmp_path / "out")
    spark.createDataFrame([], schema).write.parquet(out)
    for _ in range(2):
        for checkpoint in ("a", "b"):  # a lost checkpoint reads all again, and finds it done
            S.process_new(S.job_stream(spark, path, schema), lambda: spark.read.parquet(out), "job_id", lambda df: df.write.mode("append").parquet(out), str(tmp_path / checkpoint)).awaitTermination()
    assert spark.read.parquet(out).count() == len(rows)


def test_the_rest_works_without_the_llm_folder(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not [k for k in q if k.startswith('op1_')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})


def test_text_evidence_needs_the_whole_title_before_the_references(spark):
    whole, opening = "A Long Opening That Many Titles Share: and then its own énd", "a long opening that many titles share: and then"
    docs = [
        (1, f"{whole.upper()} (2019, 1999, 2019) doi: 10.1234/AB(c)).\nReferences\ndoi:10.9999/late 2001"),
        (2, f"{opening} another"), (3, f"text\nReferences and Notes:\n{whole}"), (4, "x " + whole[20:]), (5, "see https://doi.org/10.1234/ab(c), short"), (6, None),
        (7, " ".join(f"doi:10.1000/{i}" for i in range(25)) + " doi:10.1000/)."),
    ]
    claims = spark.createDataFrame([("w", whole, "10.1234/ab(c)"), ("s", "short", None), ("n", "", "10.9999/late"), ("m", None, "10.1000/3")], "item_id string, title string, doi string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.item_id, r.doc_id, r.title_present, r.doi_present) for r in search.text_evidence(d, claims).collect()}
    assert got == {("w", 1, True, True), ("w", 5, False, True), ("s", 5, True, False), ("m", 7, False, True)}
    facts = {r.doc_id: r for r in search.text_facts(d).collect()}
    assert (facts[1].dois, facts[1].years, facts[1].errors) == (["10.1234/ab(c)"], [1999, 2019], [])
    assert facts[7].dois == [f"10.1000/{i}" for i in range(20)] and facts[7].errors == ["invalid_explicit_doi", "doi_candidate_limit_reached"] and facts[6].squashed == ""


# Identity


def one(spark, *values, **named):
    """The values of some column expressions over one row."""
    row = spark.range(1).select(*values, *[c.alias(k) for k, c in named.items()]).first()
    return row[0] if len(values) == 1 and not named else row


def plain_words(t):
    import re
    import unicodedata

    for k, v in T.LETTERS.items():
        t = (t or "").lower().replace(k, v)
    t = "".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c))
    return re.findall("[a-z0-9]+", t)


def test_fold_is_a_decomposition(spark):
    for t in ("Sáenz de Santa María", "Łukasz Đorđević", "Rühle Straße Æther Œuvre þorn", "ČŠŽ őű ğı ạẹ", "plain 12"):
        assert one(spark, F.array_join(T.tokens(F.lit(t)), " ")) == " ".join(plain_words(t))


@pytest.mark.parametrize("stem,want", [("garcia-lopez-2019-a-long-title", ("garcia-lopez", "2019", "a-long-title")), ("lee-no-year", ("lee", "", "no-year")), ("2001-x", ("", "2001", "x")), ("kim-1850-1999-b", ("kim-1850", "1999", "b")), ("kim-2020", ("kim", "2020", "")), ("kim", ("kim", "", "")), ("a-20201-2020-c", ("a-20201", "2020", "c"))])
def test_split_stem(spark, stem, want):
    assert tuple(one(spark, identity.split_stem(F.lit(stem)))) == want


@pytest.mark.parametrize("author,names,want", [
    ("de-la-cruz", ["Ana de la Cruz"], True), ("delacruz", ["Ana de la Cruz"], True), ("d'arcy", ["M. D’Arcy"], True), ("an", ["Joanna Mann"], False), ("ab", ["A. B. Smith"], False),
    ("novak-weiss", ["Eva Weiss"], True), ("tan", ["李明"], None), ("", ["X"], None), ("x", [], None), ("tan", ["Y. Xu", "P. Tan"], True), ("ng", ["K. Ng"], True), ("long-ago", ["Al Long"], True), ("kong", ["Hong Kong Group", ""], True),
])
def test_author_agreement(spark, author, names, want):
    assert one(spark, identity.author_agreement(F.lit(author), F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"))) is want


def test_titles_names_and_bands(spark):
    a = F.array(F.lit("Jo Smith-Lee"), F.lit("Kim Ng"))
    r = one(
        spark, hyphen=identity.title_overlap(F.lit("Snap-\n shots of opti- mal cells"), F.lit("Snapshots of optimal cells")), ratio=identity.title_ratio(F.lit("A map of cells"), F.lit("A map of the cells")),
        inside=identity.title_in_text(F.lit("A map of cells"), F.lit("## a MAP of cells, by")), short=identity.title_in_text(F.lit("A map of"), F.lit("a map of cells")), part=identity.title_in_text(F.lit("A map of cell"), F.lit("a map of cells")),
        cut=identity.coverage(F.lit("deep-interpretati-of-x"), F.lit("Deep interpretation of y")), tiny=identity.coverage(F.lit("abc"), F.lit("abcdef")), band=identity.is_banner(F.lit("RESEARCH | Article in Press Cell Maps"), F.lit("Cell Maps")),
        title=identity.is_banner(F.lit("Cell maps versus tissue"), F.lit("Cell Maps")), shared=identity.shared_authors(F.array(F.lit("Smith"), F.lit("Smith"), F.lit("Ng"), F.lit("Lee"), F.lit("Nobody")), a), first=identity.first_author_agrees(F.array(F.lit("Lee")), a), other=identity.first_author_agrees(F.array(F.lit("Wu"), F.lit("Lee")), a),
    )
    import difflib

    assert r.hyphen == 1.0 and abs(r.ratio - difflib.SequenceMatcher(None, "a map of cells", "a map of the cells").ratio()) < 1e-9
    assert (r.inside, r.short, r.part, r.cut, r.tiny, r.band, r.title, r.shared, r.first, r.other) == (True, False, False, 0.75, 0.0, True, False, 2, True, False)


def plain_judge(f, r):
    """The decision over a file and a record, step by step."""
    import difflib
    import re

    words, names = plain_words, [plain_words(re.sub("['‘’ʼ`]", "", a)) for a in r["authors"]]
    journal, band = set(words(r["journal"])), words(f["header"])
    banner = bool(band and journal and journal <= set(band) and all(w in journal or w in identity.BANNER for w in band))
    best, agrees = 0.0, False
    if f["header"] is not None and not banner:
        for t in (f["header"], re.sub(r"([^\W])-\s*([^\W])", r"\1\2", f["header"])):
            a, b = words(t), words(r["title"])
            if a and b:
                j, q = len({*a} & {*b}) / len({*a} | {*b}), difflib.SequenceMatcher(None, " ".join(a), " ".join(b)).ratio()
                best, agrees = max(best, j, q), agrees or j >= 0.8 or q >= 0.9
    title, known = words(r["title"]), {w for a in r["authors"] for w in words(a)}
    in_text = len(title) >= 4 and f" {' '.join(title)} " in f" {' '.join(words(f['head']))} "
    shared = len({tuple(words(s)) for s in f["surnames"] if len("".join(words(s))) >= 3 and {*words(s)} <= known})
    m = re.match(r"^(|.*?-)((?:19|20)\d{2})(?:-(.*))?$", f["stem"])
    author, year, rest = (m[1].rstrip("-"), int(m[2]), m[3] or "") if m else (f["stem"].split("-")[0], None, "-".join(f["stem"].split("-")[1:]))
    own = plain_words(re.sub("['‘’ʼ`]", "", author))
    joined = "".join(own)
    runs = lambda n: any(n[i : i + len(own)] == own or any("".join(n[i:j]) == joined and min(map(len, n[i:j])) > 1 for j in range(i + 1, len(n) + 1)) for i in range(len(n)))
    named = bool(own and r["authors"] and words(r["authors"][0])) and (any(runs(n) for n in names if n) or any([w for w in n if len(w) >= 4][-1:] and [w for w in n if len(w) >= 4][-1] in own for n in names))
    tokens = words(rest)
    covered = sum(t in title or len(t) >= 4 and any(w.startswith(t) for w in title) for t in tokens) / len(tokens) if tokens and title else 0.0
    by_name = covered >= (0.6 if f["from_doi"] else 0.8) and year is not None and abs(year - r["year"]) <= 1 and (named or shared >= 3)
    first = bool({*words(f["surnames"][0])} & known) if f["surnames"] and r["authors"] else None
    paper = not re.search(identity.NOT_A_PAPER, r["title"] or "")
    untitled = f["header"] is None or banner
    return round(best, 3), (agrees or in_text or (by_name and untitled)) and (f["from_doi"] or by_name or first is not False) and paper, agrees or in_text or by_name


def test_linkage_is_brute_force(spark, sf):
    from folioscope.plans import identity as P

    files, records = [r.asDict() for r in P.files(spark, sf).collect()], [r.asDict() for r in P.records(spark, sf).collect()]
    want = {}
    for f in files:
        found = [(r, True) for r in records if f["doi"] and r["doi"] == f["doi"]]
        year = identity_parts(f["stem"])[0]
        found += [(r, False) for r in records if abs(r["year"] - year) <= 1 and plain_judge(f | {"from_doi": False}, r)[2]]
        ranked = sorted(((not (x := plain_judge(f | {"from_doi": d}, r))[1], not d, -x[0], r["rid"], x) for r, d in found), key=lambda x: x[:4])
        if ranked:
            want[f["id"]] = (ranked[0][3], "doi" if not ranked[0][1] else "search", ranked[0][4][0], ranked[0][4][1])
    got = {r.id: (r.rid, r.route, r.score, r.agrees) for r in registry.QUERIES["d14_linkage"](spark, sf).collect()}
    assert {k: (*v[:2], v[3]) for k, v in got.items()} == {k: (*v[:2], v[3]) for k, v in want.items()} and all(abs(got[k][2] - want[k][2]) < 0.0011 for k in want) and {True, False} <= {x[3] for x in got.values()}


def identity_parts(stem):
    import re

    m = re.match(r"^(|.*?-)((?:19|20)\d{2})(?:-(.*))?$", stem)
    return int(m[2]), m[1], m[3] or ""


@pytest.mark.parametrize("name", ["i02_author_agreement", "d14_file_name", "i03_sequence_ratio"])
def test_small_tables_of_much_work_are_spread(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_words_of_a_name_are_made_once(spark):
    """The surname's words don't stand in the lambdas that name them."""
    df = spark.createDataFrame([("van-der-bilt", ["W. van der Bilt"])], "a string, n array<string>").select(identity.author_agreement("a", F.col("n")).alias("x"))
    assert df.first().x is True and df._jdf.queryExecution().optimizedPlan().toString().count("translate") <= 3


def test_covered_pairs_leave_out_what_cannot_be_covered(spark):
    """A shared rare word is not enough to meet: the rest must be there too."""
    from folioscope.operators import similar

    words = lambda i: ["rare"] + [f"w{i}x{k}" for k in range(9)]
    left = spark.createDataFrame([(1, 0, words(1)), (2, 0, words(2))], "id long, block int, words array<string>")
    right = spark.createDataFrame([(i, 0, words(i)) for i in range(1, 30)], "rid long, block int, words array<string>")
    assert sorted(map(tuple, similar.covered_pairs(left, right, 0.8).collect())) == [(1, 1), (2, 2)]
    assert sorted(map(tuple, similar.jaccard_pairs(left, right, 0.8).collect())) == [(1, 1), (2, 2)]


def test_sequence_ratios_are_difflibs(spark, sf):
    import difflib
    import re

    for r in registry.QUERIES["i03_sequence_ratio"](spark, sf).collect():
        pairs = [" ".join(plain_words(t)) for t in (r.header or "", re.sub(r"(\w)-\s*(\w)", r"\1\2", r.header or ""))]
        want = max(difflib.SequenceMatcher(None, a, " ".join(plain_words(r.title))).ratio() if a and r.title else 0.0 for a in pairs)
        assert abs(r.ratio - want) < 1e-5


# Figures and tables


@pytest.mark.parametrize("caption,key,panels", [
    ("Extended Data Fig. 3 | Overview. a, first; b, second", "extdatafig3", "ab"), ("Extended Data Table 12. x", "extdatatable12", ""), ("supplementary figure 2: (A) x (B) y (C) z", "suppfig2", "abc"),
    ("Supplementary Table 4", "supptable4", ""), ("TABLE 7 (a) only one", "table7", ""), ("Fig. 5 a Amyloid burden, b Tau burden", "figure5", "ab"), ("Figure 1. (a) x (c) y", "figure1", ""), ("no caption", None, ""),
])
def test_captions(spark, caption, key, panels):
    r = one(spark, n=assets.asset_name(F.lit(caption)), p=F.array_join(assets.panels(F.lit(caption)), ""))
    assert (r.n.key, r.p) == (key, panels)


def test_mentions_by_hand(spark):
    text = "Figure 1 shows what this paper found first. As Figs. 2-4 and Table S1 show, it holds for the cohort! See Fig. 1 (Extended Data Fig. 1) for the same in mice. Short Fig. 1. Figure 1 shows what this paper found first. Fig. 2 differs from Fig. 1 in this one sentence."
    got = {r.key: r for r in assets.mentions(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()}
    assert set(got) == {"figure1", "figure2", "figure4", "table1", "extdatafig1"}
    assert len(got["figure1"].sentences) == 3 and got["figure1"].related == ["extdatafig1", "figure2"]  # every reference counts
    assert len(got["figure2"].sentences) == 2 and got["figure2"].related == ["figure1", "figure4", "table1"]
    many = " ".join(f"Sentence number {i} of many refers to Fig. 1 and Table {i}." for i in range(40))
    (r,) = [r for r in assets.mentions(spark.createDataFrame([(1, many)], "doc_id long, text string")).collect() if r.key == "figure1"]
    assert len(r.sentences) == 12 and r.related == [f"table{i}" for i in range(10)]


def test_captions_that_go_on(spark):
    page = [("txt", "before the caption stands this"), ("cap", "Fig. 1 An unfinished (astro-"), ("fig", "x" * 40), ("txt", "short"), ("txt", "cytes and more words of it"), ("txt", "cytes and more words of it"), ("txt", "until the end is here."), ("txt", "this is never taken in, as it ended")]
    cases = [
        (page, "Fig. 1 An unfinished (astro-", "Fig. 1 An unfinished (astro- cytes and more words of it until the end is here."), (page, "Done.", "Done."), (page, "not on the page", "not on the page"),
        ([("cap", "open"), ("txt", "Table 2 begins another one here"), ("txt", "never taken in as it stopped")], "open", "open"), ([("cap", "open"), ("txt", "Methods of this paper were")], "open", "open"),
        ([("cap", "open")] + [("txt", f"block number {i} that goes on and") for i in range(9)], "open", "open " + " ".join(f"block number {i} that goes on and" for i in range(4))), ([], "open", "open"), (page, "", ""),
    ]
    rows = spark.createDataFrame([(i, b, c) for i, (b, c, _) in enumerate(cases)], "i int, items array<struct<kind:string,text:string>>, caption string")
    got = {r.i: r.c for r in rows.select("i", assets.extended_caption(F.col("items"), F.col("caption")).alias("c")).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(cases)}


def test_extended_captions_of_pages_are_plain_ones(spark, sf):
    import re

    def plain(items):
        caption = items[0][1]
        if not caption or re.search(assets.FINISHED, caption.strip()):
            return caption
        out, added = caption.strip(), 0
        for kind, text in items[1:]:
            if added >= 4:
                break
            if kind not in ("txt", "cap") or len(text) < 20:
                continue
            if re.match(assets.NEXT_CAPTION, text) or re.match(assets.NEXT_SECTION, text):
                break
            if text in out:
                continue
            out, added = f"{out} {text}".strip(), added + 1
            if re.search(assets.FINISHED, out):
                break
        return out

    pages = {}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        pages.setdefault(r.conv_id, []).append(("cap" if r.turn % 4 == 0 else "fig" if r.turn % 4 == 3 else "txt", r.text.rstrip(".!? \n") if r.turn % 4 == 0 else r.text))
    norm = lambda s: " ".join(s.split())
    got = {r.conv_id: norm(r.caption) for r in registry.QUERIES["h15_extended_captions"](spark, sf).collect()}
    assert got == {k: norm(plain(v)) for k, v in pages.items()}


# Pages


def test_outline_by_hand(spark):
    text = "\n# Title\n\nLead words.\n\n## Methods \nm\n### Detail\nd\n### Linked pages\n- [[a/b]]\n## Empty\n\n## (opening)\nodd"
    pages = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "no heading"), (5, "## R\n[x](y) [[z]]\n* http://e.org/f\n")], "page long, body string")
    got = {}
    for r in search.outline(pages, "page", "body").collect():
        got.setdefault(r.page, []).append((r.ord, r.heading, r.kind, r.content, r.start, r.end))
    assert [x[:4] for x in sorted(got[1])] == [(0, "((opening))", "other", "Lead words."), (1, "Methods", "methods", "m\n### Detail\nd"), (2, "Linked pages", "links", "- [[a/b]]"), (3, "(opening)", "other", "odd")]
    assert all(text[s:e] == c for *_, c, s, e in got[1]) and got[4] == [(0, "(opening)", "other", "no heading", 0, 10)] and {*got} == {1, 4, 5} and got[5][0][2] == "links"


def test_managed_blocks_of_any_marker(spark):
    t = "a\n<!-- x (1) -->\nb\n<!-- /x -->\nc"
    assert one(spark, search.without_blocks(F.lit(t), ("<!-- x (1) -->", "<!-- /x -->"))) == "a\nc"


def test_snippets_escape_their_terms(spark):
    got = one(spark, T.snippet(F.lit("Is c++ (a.b) like C++?"), F.array(F.lit("c++"), F.lit("(a.b)"), F.lit("is"))))
    assert got == "Is [c++] [(a.b)] like [C++]?"


def test_first_sentences(spark):
    cases = {"One, e.g. Two. Three": "One, e.g. Two.", "A et al.  Found it! Yes": "A et al. Found it!", "no end": "no end", " Fig. 3 is. it. So": "Fig. 3 is. it.", "": ""}
    assert {t: one(spark, T.first_sentence(F.lit(t))) for t in cases} == cases


def test_glossary_and_normal_forms(spark):
    page = "# P\n## 7. Glossary\n- **IFN‑γ / type II**： a cytokine\n  * **SNPs vs. genes**: first of them\n-**no**: x\n## Next\n- **out**: y"
    got = [(r.term, r.definition) for r in terms.glossary(spark.createDataFrame([(page,)], "text string")).collect()]
    assert got == [("IFN‑γ / type II", "a cytokine"), ("SNPs vs. genes", "first of them")]
    cases = {"IFN‑γ": "ifn-g", "SNPs": "snp", "Variants": "variant", "basis": "basis", "DNA–Protein θ's": "dna-protein th s", "HR‐QoLs": "hr-qol", "µM": "mm", "gas": "gas"}
    assert {t: one(spark, terms.normal(F.lit(t))) for t in cases} == cases


# Gates, replies, rounds


def test_sweep_of_nothing_is_an_error(spark):
    pages = spark.createDataFrame([("a", f"k{i}", ["e1", "e2"]) for i in range(4)] + [("b", "k", [])], "folder string, key string, errors array<string>")
    got = {r.folder: (r.checked, r.errors, r.listing) for r in review.sweep(pages, "folder", "errors", ["a", "b", "c"], 3).collect()}
    assert got == {"a": (4, 8, "k0: e1; k0: e2; k1: e1"), "b": (1, 0, ""), "c": (0, 1, "no pages were checked")}


@pytest.mark.parametrize("content,want", [
    ('{"exclude": ["a-b"], "merge": {"a": "b"}, "title": {"a": "T"}}', None), ("{}", None), ("nonsense", "content must be an object"), ("[]", "content must be an object"), ('{"exclude": ["A"]}', "exclude"), ('{"exclude": [1]}', "exclude"),
    ('{"exclude": {}}', "exclude"), ('{"merge": []}', "merge"), ('{"merge": {"a": "B b"}}', "merge"), ('{"title": {"a": ""}}', "title"), ('{"title": {"a b": "x"}}', "title"), ('{"title": "x"}', "title"),
])
def test_overrides(spark, content, want):
    assert one(spark, review.overrides_problem(F.lit(content))) == want


def test_replies_that_are_no_assignments(spark):
    ids = spark.createDataFrame([("k%d" % i, x) for i in range(6) for x in "ab"], "key string, id string")
    texts = ['{"assignments": {"a": "t", "b": "u"}}', '{"assignments": {"a": "t"}}', '{"assignments": {"a": "t", "b": 3}}', "x", '{"assignments": {"a": "t", "b": "t", "c": "t"}}', '{"assignments": {"a": "t", "b": "v"}}']
    got = {r.key: r.problem for r in review.decoded_assignments(spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "key string, text string"), ids, ["t", "u"]).collect()}
    every, target = "every supplied id exactly once, and no others", "unknown or non-string target"
    assert got == {"k0": None, "k1": every, "k2": target, "k3": "the response must be an object", "k4": every, "k5": target}


def test_searches_are_bounded(spark):
    with pytest.raises(ValueError):
        review.search_catalogue(spark.range(1), "", 10_001)


def test_walk_ends_and_goes_on(spark):
    rows = [(f"2024-01-0{1 + i // 4}", f"{i:02}", i) for i in range(10)]
    p = spark.createDataFrame(rows, "day string, sk string, job_id long")
    first = sorted(map(tuple, review.walked(p, 6).collect()))
    rest = sorted(map(tuple, review.walked(p, 6, first[-1][:2]).collect()))
    assert [r[2] for r in first] == list(range(6)) and not any(r[3] for r in first) and [r[2] for r in rest] == list(range(6, 10)) and all(r[3] for r in rest)


def test_relay_sends_at_least_once(spark):
    box = spark.createDataFrame([(i, "a" if i % 2 else "b", datetime(2024, 1, 1) + timedelta(hours=i), "pending", 0, None) for i in range(10)], "outbox_id long, kind string, created timestamp, status string, attempts int, sent timestamp")
    sent, now = [], F.lit(datetime(2024, 2, 1))

    def send(batch, fail=False):
        sent.extend(r.outbox_id for r in batch.collect())
        if fail:
            raise RuntimeError("down")

    with pytest.raises(RuntimeError):
        transitions.relayed(box, 2, now, lambda b: send(b, True))
    assert sorted(sent) == [0, 1, 2, 3]  # sent, but not marked
    for _ in range(3):
        box = spark.createDataFrame(transitions.relayed(box, 2, now, send).collect(), box.schema)
    assert {*sent} == set(range(10)) and box.where("status = 'pending'").count() == 0 and len(sent) == 14
    again = transitions.relayed(box, 9, now, send, F.lit(datetime(2024, 3, 1)))
    assert {r.attempts for r in again.collect()} == {2}


def test_transactions_are_all_or_nothing(spark):
    items = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, revision long")
    ops = [(1, "a", "update", 1), (1, "d", "create", None), (2, "a", "update", 2), (3, "b", "delete", 2), (3, "c", "check", 9), (4, "c", "check", 3), (4, "e", "create", None), (5, "b", "update", 2), (6, "f", "update", 1), (7, "g", "create", None), (7, "g", "create", None)]
    ops = spark.createDataFrame(ops, "txn long, key string, op string, expected long")
    got = {r.txn: (r.outcome, r.problem) for r in transitions.decided(items, ops).collect()}
    assert got == {1: ("committed", None), 2: ("retry", "in progress"), 3: ("failed", "revision"), 4: ("retry", "in progress"), 5: ("retry", "in progress"), 6: ("failed", "missing"), 7: ("failed", "repeated key")}
    assert {tuple(r) for r in transitions.applied(items, ops).collect()} == {("a", 2), ("b", 2), ("c", 3), ("d", 1)}


def test_empty_previews_take_no_room(spark, tmp_path):
    spark.createDataFrame([(i, "", "xx") for i in range(5000)] + [(i, "y" * 100 if i < 5050 else None, "yy") for i in range(5000, 5100)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in registry.QUERIES["f12_bounded_rows"](spark, str(tmp_path)).collect()} == {("xx", 5000, 0), ("yy", 40, 60)}


def test_merge_trees(spark):
    got = [tuple(r) for r in packing.merge_tree(spark.createDataFrame([("g", i) for i in range(31)] + [("h", 0)], "grp string, batch int")).orderBy("grp", "level", "node").collect()]
    assert [g for g in got if g[0] == "g" and g[1] > 0] == [("g", 1, 0, 0, 14), ("g", 1, 1, 15, 29), ("g", 1, 2, 30, 30), ("g", 2, 0, 0, 2)] and [g for g in got if g[0] == "h"] == [("h", 0, 0, 0, 0)]
