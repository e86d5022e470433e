"""Decisions over pages, drafts, replies and identifiers: structure checks, gates, adjudication, holds and proposals, rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

#: The level-two headings that each kind of page must have.
SOURCE = ("Citation", "Methods", "Results", "Limitations", "Evidence boundary")
LONG_SOURCE = ("One-line Summary", "1. Document Information", "2. Key Contributions", "3. Methodology and Architecture", "4. Key Results and Benchmarks", "5. Limitations and Future Work", "6. Related Work", "7. Glossary")
PAPER = ("Summary", "Key findings", "Limitations", "Related pages")
OVERVIEW = ("Scope", "Synthesis", "Open questions", "Related papers")
QUESTION = ("Question", "Sharper follow-up", "What the knowledge base holds", "Tentative answer from the knowledge base", "Related Pages")
CONCEPT = ("Definition", "What the notes show", "Disagreements and limits", "Related concepts", "Notes")
SUBTOPIC = ("Scope", "Findings", "Comparison", "Open questions", "Concepts", "Notes")
CATEGORY = ("Landscape", "Subtopics", "Key concepts", "Open questions", "Coverage")
OTHER = ("Summary", "Key Contributions", "Methodology and Architecture", "Results", "Related Papers")
FOLDERS = {"concepts": CONCEPT, "questions": QUESTION, "papers": PAPER}
KINDS = {"concept": CONCEPT, "subtopic": SUBTOPIC, "category": CATEGORY}
DRAFT = (*SOURCE[:4], "Evidence boundary", "Related pages")
FILLER = r"(?i)\b(TODO|TBD|lorem ipsum|as an AI|placeholder)\b"
LEAST_DRAFT = 1500


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def reasons(*rules: tuple[Column, str | Column]) -> Column:
    """The reasons whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(why) if isinstance(why, str) else why) for cond, why in rules]))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The first reason whose condition holds, or null."""
    return reduce(lambda out, rule: out.when(F.coalesce(rule[0], F.lit(False)), rule[1]), rules[1:], F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1]))


def missing_headings(text: Column, schema: tuple[str, ...]) -> Column:
    return F.filter(F.transform(strings(schema), lambda h: F.concat(F.lit("## "), h)), lambda h: ~F.contains(text, h))


def page_errors(folder: Column, kind: Column, text: Column) -> Column:
    """``missing ...`` for each required heading a page lacks; a source is held against the schema it is closer to, the first on ties."""
    a, b = missing_headings(text, SOURCE), missing_headings(text, LONG_SOURCE)
    out = F.when(folder == "sources", F.when(F.size(a) <= F.size(b), a).otherwise(b))
    for k, schema in KINDS.items():
        out = out.when((folder == "overviews") & (kind == k), missing_headings(text, schema))
    out = out.when(folder == "overviews", missing_headings(text, OVERVIEW))
    for f, schema in FOLDERS.items():
        out = out.when(folder == f, missing_headings(text, schema))
    return F.transform(out.otherwise(missing_headings(text, OTHER)), lambda h: F.concat(F.lit("missing "), h))


def section_problems(text: Column, sections: tuple[str, ...] = DRAFT, least: int = LEAST_DRAFT) -> Column:
    """What is wrong with a note that must have exactly these sections, begin with the first of them and hold no filler."""
    first = f"## {sections[0]}"
    begins = F.ltrim(text, F.lit(" \t\n\r")).startswith(first)
    missing = F.transform(missing_headings(text, sections), lambda h: F.concat(F.lit("missing section "), h))
    more = reasons(
        (F.size(F.regexp_extract_all(text, F.lit("(?m)^## "), F.lit(0))) != len(sections), "unexpected number of level-2 sections"),
        (~begins, f"note must start with {first}"),
        (begins & ~text.rlike(rf"(?m)^\Q{first}\E[ \t]*$"), f"{first} must be a heading on its own line"),
        (F.contains(F.split(text, rf"\Q{first}\E", 2)[0], F.lit("---")), "frontmatter must not be model-written"),
        (text.rlike(FILLER), "placeholder or filler text present"),
        (F.length(text) < least, "note is too short to be a full evidence note"),
    )
    return F.concat(missing, more)


def sweep(pages: DataFrame, by: str, errors: str, domain: list[str], shown: int = 5) -> DataFrame:
    """by, checked, errors (their number), listing (the first ones) for every value of a domain; an error where nothing was checked.

    ``pages``: by, key, errors (array).
    """
    e = pages.select(by, "key", F.posexplode(errors).alias("at", "error"))
    top = e.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy("key", "at"))).where(F.col("nth") <= shown)
    listing = top.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.concat_ws(": ", "key", "error").alias("e")))), lambda x: x["e"]), "; ").alias("listing"))
    n = pages.groupBy(by).agg(F.count(F.lit(1)).alias("checked"), F.sum(F.size(errors)).alias("errors"))
    every = pages.sparkSession.createDataFrame([(d,) for d in domain], f"{by} string")
    none = F.col("checked").isNull()
    return every.join(n, by, "left").join(listing, by, "left").select(by, F.coalesce("checked", F.lit(0)).alias("checked"), F.when(none, 1).otherwise(F.col("errors")).alias("errors"), F.when(none, "no pages were checked").otherwise(F.coalesce("listing", F.lit(""))).alias("listing"))


def promotion_refusal(d: dict[str, Column], item: dict[str, Column], body: Column, text_hash: Column, edited: Column) -> Column:
    """Why a draft (header fields ``d``) may not become a reviewed note, given its catalogue row; null if it may. All must hold, the first that doesn't is the reason."""
    problems = section_problems(body)
    own = ("pdf_sha256", "grobid_sha256", "ingest_model", "ingest_harness")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return first_reason(
        (~d["work_id"].eqNullSafe(item["work_id"]), "draft is for another work"),
        (~d["draft_status"].eqNullSafe(F.lit("model_draft")), "only model_draft can be promoted"),
        (~empty(d["draft_problems"]), "draft recorded validator problems"),
        (~d["review_status"].eqNullSafe(F.lit("unreviewed")), "draft is not unreviewed"),
        *[(empty(d[k]), f"draft lacks {k}") for k in own],
        (F.size(problems) > 0, "draft body fails the check"),
        (~item["ingest_status"].eqNullSafe(F.lit("model_draft")), "catalogue is not at model_draft"),
        (item["review_status"].isNotNull() & (item["review_status"] != "unreviewed"), "catalogue is already reviewed"),
        (empty(item["draft_sha256"]), "catalogue has no draft hash"),
        *[(~item[k].eqNullSafe(d[k]), f"{k} differs from the catalogue") for k in own[:2]],
        ((text_hash != item["draft_sha256"]) & ~edited, "draft differs from the recorded one"),
    )


def ingest_refusal(is_oa: Column, licence: Column, pdf_url: Column, text_url: Column, verdict: Column) -> Column:
    """Why a work may not be taken in; null if it may."""
    free = F.coalesce(licence, F.lit("")).startswith("cc-") | F.coalesce(licence, F.lit("")).isin("cc0", "public-domain")
    return first_reason((~F.coalesce(is_oa, F.lit(False)), "not open access"), (~free, "no supported licence"), ((F.coalesce(pdf_url, F.lit("")) == "") | (F.coalesce(text_url, F.lit("")) == ""), "needs both content URLs"), (~verdict.eqNullSafe(F.lit("include")), "journal is not allow-listed"))


def search_catalogue(rows: DataFrame, query: str, most: int, from_year=None, to_year=None, tag=None, oa_only=False, fulltext_only=False, verdicts=None, corpus=None) -> DataFrame:
    """Rows (id, search_text, year, cited, tags, oa, fulltext, verdict, corpus, superseded_by) that hold every term and pass every filter, most cited first.

    Rows of no corpus and retired duplicates are never found.
    """
    if not 1 <= most <= 10_000:
        raise ValueError("between 1 and 10000 rows can be asked for")
    found = [F.col("superseded_by").isNull(), F.col("corpus").isNotNull() if corpus is None else F.col("corpus") == corpus]
    found += [F.contains("search_text", F.lit(t)) for t in query.lower().split()]
    found += [F.col("year") >= from_year] * (from_year is not None) + [F.col("year") <= to_year] * (to_year is not None)
    found += [F.array_contains("tags", tag)] * bool(tag) + [F.col("oa")] * bool(oa_only) + [F.col("fulltext")] * bool(fulltext_only)
    found += [F.col("verdict").isin(*verdicts)] if verdicts else []
    return rows.where(reduce(lambda a, b: a & b, found)).orderBy(F.desc("cited"), F.desc("year"), F.desc("id")).limit(most)


def decoded_lines(replies: DataFrame, batch: DataFrame, allowed: list[str]) -> DataFrame:
    """key, id, label of replies (key, text) whose lines are ``number: label``, for a batch (key, number, id).

    The last legal line of a number counts; other lines, numbers outside the batch and unknown labels are passed over, and ids
    without a line have a null label.
    """
    line = r"^\s*(\d{1,9})\s*[:.]\s*([a-z0-9-]+)\s*$"
    said = replies.select("key", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.col("line").rlike(line))
    said = said.select("key", "at", F.regexp_extract("line", line, 1).cast("int").alias("number"), F.regexp_extract("line", line, 2).alias("label")).where(F.col("label").isin(*allowed))
    last = said.groupBy("key", "number").agg(F.max_by("label", "at").alias("label"))
    return batch.join(last, ["key", "number"], "left").select("key", "id", "label")


def decoded_assignments(replies: DataFrame, batch: DataFrame, legal: list[str]) -> DataFrame:
    """key, problem, n: replies (key, text) that are JSON objects with ``assignments`` from every id of the batch (key, id), once and no others, to legal targets."""
    said = replies.select("key", F.try_variant_get(F.try_parse_json("text"), "$.assignments", "map<string,variant>").alias("m"))
    expected = batch.groupBy("key").agg(F.count_distinct("id").alias("expected"))
    each = said.select("key", F.explode_outer("m").alias("id", "target"))
    text = F.when(F.schema_of_variant("target") == "STRING", F.variant_get("target", "$", "string"))
    known = batch.select("key", "id", F.lit(1).alias("k")).distinct()
    n = each.join(known, ["key", "id"], "left").groupBy("key").agg(F.count("id").alias("n"), F.count("k").alias("known"), F.count_if(F.col("id").isNotNull() & ~F.coalesce(text.isin(*legal), F.lit(False))).alias("illegal"))
    j = said.join(n, "key").join(expected, "key", "left")
    problem = first_reason((F.col("m").isNull(), "the response must be an object"), ((F.col("n") != F.col("known")) | (F.col("known") != F.coalesce("expected", F.lit(0))), "every supplied id exactly once, and no others"), (F.col("illegal") > 0, "unknown or non-string target"))
    return j.select("key", problem.alias("problem"), F.when(problem.isNull(), F.col("n")).otherwise(0).alias("n"))


SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"


def overrides_problem(content: Column) -> Column:
    """What is wrong with the shape of an edit: exclude (slugs), merge (slug to slug) and title (slug to text that isn't empty); null if nothing is."""
    v = F.try_parse_json(content)
    got = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    there = lambda name: got(name, "variant").isNotNull()
    words = lambda x: F.schema_of_variant(x) == "STRING"
    slug = lambda c: F.coalesce(c.rlike(SLUG), F.lit(False))
    value = lambda x: F.when(words(x), F.variant_get(x, "$", "string"))
    ex, me, ti = got("exclude", "array<variant>"), got("merge", "map<string,variant>"), got("title", "map<string,variant>")
    bad_ex = there("exclude") & (ex.isNull() | F.exists(ex, lambda x: ~slug(value(x))))
    bad_me = there("merge") & (me.isNull() | F.exists(F.map_entries(me), lambda e: ~slug(e["key"]) | ~slug(value(e["value"]))))
    bad_ti = there("title") & (ti.isNull() | F.exists(F.map_entries(ti), lambda e: ~slug(e["key"]) | (F.trim(F.coalesce(value(e["value"]), F.lit(""))) == "")))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return first_reason((~is_object, "content must be an object"), (bad_ex, "exclude"), (bad_me, "merge"), (bad_ti, "title"))


# Identifiers and authorities


#: Types and titles of records that a person must look at.
ODD_TYPES = "erratum|correction|corrected|retract|expression of concern|duplicate publication|book"
ODD_TITLE = r"(?i)^(?:\[\s*)?(?:author correction|publisher correction|correction|erratum|corrigendum|retraction|withdrawal|expression of concern)\b"


def title_key(c: Column) -> Column:
    return F.array_join(T.tokens(F.coalesce(c, F.lit(""))), " ")


def exclusions(r: Column) -> Column:
    """Reasons to look at an authority's record (record_type, types, title, relations, errors) before its identifier is believed."""
    return reasons(
        (~r["record_type"].eqNullSafe(F.lit("article")), "not_journal_article"),
        (F.lower(F.array_join(r["types"], " ")).rlike(ODD_TYPES), "publication_type_requires_review"),
        (F.coalesce(r["title"], F.lit("")).rlike(ODD_TITLE), "notice_title_requires_review"),
        (F.size(r["relations"]) > 0, "publication_relationship_requires_review"),
        (F.size(r["errors"]) > 0, "record_identity_error"),
    )


def looked_up(items: DataFrame, records: DataFrame, **keys: str) -> DataFrame:
    """``items`` with a struct for each keyword: the record whose pmid is in that column, or null.

    The records with their repeats removed are one row for each pmid, so a join never multiplies items.  Items without a pmid
    find nothing; they are dealt out by what else they hold, or one task would get them all.
    """
    r = records.dropDuplicates(["pmid"])
    plain = [F.col(c) for c, t in items.dtypes if not t.startswith(("array", "map", "struct", "variant"))]
    for name, column in keys.items():
        one = r.select(F.col("pmid").alias(f"__{name}"), F.struct(*r.columns).alias(name))
        by = items.withColumn("__by", F.coalesce(F.col(column), F.concat(F.lit("none "), F.xxhash64(*plain).cast("string"))))
        items = by.join(one, (by["__by"] == one[f"__{name}"]) & by[column].isNotNull(), "left").drop("__by", f"__{name}")
    return items


def pair_assessed(items: DataFrame, records: DataFrame) -> DataFrame:
    """``items`` (doi, title, pmid, pmid_other, pdf_verified) with classification, source, proposed and reason.

    Exactly one of the two candidates must own the DOI, none may have exclusions and the owner's title must be the item's; a verified
    file only raises the class.
    """
    j = looked_up(items, records, r1="pmid", r2="pmid_other")
    doi, title = T.doi("doi"), title_key(F.col("title"))
    owns = lambda r: F.coalesce(F.array_contains(F.transform(r["dois"], lambda x: T.doi(x)), doi), F.lit(False))
    same = F.col("pmid").eqNullSafe(F.col("pmid_other"))
    o1, o2 = owns(F.col("r1")), owns(F.col("r2")) & ~same
    gone = F.col("pmid").isNull() | F.col("pmid_other").isNull() | F.col("r1").isNull() | F.col("r2").isNull()
    odd = (F.size(exclusions(F.col("r1"))) > 0) | (F.size(exclusions(F.col("r2"))) > 0)
    n = o1.cast("int") + o2.cast("int")
    won = F.when(o1, F.col("r1")).otherwise(F.col("r2"))
    why = first_reason((doi.isNull() | (title == ""), "missing_usable_catalogue_doi_or_title"), (gone, "candidate_identifier_or_pubmed_record_missing"), (odd, "publication_or_identity_requires_review"), (n > 1, "both_candidates_claim_doi"), (n == 0, "no_candidate_claims_doi"), (title_key(won["title"]) != title, "winning_doi_title_disagreement"))
    out = j.withColumn("reason", F.coalesce(why, F.lit("unique_own_doi_and_coherent_title")))
    ok = F.col("reason") == "unique_own_doi_and_coherent_title"
    return out.select(*items.columns, F.when(ok, F.when(F.coalesce("pdf_verified", F.lit(False)), "pdf_confirmed").otherwise("metadata_confirmed")).otherwise("review_required").alias("classification"), F.when(ok, F.when(o1, "catalogue").otherwise("other")).alias("source"), F.when(ok, won["pmid"]).alias("proposed"), "reason")


def conversion_holds(c: Column, doi: Column) -> Column:
    """Whether a converter's answer (status, doi, requested_doi, pmid, pmcid) is for this DOI and has an id."""
    d = T.doi(doi)
    return F.coalesce((c["status"] == "ok") & (T.doi(c["doi"]) == d) & (T.doi(c["requested_doi"]) == d) & c["pmcid"].rlike("^PMC[0-9]+$"), F.lit(False))


def review_decisions(items: DataFrame) -> DataFrame:
    """id, issue, decision for each issue of an item that was joined to its authorities.

    ``items``: id, issues (array), doi, pmid, pmid_other, pmcid, pmcid_other, title, other_title, authors, other_authors, journal, other_journal,
    assessed and proposed (of ``pair_assessed``, null if it was not asked), r1 and r2 (records of ``looked_up``), conversion (struct or null), work
    (struct of doi, id, ambiguous, refs, n_authors, or null), work_id, n_authors, and pdf (struct of sha256_matches, doi_present, title_present, candidates).
    """
    has = lambda issue: F.array_contains("issues", issue)
    doi, c, pdf, w = T.doi("doi"), F.col("conversion"), F.col("pdf"), F.col("work")
    ok = F.coalesce((c["status"] == "ok") & (T.doi(c["doi"]) == doi), F.lit(False))
    owns = lambda r: F.coalesce(F.array_contains(F.transform(r["dois"], lambda x: T.doi(x)), doi), F.lit(False))
    own = F.array_distinct(F.array_compact(F.array(*[F.when(owns(F.col(r)), F.col(r)["pmid"]) for r in ("r1", "r2")])))
    own_pmc = F.array_distinct(F.array_compact(F.array(*[F.when(owns(F.col(r)), F.nullif(F.col(r)["pmcid"], F.lit(""))) for r in ("r1", "r2")])))
    disputed = ok & ((c["pmid"].isNotNull() & (F.size(own) > 0) & ((F.size(own) != 1) | ~F.array_contains(own, c["pmid"]))) | ((F.size(own_pmc) > 0) & ((F.size(own_pmc) != 1) | ~F.coalesce(F.array_contains(own_pmc, c["pmcid"]), F.lit(False)))))
    clash = ok & F.col("proposed").isNotNull() & c["pmid"].isNotNull() & (c["pmid"] != F.col("proposed"))
    unresolved = F.coalesce(F.col("assessed") == "review_required", F.lit(False))
    # A first page that names another DOI holds both identifiers back.
    elsewhere = doi.isNotNull() & F.coalesce(pdf["sha256_matches"] & ~pdf["doi_present"] & (F.size(pdf["candidates"]) > 0), F.lit(False))
    tail = lambda x: F.upper(F.regexp_extract(F.regexp_replace(F.coalesce(F.col(x), F.lit("")), "/+$", ""), "[^/]*$", 0))
    listed = (tail("pmcid") == c["pmcid"]) | (tail("pmcid_other") == c["pmcid"])
    held = lambda d: F.when(elsewhere, "pdf_identity_conflict").when(disputed, "authority_conflict").when(unresolved, "review_required").otherwise(d)
    pmid = held(F.when(clash, "authority_conflict").otherwise(F.coalesce("assessed", F.lit("lookup_unavailable"))))
    pmcid = held(F.when(ok, F.when(clash, "authority_conflict").when(F.coalesce(listed, F.lit(False)), "metadata_confirmed").otherwise("authority_conflict")).when(c.isNull(), "lookup_unavailable").when(c["status"] == "mismatch", "authority_conflict").otherwise("not_returned"))
    candidate = F.coalesce(pdf["sha256_matches"] & pdf["title_present"] & (F.size(pdf["candidates"]) == 1) & T.doi(F.try_element_at(pdf["candidates"], F.lit(1))).isNotNull(), F.lit(False))
    printed = F.when(candidate, "pdf_doi_candidate").otherwise("review_required")
    variant = lambda same: F.when(F.coalesce(same, F.lit(False)), "format_variant").otherwise("review_required")
    numbers = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
    plain_title = lambda x: T.content(reduce(lambda t, k: F.regexp_replace(t, rf"\b{numbers[k]}\b", str(k + 1)), range(10), F.lower(F.coalesce(F.col(x), F.lit("")))))
    plain_author = lambda x: T.content(F.regexp_replace(F.split(F.coalesce(F.col(x), F.lit("")), r",|;|\bet al\b", 2)[0], "[0-9*†‡]+", ""))
    plain_journal = lambda x: T.content(F.regexp_replace(F.coalesce(F.col(x), F.lit("")), r"(?i)^the\s+", ""))
    same_work = F.coalesce(~w["ambiguous"] & (T.doi(w["doi"]) == doi) & (w["id"] == F.col("work_id")), F.lit(False))
    work = lambda d: F.when(w.isNull(), "lookup_unavailable").when(~same_work, "identity_conflict").otherwise(d)
    refs = F.when((F.size(w["refs"]) > 0) & F.forall(w["refs"], lambda x: F.coalesce(x.rlike("^W[0-9]+$"), F.lit(False))), "supplement_available").otherwise("still_missing")
    cap = F.when(w["n_authors"] >= 100, "expanded_upstream_cap_possible").when(w["n_authors"] > 30, "supplement_available").otherwise("no_expansion")
    decisions = {
        "pmid_disagreement": pmid, "pmcid_disagreement": pmcid, "doi_missing": printed, "doi_invalid": printed, "duplicate_stem_doi": F.lit("review_required"), "year_difference_over_one": F.lit("review_required"),
        "title_disagreement": variant(plain_title("title") == plain_title("other_title")), "authors_disagreement": variant(plain_author("authors") == plain_author("other_authors")),
        "journal_disagreement": variant(plain_journal("journal") == plain_journal("other_journal")), "missing_references": work(refs), "authors_at_cap": work(cap), "missing_pmcid": F.lit("allowed_empty"),
    }
    each = F.array(*[F.struct(F.lit(k).alias("issue"), d.alias("decision")) for k, d in decisions.items()])
    known = F.filter(each, lambda x: F.array_contains("issues", x["issue"]))
    other = F.transform(F.array_except("issues", strings(decisions)), lambda i: F.struct(i.alias("issue"), F.lit("lookup_unavailable").alias("decision")))
    return items.select("id", F.explode(F.concat(known, other)).alias("d")).select("id", "d.issue", "d.decision")


def proposals(items: DataFrame) -> DataFrame:
    """id, holds, pmcid_decision, pmcid_proposal, pmcid_reasons, year_decision, year_proposal, year_reasons of reviewed items.

    ``items``: id, issues, doi, title, pmcid, year, other_year, conflicts (whether a decision of the review is a conflict), pmid_decision, conversion,
    pdf, and candidates (records, or nulls, of the distinct pmids of the item and its conversion).  A PMC id is proposed where the converter
    says another than the stored one, a year where the difference is more than one, and only while no reason is left to hold it back.
    """
    c, pdf, doi = F.col("conversion"), F.col("pdf"), T.doi("doi")
    conv = conversion_holds(c, F.col("doi"))
    has = lambda issue: F.array_contains("issues", issue)
    disagrees = has("pmid_disagreement") | F.col("pmid_decision").isNotNull()
    holds = reasons(
        (F.col("conflicts"), "original_identity_or_authority_conflict"),
        (disagrees & ~F.coalesce(F.col("pmid_decision").isin("metadata_confirmed", "pdf_confirmed"), F.lit(False)), "original_pmid_unresolved"),
        (~pdf["sha256_matches"], "original_pdf_hash_mismatch"),
        (pdf["sha256_matches"] & ~pdf["doi_present"] & (F.size(pdf["candidates"]) > 0) & doi.isNotNull(), "original_pdf_doi_conflict"),
        ((c["status"] == "mismatch") | ((c["status"] == "ok") & ~conv), "original_pmc_identity_conflict"),
    )
    verified = F.coalesce(pdf["sha256_matches"] & pdf["doi_present"] & pdf["title_present"], F.lit(False))
    stored = F.regexp_replace(F.upper(F.regexp_extract(F.regexp_replace(F.trim("pmcid"), "/+$", ""), "[^/]*$", 0)), r"^PMCID:\s*", "")
    differs = (F.coalesce(F.col("pmcid"), F.lit("")) != "") & conv & (stored != c["pmcid"])
    cand, title = F.col("candidates"), title_key(F.col("title"))
    owners = F.filter(cand, lambda r: F.array_contains(F.transform(r["dois"], lambda x: T.doi(x)), doi))
    one = F.try_element_at(owners, F.lit(1))
    identity = first_reason(
        (doi.isNull() | (title == ""), "original_doi_or_title_missing"),
        (F.exists(cand, lambda r: r.isNull()), "cached_pubmed_candidate_missing"),
        (F.exists(cand, lambda r: F.size(exclusions(r)) > 0), "pubmed_publication_or_identity_requires_review"),
        (F.size(owners) != 1, "pubmed_doi_identity_not_unique"),
        (title_key(one["title"]) != title, "pubmed_title_disagrees"),
        (conv & c["pmid"].isNotNull() & (c["pmid"] != one["pmid"]), "pubmed_pmc_pmid_conflict"),
        (conv & (F.coalesce(one["pmcid"], F.lit("")) != "") & (one["pmcid"] != c["pmcid"]), "pubmed_pmc_pmcid_conflict"),
    )
    out = items.select("id", "year", "other_year", "conversion", holds.alias("holds"), differs.alias("differs"), verified.alias("verified"), F.array_compact(F.array(identity)).alias("identity"), F.when(identity.isNull(), one).alias("record"), has("year_difference_over_one").alias("late"))
    base = F.concat("holds", "identity")
    pmc = F.concat(base, reasons((F.col("conversion")["pmid"].isNull(), "converter_pmid_missing")))
    years = F.coalesce(F.array_distinct(F.flatten(F.transform(F.col("record")["dates"], lambda d: T.years(d)))), F.array().cast("array<int>"))
    far = F.coalesce(F.abs(F.col("year") - F.col("other_year")) > 1, F.lit(False))
    late = F.concat(base, reasons((F.size(years) != 1, "publication_year_missing_or_ambiguous"), ((F.size(years) == 1) & ~F.coalesce(F.array_contains(years, F.col("other_year")), F.lit(False)), "pubmed_publication_year_disagrees_with_openalex"), (~far, "original_large_year_difference_not_established")))
    fine_pmc, fine_year = F.col("differs") & (F.size(pmc) == 0), F.col("late") & (F.size(late) == 0)
    decision = lambda asked, fine, confirmed: F.when(asked, F.when(fine, confirmed).otherwise("review_required"))
    return out.select(
        "id", "holds", decision(F.col("differs"), fine_pmc, F.when(F.col("verified"), "pdf_confirmed").otherwise("metadata_confirmed")).alias("pmcid_decision"), F.when(fine_pmc, F.col("conversion")["pmcid"]).alias("pmcid_proposal"), F.when(F.col("differs"), pmc).alias("pmcid_reasons"),
        decision(F.col("late"), fine_year, F.lit("metadata_confirmed")).alias("year_decision"), F.when(fine_year, F.col("other_year")).alias("year_proposal"), F.when(F.col("late"), late).alias("year_reasons"),
    )


# Rounds


def walked(pointers: DataFrame, budget: int, after: tuple[str, str] | None = None) -> DataFrame:
    """The first ``budget`` pointers (day, sk) in order after a cursor, with ``last``: whether there are none after them.

    One more than the budget is read, as a top-k, to know whether the walk is over.
    """
    rest = pointers if after is None else pointers.where((F.col("day") > after[0]) | ((F.col("day") == after[0]) & (F.col("sk") > after[1])))
    top = rest.orderBy("day", "sk").limit(budget + 1)
    order = Window.orderBy("day", "sk")  # budget + 1 rows
    return top.select("*", F.row_number().over(order).alias("nth"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("n")).where(F.col("nth") <= budget).select(*pointers.columns, (F.col("n") <= budget).alias("last"))


#: Counters of a round.
COUNTERS = ("valid_verdicts", "passed", "offers", "accepted", "declined", "unanswered", "expired", "unavailable", "skipped", "executions", "rejected_budget")


def round_counts(pointers: DataFrame, jobs: DataFrame, verdicts: DataFrame, offers: DataFrame, candidates: DataFrame, cutoff: float, now: Column) -> DataFrame:
    """One row: COUNTERS, jobs_seen, missing_jobs, unprocessed (ids for the next round, in order), complete, cursor_day, cursor_sk.

    ``pointers``: walked (day, sk, job_id, last); ``jobs``: job_id, status, triage; ``verdicts``: job_id, status, p; ``offers``: job_id, status,
    expires, execution; ``candidates``: execution.  Each job has one verdict at most and any number of offers, which are counted before they join.
    """
    j = pointers.join(jobs.select("job_id", F.col("status").alias("job_status"), "triage", F.lit(1).alias("seen")), "job_id", "left").join(verdicts.select("job_id", F.col("status").alias("v_status"), "p", F.lit(1).alias("v")), "job_id", "left")
    seen = F.col("seen").isNotNull()
    valid, unjudged = F.col("p").isNotNull(), F.col("v").isNull()
    pending = ~valid & unjudged & F.coalesce(F.col("triage") == "pending", F.lit(False))
    unavailable = ~valid & ~pending & (F.coalesce(F.col("v_status") == "unavailable", F.lit(False)) | (unjudged & F.coalesce(F.col("triage") == "unavailable", F.lit(False))))
    n = lambda c: F.count_if(seen & c)
    # At most the walk's budget of ids is gathered.
    main = j.agg(
        n(valid).alias("valid_verdicts"), n(F.col("p") >= cutoff).alias("passed"), n(unavailable).alias("unavailable"), n(~valid & ~pending & ~unavailable).alias("skipped"), n(F.col("job_status") == "rejected_budget").alias("rejected_budget"),
        n(F.lit(True)).alias("jobs_seen"), F.count_if(~seen).alias("missing_jobs"), F.transform(F.array_sort(F.collect_list(F.when(seen & pending, F.struct("day", "sk", "job_id")))), lambda x: x["job_id"]).alias("unprocessed"),
        F.coalesce(F.bool_and("last"), F.lit(True)).alias("complete"), F.max(F.struct("day", "sk")).alias("at"),
    )
    o = offers.join(j.where(seen).select("job_id"), "job_id")
    late = F.coalesce(F.col("expires") <= now, F.lit(False))
    is_ = lambda s: F.col("status") == s
    of = o.agg(F.count(F.lit(1)).alias("offers"), F.count_if(is_("accepted")).alias("accepted"), F.count_if(is_("declined")).alias("declined"), F.count_if(is_("expired") | (is_("offered") & late)).alias("expired"), F.count_if(is_("offered") & ~late).alias("unanswered"))
    runs = o.select("execution").union(candidates.select("execution")).where("execution is not null").agg(F.count_distinct("execution").alias("executions"))
    # Three tables of one row each.
    whole = main.join(F.broadcast(of)).join(F.broadcast(runs))
    return whole.select(*COUNTERS, "jobs_seen", "missing_jobs", "unprocessed", "complete", F.when(~F.col("complete"), F.col("at.day")).alias("cursor_day"), F.when(~F.col("complete"), F.col("at.sk")).alias("cursor_sk"))
