"""Review queries: page structure, gates, replies, edits, identifier adjudication, proposals, and rounds over the log of questions.

Documents are pages and drafts, parts are works with authority records, the event log is the log of questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators import review as R
from folioscope.plans.registry import query
from folioscope.sources.tables import SQL_JOBS, jobs, load


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# Pages


FOLDER = "case doc_id % 7 when 0 then 'sources' when 1 then 'overviews' when 2 then 'overviews' when 3 then 'concepts' when 4 then 'questions' when 5 then 'papers' else 'projects' end"
KIND = "case doc_id % 14 when 1 then 'concept' when 2 then 'subtopic' when 8 then 'category' end"
#: A page holds some of the headings of some schema, by its id, before its whole text.
HEADS = "array_join(transform(filter(sequence(1, size(schema)), i -> (doc_id + i) % 5 > 0), i -> '## ' || schema[i - 1] || chr(10) || 'words' || chr(10)), '')"
SQL_HEADS = "array_to_string(list_transform(list_filter(range(1, len(schema) + 1), lambda i: (doc_id + i) % 5 > 0), lambda i: '## ' || schema[i] || chr(10) || 'words' || chr(10)), '')"
SCHEMAS = [R.SOURCE, R.LONG_SOURCE, R.PAPER, R.OVERVIEW, R.QUESTION, R.CONCEPT, R.SUBTOPIC, R.CATEGORY, R.OTHER]
SQL_PAGES = f"s as (select doc_id, text, {FOLDER} as folder, {KIND} as kind, ([{', '.join(map(sql_list, SCHEMAS))}])[doc_id // 7 % 9 + 1] as schema from documents where text is not null), pg as (select doc_id, folder, kind, {SQL_HEADS} || text as text from s)"


def wiki_pages(spark, sf) -> DataFrame:
    schemas = F.array(*[R.strings(x) for x in SCHEMAS])
    d = load(spark, sf, "documents").where("text is not null").select("doc_id", "text", F.expr(FOLDER).alias("folder"), F.expr(KIND).alias("kind"), F.element_at(schemas, F.expr("cast(doc_id div 7 % 9 + 1 as int)")).alias("schema"))
    return d.select("doc_id", "folder", "kind", F.concat(F.expr(HEADS), "text").alias("text"))


def sql_missing(schema) -> str:
    return f"list_filter({sql_list('## ' + h for h in schema)}, lambda h: not contains(text, h))"


SQL_ERRORS = f"""{SQL_PAGES}, e as (select *, list_transform(case folder when 'sources' then case when len({sql_missing(R.SOURCE)}) <= len({sql_missing(R.LONG_SOURCE)}) then {sql_missing(R.SOURCE)} else {sql_missing(R.LONG_SOURCE)} end
 when 'overviews' then case kind when 'concept' then {sql_missing(R.CONCEPT)} when 'subtopic' then {sql_missing(R.SUBTOPIC)} when 'category' then {sql_missing(R.CATEGORY)} else {sql_missing(R.OVERVIEW)} end
 when 'concepts' then {sql_missing(R.CONCEPT)} when 'questions' then {sql_missing(R.QUESTION)} when 'papers' then {sql_missing(R.PAPER)} else {sql_missing(R.OTHER)} end, lambda h: 'missing ' || h) as errors from pg)"""


@query("c11_page_structure", f"with {SQL_ERRORS} select doc_id, folder, array_to_string(errors, '; ') as errors from e")
def c11(spark, sf):
    """The required headings that each page lacks, by its folder and kind."""
    p = wiki_pages(spark, sf)
    return p.select("doc_id", "folder", F.array_join(R.page_errors(F.col("folder"), F.col("kind"), F.col("text")), "; ").alias("errors"))


DRAFT_TEXT = "case when doc_id % 4 = 0 then ' ' else '' end || case when doc_id % 5 = 0 then 'Intro --- ' else '' end || '## Citation' || case when doc_id % 6 = 0 then ' of' else '' end || chr(10) || text || chr(10) || '## Methods' || chr(10) || 'm' || chr(10) || '## Results' || chr(10) || 'P ## 0.01' || chr(10) || case when doc_id % 7 = 0 then '' else '## Limitations' || chr(10) end || '## Evidence boundary' || chr(10) || case when doc_id % 8 = 0 then 'TODO' else 'x' end || chr(10) || '## Related pages' || chr(10) || case when doc_id % 9 = 0 then '## More' else '' end"
SQL_PROBLEMS = f"""list_concat(list_transform({sql_missing(R.DRAFT)}, lambda h: 'missing section ' || h), list_filter([case when len(regexp_extract_all(text, '(?m)^## ')) <> 6 then 'unexpected number of level-2 sections' end,
 case when not starts_with(ltrim(text, ' ' || chr(9) || chr(10) || chr(13)), '## Citation') then 'note must start with ## Citation' when not regexp_matches(text, '(?m)^## Citation[ \\t]*$') then '## Citation must be a heading on its own line' end,
 case when contains(string_split(text, '## Citation')[1], '---') then 'frontmatter must not be model-written' end, case when regexp_matches(text, '(?i)\\b(TODO|TBD|lorem ipsum|as an AI|placeholder)\\b') then 'placeholder or filler text present' end,
 case when length(text) < 1500 then 'note is too short to be a full evidence note' end], lambda x: x is not null))"""


@query("c11_note_sections", f"with d as (select doc_id, {DRAFT_TEXT} as text from documents where text is not null) select doc_id, array_to_string({SQL_PROBLEMS}, '; ') as problems from d")
def c11_notes(spark, sf):
    """What is wrong with notes that must have exactly six sections."""
    d = load(spark, sf, "documents").where("text is not null").select("doc_id", F.expr(DRAFT_TEXT).alias("text"))
    return d.select("doc_id", F.array_join(R.section_problems(F.col("text")), "; ").alias("problems"))


FOLDERS = ["sources", "overviews", "concepts", "questions", "papers", "projects", "drafts"]


@query("e27_validation_sweep", f"""with {SQL_ERRORS}, x as (select folder, 'p' || doc_id as key, unnest(errors) as error, generate_subscripts(errors, 1) as pos from e), r as (select *, row_number() over (partition by folder order by key, pos) as nth from x),
l as (select folder, string_agg(key || ': ' || error, '; ' order by nth) as listing from r where nth <= 5 group by 1), n as (select folder, count(*) as checked, sum(len(errors))::bigint as errors from e group by 1)
select f as folder, coalesce(checked, 0) as checked, case when checked is null then 1 else errors end as errors, case when checked is null then 'no pages were checked' else coalesce(listing, '') end as listing from (select unnest({FOLDERS}) as f) left join n on n.folder = f left join l on l.folder = f""")
def e27(spark, sf):
    """Pages checked, errors and the first of them by folder; an error where nothing was checked."""
    p = wiki_pages(spark, sf)
    errors = R.page_errors(F.col("folder"), F.col("kind"), F.col("text"))
    return R.sweep(p.select("folder", F.concat(F.lit("p"), "doc_id").alias("key"), errors.alias("errors")), "folder", "errors", FOLDERS)


#: Drafts and their catalogue rows, field by field.
DRAFT = {"work_id": "case when doc_id % 23 = 0 then 'other' else 'w' || doc_id end", "draft_status": "case when doc_id % 19 = 0 then 'failed' else 'model_draft' end", "draft_problems": "case when doc_id % 17 = 0 then 'short' else '' end", "review_status": "case when doc_id % 29 <> 0 then 'unreviewed' end", "pdf_sha256": "case when doc_id % 31 = 0 then '' else 'p' || doc_id end", "grobid_sha256": "'g' || doc_id", "ingest_model": "case when doc_id % 37 = 0 then '' else 'm' end", "ingest_harness": "'h'"}
ITEM = {"work_id": "'w' || doc_id", "ingest_status": "case when doc_id % 11 = 0 then 'reviewed' else 'model_draft' end", "review_status": "case when doc_id % 13 = 0 then 'reviewed' end", "draft_sha256": "case when doc_id % 21 = 0 then null when doc_id % 10 = 3 then 'x' else {sha} end", "pdf_sha256": "case when doc_id % 25 = 1 then 'q' else 'p' || doc_id end", "grobid_sha256": "case when doc_id % 26 = 1 then 'q' else 'g' || doc_id end"}


@query("c17_promotion_gate", f"""with d as (select doc_id, {DRAFT_TEXT} as text from documents where text is not null), x as (select doc_id, {', '.join(f'{v} as d_{k}' for k, v in DRAFT.items())}, {', '.join(f"{v.format(sha='sha256(text)')} as i_{k}" for k, v in ITEM.items())}, len({SQL_PROBLEMS}) as n_problems, sha256(text) as hash from d)
select doc_id, case when d_work_id <> i_work_id then 'draft is for another work' when d_draft_status <> 'model_draft' then 'only model_draft can be promoted' when d_draft_problems <> '' then 'draft recorded validator problems' when d_review_status is distinct from 'unreviewed' then 'draft is not unreviewed'
 when d_pdf_sha256 = '' then 'draft lacks pdf_sha256' when d_grobid_sha256 = '' then 'draft lacks grobid_sha256' when d_ingest_model = '' then 'draft lacks ingest_model' when d_ingest_harness = '' then 'draft lacks ingest_harness' when n_problems > 0 then 'draft body fails the check'
 when i_ingest_status <> 'model_draft' then 'catalogue is not at model_draft' when i_review_status <> 'unreviewed' then 'catalogue is already reviewed' when i_draft_sha256 is null then 'catalogue has no draft hash' when i_pdf_sha256 <> d_pdf_sha256 then 'pdf_sha256 differs from the catalogue' when i_grobid_sha256 <> d_grobid_sha256 then 'grobid_sha256 differs from the catalogue'
 when hash <> i_draft_sha256 and doc_id % 2 = 0 then 'draft differs from the recorded one' end as refusal from x""")
def c17(spark, sf):
    """All must hold; the first that doesn't is why a draft isn't promoted."""
    d = load(spark, sf, "documents").where("text is not null").select("doc_id", F.expr(DRAFT_TEXT).alias("text"))
    own, item = {k: F.expr(v) for k, v in DRAFT.items()}, {k: F.expr(v.format(sha="sha2(text, 256)")) for k, v in ITEM.items()}
    return d.select("doc_id", R.promotion_refusal(own, item, F.col("text"), F.sha2("text", 256), F.col("doc_id") % 2 == 1).alias("refusal"))


LICENCES = ["cc-by", "cc0", "public-domain", "", "publisher-specific", "CC-BY"]


@query("c18_ingest_gate", f"with w as (select p_partkey, case when p_size % 7 > 0 then p_size > 5 end as oa, ({sql_list(LICENCES)})[p_partkey % 6 + 1] as lic, case when p_brand like '%5' then null else 'u' || p_partkey end as pdf, case when p_brand like '%7' then '' else 'x' end as txt, case when p_type = 'SMALL' then 'exclude' when p_type = 'LARGE' then null else 'include' end as verdict from part) select p_partkey, case when oa is not true then 'not open access' when not (starts_with(lic, 'cc-') or lic in ('cc0', 'public-domain')) then 'no supported licence' when pdf is null or txt = '' then 'needs both content URLs' when verdict is distinct from 'include' then 'journal is not allow-listed' end as refusal from w")
def c18(spark, sf):
    p = load(spark, sf, "part")
    licence = F.element_at(R.strings(LICENCES), (F.col("p_partkey") % 6 + 1).cast("int"))
    pdf, text = F.when(~F.col("p_brand").endswith("5"), F.concat(F.lit("u"), "p_partkey")), F.when(F.col("p_brand").endswith("7"), "").otherwise("x")
    verdict = F.when(F.col("p_type") == "SMALL", "exclude").when(F.col("p_type") != "LARGE", "include")
    return p.select("p_partkey", R.ingest_refusal(F.when(F.col("p_size") % 7 > 0, F.col("p_size") > 5), licence, pdf, text, verdict).alias("refusal"))


SEARCHES = [("all terms", {"query": "Auto high", "most": 50}), ("years", {"query": "f", "most": 40, "from_year": 1994, "to_year": 1997, "oa_only": True}), ("tag", {"query": "", "most": 30, "tag": "5", "fulltext_only": True}), ("verdicts", {"query": "low", "most": 60, "verdicts": ("BUILDING", "MACHINERY"), "corpus": "c1"})]
SQL_CATALOGUE = "cat as (select o_orderkey as id, lower(c_mktsegment || ' ' || o_orderpriority || ' ' || o_orderstatus) as search_text, year(o_orderdate)::int as year, o_totalprice as cited, string_split(o_orderpriority, '-') as tags, o_totalprice > 100000 as oa, o_orderkey % 3 = 0 as fulltext, c_mktsegment as verdict, case when c_nationkey % 4 > 0 then 'c' || (c_nationkey % 4) end as corpus, case when o_orderkey % 10 = 0 then o_orderkey + 1 end as superseded_by from orders join customer on c_custkey = o_custkey)"
SQL_WHERES = ["corpus is not null and contains(search_text, 'auto') and contains(search_text, 'high')", "corpus is not null and contains(search_text, 'f') and year between 1994 and 1997 and oa", "corpus is not null and list_contains(tags, '5') and fulltext", "corpus = 'c1' and contains(search_text, 'low') and verdict in ('BUILDING', 'MACHINERY')"]


@query("c01_catalogue_search", f"with {SQL_CATALOGUE}, " + ", ".join(f"s{k} as (select '{n}' as search, id, year, cited from cat where superseded_by is null and {w} order by cited desc, year desc, id desc limit {a['most']})" for k, ((n, a), w) in enumerate(zip(SEARCHES, SQL_WHERES))) + " " + " union all ".join(f"select * from s{k}" for k in range(len(SEARCHES))))
def c01(spark, sf):
    """Searches of the catalogue's metadata with terms and filters, most cited first."""
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    cat = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("id"), F.lower(F.concat_ws(" ", "c_mktsegment", "o_orderpriority", "o_orderstatus")).alias("search_text"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("cited"), F.split("o_orderpriority", "-").alias("tags"), (F.col("o_totalprice") > 100000).alias("oa"),
        (F.col("o_orderkey") % 3 == 0).alias("fulltext"), F.col("c_mktsegment").alias("verdict"), F.expr("case when c_nationkey % 4 > 0 then 'c' || (c_nationkey % 4) end").alias("corpus"), F.expr("case when o_orderkey % 10 = 0 then o_orderkey + 1 end").alias("superseded_by"),
    )
    found = [R.search_catalogue(cat, **a).select(F.lit(n).alias("search"), "id", "year", "cited") for n, a in SEARCHES]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


# Replies and edits


#: A reply to each conversation: a line for each turn, some of them not as asked.
LINE = "case (conv_id + turn) % 7 when 0 then turn || ' no mark genomics' when 1 then turn || '. genomics' when 2 then ' ' || turn || ' :  unknown-label' when 3 then turn || ': methods ' when 4 then (turn + 40) || ': methods' when 5 then turn || ': methods' || chr(10) || turn || ': genomics' else turn || ': new-field' end"
LABELS = ["genomics", "methods", "new-field"]


@query("c23_decoded_lines", f"with r as (select conv_id, string_agg({LINE}, chr(10) order by turn) as text from conversations group by 1), l as (select conv_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from r), p as (select conv_id, pos, regexp_extract(line, '^\\s*([0-9]+)\\s*[:.]\\s*([a-z0-9-]+)\\s*$', 1) as n, regexp_extract(line, '^\\s*([0-9]+)\\s*[:.]\\s*([a-z0-9-]+)\\s*$', 2) as label from l), d as (select conv_id, n::int as turn, arg_max(label, pos) as label from p where label in {tuple(LABELS)} group by all) select c.conv_id, c.turn, d.label from conversations c left join d on d.conv_id = c.conv_id and d.turn = c.turn")
def c23_lines(spark, sf):
    """Labels that replies give to the numbered lines of their batch."""
    c = load(spark, sf, "conversations").select("conv_id", "turn", F.expr(LINE).alias("line"))
    r = c.groupBy(F.col("conv_id").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("text"))
    found = R.decoded_lines(r, c.select(F.col("conv_id").alias("key"), F.col("turn").cast("int").alias("number"), F.col("turn").alias("id")), LABELS)
    return found.select(F.col("key").alias("conv_id"), F.col("id").alias("turn"), "label")


PAIR = "'\"t' || (turn + case when conv_id % 5 = 1 and turn = 1 then 50 else 0 end) || '\": ' || case when conv_id % 5 = 2 and turn = 0 then '7' when conv_id % 5 = 3 and turn = 0 then '\"elsewhere\"' else '\"target-a\"' end"
REPLY = "case when conv_id % 11 = 0 then 'no object' when conv_id % 13 = 0 then '{\"assignments\": [1]}' else '{\"assignments\": {' || pairs || '}}' end"


@query("c23_reply_coverage", f"with r as (select conv_id, string_agg({PAIR}, ', ' order by turn) filter (conv_id % 5 <> 4 or turn > 0) as pairs, count(*) as turns from conversations group by 1), m as (select *, conv_id % 11 <> 0 and conv_id % 13 <> 0 as object from r) select conv_id, case when not object or pairs is null and false then 'the response must be an object' when (conv_id % 5 = 1 and turns > 1) or conv_id % 5 = 4 then 'every supplied id exactly once, and no others' when conv_id % 5 in (2, 3) then 'unknown or non-string target' end as problem, case when object and not ((conv_id % 5 = 1 and turns > 1) or conv_id % 5 in (2, 3, 4)) then turns else 0 end as n from m")
def c23(spark, sf):
    """Whether a reply assigns every supplied id exactly once, to legal targets."""
    c = load(spark, sf, "conversations")
    pair = F.when(F.expr("conv_id % 5 <> 4 or turn > 0"), F.struct("turn", F.expr(PAIR).alias("p")))
    r = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["p"]), ", ").alias("pairs"))
    found = R.decoded_assignments(r.select(F.col("conv_id").alias("key"), F.expr(REPLY).alias("text")), c.select(F.col("conv_id").alias("key"), F.concat(F.lit("t"), "turn").alias("id")), ["target-a", "other"])
    return found.withColumnRenamed("key", "conv_id")


EDIT = """case p_partkey % 10 when 0 then '{"exclude": ["' || replace(p_name, ' ', '-') || '"]}' when 1 then '{"exclude": "' || p_name || '"}' when 2 then '{"exclude": ["' || p_name || '"]}' when 3 then '{"merge": {"a-b": "' || replace(p_name, ' ', '-') || '"}}' when 4 then '{"merge": {"a-b": 7}}' when 5 then '{"title": {"a": "' || p_name || '"}}'
 when 6 then '{"title": {"a": " "}}' when 7 then '[1]' when 8 then '{"exclude": [], "merge": {}, "title": {}, "other": 1}' else '{"title": {"A b": "x"}}' end"""


@query("c24_overrides", f"with e as (select p_partkey, {EDIT} as content from part) select p_partkey, case when json_type(content) <> 'OBJECT' then 'content must be an object' when json_exists(content, '$.exclude') and (json_type(content, '$.exclude') <> 'ARRAY' or not coalesce(regexp_full_match(content->>'$.exclude[0]', '[a-z0-9]+(-[a-z0-9]+)*'), json_array_length(content, '$.exclude') = 0)) then 'exclude' when p_partkey % 10 = 4 then 'merge' when p_partkey % 10 in (6, 9) then 'title' end as problem from e")
def c24_overrides(spark, sf):
    """What is wrong with the shape of edits to a manifest."""
    return load(spark, sf, "part").select("p_partkey", R.overrides_problem(F.expr(EDIT)).alias("problem"))


@query("c24_year_range", "with n as (select source, doc_id, case when doc_id % 6 = 0 then 'n.d.' else (1990 + doc_id % 30)::varchar end as year from documents), a as (select source, doc_id from n where doc_id % 31 <> 0 union all select source, doc_id from n where doc_id % 37 = 0 union all select source, -doc_id from n where doc_id % 41 = 1), t as (select source, doc_id, count(*) as times from a group by all), p as (select coalesce(t.source, n.source) as source, count(*) filter (t.doc_id is null) as unassigned, count(*) filter (n.doc_id is null) as unknown, count(*) filter (times > 1) as twice from t full join n on n.source = t.source and n.doc_id = t.doc_id group by 1) select source, count(*) as notes, coalesce(min(year) filter (regexp_full_match(year, '[0-9]+')), '') as first, coalesce(max(year) filter (regexp_full_match(year, '[0-9]+')), '') as last, any_value(unassigned) as unassigned, any_value(unknown) as unknown, any_value(twice) as twice from n join p using (source) group by source")
def c24(spark, sf):
    """A partition held against the ready notes of its category, and the range of their digit-only years."""
    n = load(spark, sf, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 6 == 0, "n.d.").otherwise((1990 + F.col("doc_id") % 30).cast("string")).alias("year"))
    k = n.select("source", "doc_id")
    a = k.where("doc_id % 31 <> 0").union(k.where("doc_id % 37 = 0")).union(k.where("doc_id % 41 = 1").select("source", -F.col("doc_id")))
    t = a.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    year = F.when(F.col("year").rlike("^[0-9]+$"), F.col("year"))
    j = t.join(n.withColumn("ready", F.lit(1)), ["source", "doc_id"], "full_outer")
    return j.groupBy("source").agg(F.count("ready").alias("notes"), F.coalesce(F.min(year), F.lit("")).alias("first"), F.coalesce(F.max(year), F.lit("")).alias("last"), F.count_if(F.col("times").isNull()).alias("unassigned"), F.count_if(F.col("ready").isNull()).alias("unknown"), F.count_if(F.col("times") > 1).alias("twice"))


# Works and authorities: parts, each with a record of its own key


WORK = {
    "doi": "case when k % 29 = 0 then null else 'https://doi.org/10.5555/P' || k end", "title": "case when k % 31 = 0 then '' else 'On ' || name || ': Study ' || k end",
    "pmid": "case when k % 11 > 0 then '' || k end", "pmid_other": "case k % 5 when 0 then '' || k when 1 then '' || (k + 1) when 2 then '' || (k + 2) else '' || greatest(0, k - 1) end",
    "pdf_verified": "case when k % 3 > 0 then k % 3 = 1 end",
}
RECORD = {
    "pmid": "'' || k", "title": "case when k % 19 = 0 then 'Correction: on ' || name when k % 14 = 0 then 'Another title' else upper('On ' || name) || ' study, ' || k || '.' end", "record_type": "case when k % 13 = 0 then 'book' else 'article' end",
    "pmcid": "case when k % 4 = 0 then '' else 'PMC' || k end",
}
LISTS = {"dois": ["case when k % 4 < 2 then '10.5555/p' || k end", "case when k % 4 = 1 then '10.5555/p' || (k - 1) end", "case when k % 4 = 2 then '10.5555/p' || (k - 2) end"], "types": ["'Journal Article'", "case when k % 17 = 0 then 'Published Erratum' end"], "relations": ["case when k % 37 = 0 then 'RetractionIn' end"], "errors": ["case when k % 41 = 0 then 'duplicate' end"], "dates": ["case when k % 7 > 0 then (1990 + size_) || ' Jan' end", "case when k % 9 = 0 then (1991 + size_) || ' Spring' end"]}
SQL_WORKS = "pt as (select p_partkey as k, p_name as name, p_size as size_ from part), wk as (select k, " + ", ".join(f"{v} as {n}" for n, v in WORK.items()) + " from pt), rc as (select k, " + ", ".join(f"{v} as {n}" for n, v in RECORD.items()) + ", " + ", ".join(f"list_filter([{', '.join(v)}], lambda x: x is not null) as {n}" for n, v in LISTS.items()) + " from pt)"
SQL_KEY = "array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' ')"
SQL_DOI = "regexp_replace(lower({0}), '^https?://doi.org/', '')"
SQL_ODD = "({0}.record_type <> 'article' or regexp_matches(lower(array_to_string({0}.types, ' ')), 'erratum|correction|retract|book') or regexp_matches(lower({0}.title), '^correction') or len({0}.relations) > 0 or len({0}.errors) > 0)"
SQL_ASSESSED = f"""{SQL_WORKS}, jn as (select w.*, {SQL_DOI.format('w.doi')} as d, {SQL_KEY.format('w.title')} as tk, a.k as ak, b.k as bk, coalesce(list_contains(a.dois, {SQL_DOI.format('w.doi')}), false) as o1, coalesce(list_contains(b.dois, {SQL_DOI.format('w.doi')}), false) and w.pmid is distinct from w.pmid_other as o2, {SQL_ODD.format('a')} as x1, {SQL_ODD.format('b')} as x2, a.title as t1, b.title as t2 from wk w left join rc a on a.pmid = w.pmid left join rc b on b.pmid = w.pmid_other),
asd as (select *, case when d is null or tk = '' then 'missing_usable_catalogue_doi_or_title' when ak is null or bk is null then 'candidate_identifier_or_pubmed_record_missing' when x1 or x2 then 'publication_or_identity_requires_review' when o1 and o2 then 'both_candidates_claim_doi' when not o1 and not o2 then 'no_candidate_claims_doi' when {SQL_KEY.format('case when o1 then t1 else t2 end')} <> tk then 'winning_doi_title_disagreement' else 'unique_own_doi_and_coherent_title' end as reason from jn),
pa as (select k, case when reason like 'unique%' then case when pdf_verified then 'pdf_confirmed' else 'metadata_confirmed' end else 'review_required' end as classification, case when reason like 'unique%' then case when o1 then 'catalogue' else 'other' end end as source, case when reason like 'unique%' then case when o1 then pmid else pmid_other end end as proposed, reason from asd)"""


def works(spark, sf) -> DataFrame:
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("size_"))
    return p.select("k", "name", "size_", *[F.expr(v).alias(n) for n, v in WORK.items()])


def authority(spark, sf) -> DataFrame:
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_size").alias("size_"))
    return p.select(*[F.expr(v).alias(n) for n, v in RECORD.items()], *[F.array_compact(F.array(*[F.expr(x).cast("string") for x in v])).alias(n) for n, v in LISTS.items()])


@query("d20_pair_adjudication", f"with {SQL_ASSESSED} select * from pa")
def d20(spark, sf):
    """Of two candidate identifiers exactly one must own the DOI under a coherent title."""
    return R.pair_assessed(works(spark, sf).drop("name", "size_"), authority(spark, sf)).select("k", "classification", "source", "proposed", "reason")


ISSUES = ["pmid_disagreement", "pmcid_disagreement", "doi_missing", "duplicate_stem_doi", "year_difference_over_one", "title_disagreement", "authors_disagreement", "journal_disagreement", "missing_references", "authors_at_cap", "missing_pmcid", "unknown_issue"]
ITEM_FIELDS = {
    "pmcid": "case when k % 6 = 0 then null when k % 6 < 3 then 'https://x.org/PMC' || k else 'pmc' || (k + 1) || '/' end", "pmcid_other": "case when k % 8 = 0 then 'PMC' || k else 'PMC1' end",
    "other_title": "case when k % 3 = 0 then 'ON ' || name || '--study ' || k when k % 3 = 1 then 'Study one of ' || name else 'x' end", "own_title": "case when k % 3 = 1 then 'Study 1 of ' || name else title end",
    "authors": "'O''Neil' || (k % 3) || '*, B'", "other_authors": "'O Neil et al'", "journal": "'The Journal of ' || name", "other_journal": "case when k % 2 = 0 then 'journal of ' || name else 'J ' || name end", "work_id": "'W' || k",
    "c_status": "case k % 9 when 0 then null when 1 then 'mismatch' when 2 then 'error' else 'ok' end", "c_doi": "case when k % 10 = 3 then '10.5555/zz' else '10.5555/p' || k end", "c_pmid": "case when k % 4 = 0 then null when k % 16 = 5 then '99' else '' || k end", "c_pmcid": "case when k % 12 = 7 then 'PMC99' else 'PMC' || k end",
    "w_there": "k % 7 > 0", "w_doi": "case when k % 15 = 4 then '10.5555/other' else '10.5555/p' || k end", "w_id": "'W' || (k + case when k % 21 = 5 then 1 else 0 end)", "w_ambiguous": "k % 25 = 6", "w_authors": "k % 130",
    "f_sha": "case when k % 5 > 0 then k % 5 > 1 end", "f_doi": "k % 4 = 0", "f_title": "k % 3 = 0", "f_n": "k % 3", "year": "1990 + size_", "other_year": "1990 + size_ + k % 4",
}
SQL_ITEMS = f"""{SQL_ASSESSED}, it as (select w.*, {', '.join(f'{v} as {n}' for n, v in ITEM_FIELDS.items())}, list_filter({sql_list(ISSUES)}, lambda i: (length(i) + w.k) % 3 > 0) as issues, case when (length('pmid_disagreement') + w.k) % 3 > 0 then pa.classification end as assessed, case when (length('pmid_disagreement') + w.k) % 3 > 0 then pa.proposed end as proposed, {SQL_DOI.format('w.doi')} as d from wk w join pt using (k) join pa using (k)),
au as (select it.*, a.pmid as ap, b.pmid as bp, list_contains(a.dois, d) as ao, list_contains(b.dois, d) as bo, nullif(a.pmcid, '') as apc, nullif(b.pmcid, '') as bpc from it left join rc a on a.pmid = it.pmid left join rc b on b.pmid = it.pmid_other),
fx as (select *, coalesce(c_status = 'ok' and c_doi = d, false) as ok, list_distinct(list_filter([case when ao then ap end, case when bo then bp end], lambda x: x is not null)) as own, list_distinct(list_filter([case when ao then apc end, case when bo then bpc end], lambda x: x is not null)) as ownpc, d is not null and coalesce(f_sha and not f_doi and f_n > 0, false) as elsewhere, [upper(regexp_extract(rtrim(coalesce(pmcid, ''), '/'), '[^/]*$')), pmcid_other] as listed from au),
gx as (select *, ok and ((c_pmid is not null and len(own) > 0 and own <> [c_pmid]) or (len(ownpc) > 0 and ownpc <> [c_pmcid])) as disputed, coalesce(ok and proposed is not null and c_pmid <> proposed, false) as clash, coalesce(w_there and not w_ambiguous and w_doi = d and w_id = work_id, false) as same_work from fx),
dx as (select *, unnest(issues) as issue from gx),
dec as (select k, issue, case when issue in ('pmid_disagreement', 'pmcid_disagreement') and elsewhere then 'pdf_identity_conflict' when issue in ('pmid_disagreement', 'pmcid_disagreement') and disputed then 'authority_conflict' when issue in ('pmid_disagreement', 'pmcid_disagreement') and assessed = 'review_required' then 'review_required'
 when issue = 'pmid_disagreement' then case when clash then 'authority_conflict' else assessed end
 when issue = 'pmcid_disagreement' then case when ok then case when clash then 'authority_conflict' when list_contains(listed, c_pmcid) then 'metadata_confirmed' else 'authority_conflict' end when c_status is null then 'lookup_unavailable' when c_status = 'mismatch' then 'authority_conflict' else 'not_returned' end
 when issue = 'doi_missing' then case when coalesce(f_sha and f_title and f_n = 1, false) then 'pdf_doi_candidate' else 'review_required' end when issue in ('duplicate_stem_doi', 'year_difference_over_one') then 'review_required'
 when issue = 'title_disagreement' then case when k % 3 = 1 or (k % 3 = 0 and title <> '') then 'format_variant' else 'review_required' end when issue = 'authors_disagreement' then 'format_variant' when issue = 'journal_disagreement' then case when k % 2 = 0 then 'format_variant' else 'review_required' end
 when issue in ('missing_references', 'authors_at_cap') and not w_there then 'lookup_unavailable' when issue in ('missing_references', 'authors_at_cap') and not same_work then 'identity_conflict' when issue = 'missing_references' then case when k % 4 = 0 then 'still_missing' when k % 4 = 1 then 'still_missing' else 'supplement_available' end
 when issue = 'authors_at_cap' then case when w_authors >= 100 then 'expanded_upstream_cap_possible' when w_authors > 30 then 'supplement_available' else 'no_expansion' end when issue = 'missing_pmcid' then 'allowed_empty' else 'lookup_unavailable' end as decision from dx)"""


def review_items(spark, sf) -> DataFrame:
    """Works with their issues, assessments, authorities, conversions and files."""
    r = authority(spark, sf)
    w = R.pair_assessed(works(spark, sf), r).selectExpr("*", *[f"{v} as {n}" for n, v in ITEM_FIELDS.items()])
    asked = F.expr("(length('pmid_disagreement') + k) % 3 > 0")
    issues = F.filter(R.strings(ISSUES), lambda i: (F.length(i) + F.col("k")) % 3 > 0)
    refs = F.when(F.col("k") % 4 == 0, F.array().cast("array<string>")).when(F.col("k") % 4 == 1, F.array(F.lit("W1"), F.lit("bad"))).otherwise(F.array(F.lit("W1"), F.lit("W2")))
    candidates = F.slice(F.array(F.concat(F.lit("10.5555/p"), "k"), F.lit("10.5555/q")), 1, F.col("f_n"))
    conversion = F.when(F.col("c_status").isNotNull(), F.struct(F.col("c_status").alias("status"), F.col("c_doi").alias("doi"), F.concat(F.lit("10.5555/p"), "k").alias("requested_doi"), F.col("c_pmid").alias("pmid"), F.col("c_pmcid").alias("pmcid")))
    work = F.when(F.col("w_there"), F.struct(F.col("w_doi").alias("doi"), F.col("w_id").alias("id"), F.col("w_ambiguous").alias("ambiguous"), refs.alias("refs"), F.col("w_authors").alias("n_authors")))
    pdf = F.struct(F.col("f_sha").alias("sha256_matches"), F.col("f_doi").alias("doi_present"), F.col("f_title").alias("title_present"), candidates.alias("candidates"))
    out = w.select("k", "doi", "title", "own_title", "other_title", "pmid", "pmid_other", "pmcid", "pmcid_other", "authors", "other_authors", "journal", "other_journal", "work_id", "year", "other_year", F.when(asked, F.col("classification")).alias("assessed"), F.when(asked, F.col("proposed")).alias("proposed"), issues.alias("issues"), conversion.alias("conversion"), work.alias("work"), pdf.alias("pdf"))
    return out


@query("d09_review_decisions", f"with {SQL_ITEMS} select k as id, issue, decision from dec")
def d09(spark, sf):
    """A decision for each issue of each item, from its authorities, its conversion and its file."""
    i = R.looked_up(review_items(spark, sf), authority(spark, sf), r1="pmid", r2="pmid_other")
    return R.review_decisions(i.withColumn("title", F.col("own_title")).withColumnRenamed("k", "id"))


SQL_PROPOSED = f"""{SQL_ITEMS}, cf as (select k, bool_or(contains(decision, 'conflict')) as conflicts, max(decision) filter (issue = 'pmid_disagreement') as pmid_decision from dec group by 1),
base as (select it.*, cf.conflicts, cf.pmid_decision, coalesce(c_status = 'ok' and c_doi = d, false) as conv, list_contains(it.issues, 'year_difference_over_one') as late_case from it left join cf using (k)),
cs as (select k, conv, unnest(list_distinct(list_filter([pmid, pmid_other, case when conv then c_pmid end], lambda x: x is not null))) as pm from base),
co as (select cs.k, count(*) filter (rc.k is null) as gone, count(*) filter ({SQL_ODD.format('rc')}) as odd, list(rc.k order by rc.k) filter (list_contains(rc.dois, b.d)) as owners from cs join base b using (k) left join rc on rc.pmid = cs.pm group by 1),
id0 as (select b.*, coalesce(gone, 0) as gone, coalesce(odd, 0) as odd, coalesce(owners, []) as owners, r.title as rt, r.pmid as rp, r.pmcid as rpc, r.dates from base b left join co using (k) left join rc r on len(co.owners) = 1 and r.k = co.owners[1]),
idn as (select *, case when d is null or title = '' then 'original_doi_or_title_missing' when gone > 0 then 'cached_pubmed_candidate_missing' when odd > 0 then 'pubmed_publication_or_identity_requires_review' when len(owners) <> 1 then 'pubmed_doi_identity_not_unique' when {SQL_KEY.format('rt')} <> {SQL_KEY.format('title')} then 'pubmed_title_disagrees' when conv and c_pmid <> rp then 'pubmed_pmc_pmid_conflict' when conv and rpc <> '' and rpc <> c_pmcid then 'pubmed_pmc_pmcid_conflict' end as ident from id0),
hl as (select *, list_filter([case when conflicts then 'original_identity_or_authority_conflict' end, case when (list_contains(issues, 'pmid_disagreement') or pmid_decision is not null) and coalesce(pmid_decision not in ('metadata_confirmed', 'pdf_confirmed'), true) then 'original_pmid_unresolved' end, case when not f_sha then 'original_pdf_hash_mismatch' end,
 case when f_sha and not f_doi and f_n > 0 and d is not null then 'original_pdf_doi_conflict' end, case when c_status = 'mismatch' or (c_status = 'ok' and not conv) then 'original_pmc_identity_conflict' end], lambda x: x is not null) as holds, coalesce(pmcid is not null and conv and upper(regexp_extract(rtrim(pmcid, '/'), '[^/]*$')) <> c_pmcid, false) as differs, coalesce(f_sha and f_doi and f_title, false) as verified,
 case when ident is null then list_sort(list_distinct(list_transform(dates, lambda x: left(x, 4)::int))) else [] end as years from idn),
rs as (select *, list_concat(holds, list_filter([ident], lambda x: x is not null)) as basis from hl),
fin as (select *, list_concat(basis, list_filter([case when c_pmid is null then 'converter_pmid_missing' end], lambda x: x is not null)) as pr, list_concat(basis, list_filter([case when len(years) <> 1 then 'publication_year_missing_or_ambiguous' when years[1] <> other_year then 'pubmed_publication_year_disagrees_with_openalex' end, case when abs(year - other_year) <= 1 then 'original_large_year_difference_not_established' end], lambda x: x is not null)) as yr from rs)"""


@query("d21_proposals_with_holds", f"""with {SQL_PROPOSED} select k as id, array_to_string(holds, ',') as holds, case when differs then case when len(pr) > 0 then 'review_required' when verified then 'pdf_confirmed' else 'metadata_confirmed' end end as pmcid_decision, case when differs and len(pr) = 0 then c_pmcid end as pmcid_proposal, case when differs then array_to_string(pr, ',') end as pmcid_reasons,
 case when late_case then case when len(yr) > 0 then 'review_required' else 'metadata_confirmed' end end as year_decision, case when late_case and len(yr) = 0 then other_year end as year_proposal, case when late_case then array_to_string(yr, ',') end as year_reasons from fin""")
def d21(spark, sf):
    """What is proposed for an item's PMC id and year, and what holds it back."""
    r = authority(spark, sf)
    items = review_items(spark, sf)
    told = R.review_decisions(R.looked_up(items, r, r1="pmid", r2="pmid_other").withColumn("title", F.col("own_title")).withColumnRenamed("k", "id"))
    sums = told.groupBy(F.col("id").alias("k")).agg(F.bool_or(F.contains("decision", F.lit("conflict"))).alias("conflicts"), F.max(F.when(F.col("issue") == "pmid_disagreement", F.col("decision"))).alias("pmid_decision"))
    conv = R.conversion_holds(F.col("conversion"), F.col("doi"))
    i = items.join(sums, "k", "left").withColumn("c_pmid", F.when(conv, F.col("conversion")["pmid"]))
    i = R.looked_up(i, r, r1="pmid", r2="pmid_other", r3="c_pmid")
    # A record for each distinct candidate; null where there is none under its key.
    asked = F.array(*[F.struct(F.col(p).alias("pmid"), F.col(x).alias("r")) for p, x in (("pmid", "r1"), ("pmid_other", "r2"), ("c_pmid", "r3"))])
    first = F.filter(asked, lambda a, n: a["pmid"].isNotNull() & (F.array_position(F.transform(asked, lambda b: b["pmid"]), a["pmid"]) == n + 1))
    i = i.withColumn("candidates", F.transform(first, lambda a: a["r"])).withColumn("conflicts", F.coalesce("conflicts", F.lit(False))).withColumnRenamed("k", "id")
    p = R.proposals(i)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return p.select("id", joined("holds"), "pmcid_decision", "pmcid_proposal", joined("pmcid_reasons"), "year_decision", "year_proposal", joined("year_reasons"))


# The log of questions


NOW = "2024-01-25"
FROM, TO, BUDGET, CUTOFF = "2024-01-05", "2024-01-19", 2000, 0.6
LOG = {"status": "case when job_id % 19 = 0 then 'rejected_budget' else 'answered' end", "triage": "case tokens % 4 when 0 then 'pending' when 1 then 'unavailable' else 'done' end", "v_status": "case when tokens % 9 = 0 then 'unavailable' else 'ok' end", "p": "case when tokens % 3 = 0 then tokens / 100.0 end", "o_status": "case seq % 5 when 0 then 'accepted' when 1 then 'declined' when 2 then 'expired' else 'offered' end", "execution": "case when seq % 3 = 0 then 'x' || (job_id % 50) end"}
SQL_LOG = f"""{SQL_JOBS}, ptr as (select strftime(moment, '%Y-%m-%d') as day, strftime(moment, '%H:%M:%S') || '#' || lpad(job_id::varchar, 9, '0') as sk, job_id from jobs where kind <> 'view'), win as (select * from ptr where day between '{FROM}' and '{TO}'), wk as (select *, row_number() over (order by day, sk) as nth, count(*) over () as n from win), walked as (select * from wk where nth <= {BUDGET}),
jb as (select job_id, {LOG['status']} as status, {LOG['triage']} as triage from jobs where job_id % 23 <> 0), vd as (select job_id, {LOG['v_status']} as status, {LOG['p']} as p from jobs where tokens % 5 <> 0), of0 as (select job_id, moment, unnest(range(0, job_id % 3)) as seq from jobs), offs as (select job_id, {LOG['o_status']} as status, moment + to_days(10 + seq::int) as expires, {LOG['execution']} as execution from of0), cand as (select 'c' || tokens as execution from jobs where tokens % 10 = 0 and strftime(moment, '%Y-%m-%d') between '{FROM}' and '{TO}')"""


def log(spark, sf) -> tuple[DataFrame, ...]:
    """Pointers, jobs, verdicts, offers and candidates of the event log."""
    j = jobs(spark, sf)
    day = F.date_format("moment", "yyyy-MM-dd")
    pointers = j.where("kind <> 'view'").select(day.alias("day"), F.concat(F.date_format("moment", "HH:mm:ss"), F.lit("#"), F.lpad(F.col("job_id").cast("string"), 9, "0")).alias("sk"), "job_id")
    js = j.where("job_id % 23 <> 0").selectExpr("job_id", f"{LOG['status']} as status", f"{LOG['triage']} as triage")
    verdicts = j.where("tokens % 5 <> 0").selectExpr("job_id", f"{LOG['v_status']} as status", f"{LOG['p']} as p")
    offers = j.where("job_id % 3 > 0").select("job_id", "moment", F.explode(F.sequence(F.lit(0), F.expr("cast(job_id % 3 as int)") - 1)).alias("seq")).selectExpr("job_id", f"{LOG['o_status']} as status", "moment + make_dt_interval(10 + seq, 0, 0, 0) as expires", f"{LOG['execution']} as execution")
    candidates = j.where("tokens % 10 = 0").where(day.between(FROM, TO)).select(F.concat(F.lit("c"), "tokens").alias("execution"))
    return pointers, js, verdicts, offers, candidates


@query("e18_round_counts", f"""with {SQL_LOG}, j as (select w.*, jb.job_id as seen, jb.status, jb.triage, vd.job_id as v, vd.status as vs, vd.p from walked w left join jb using (job_id) left join vd using (job_id)), s as (select *, case when seen is null then 'missing' when p is not null then 'valid' when v is null and triage = 'pending' then 'pending' when vs = 'unavailable' or (v is null and triage = 'unavailable') then 'unavailable' else 'skipped' end as state from j),
o as (select offs.* from offs join s on s.job_id = offs.job_id and s.state <> 'missing'), x as (select execution from o union select execution from cand)
select (select count(*) from s where state = 'valid') as valid_verdicts, (select count(*) from s where state = 'valid' and p >= {CUTOFF}) as passed, (select count(*) from o) as offers, (select count(*) from o where status = 'accepted') as accepted, (select count(*) from o where status = 'declined') as declined,
 (select count(*) from o where status = 'offered' and expires > timestamp '{NOW}') as unanswered, (select count(*) from o where status = 'expired' or (status = 'offered' and expires <= timestamp '{NOW}')) as expired, (select count(*) from s where state = 'unavailable') as unavailable, (select count(*) from s where state = 'skipped') as skipped, (select count(execution) from x) as executions, (select count(*) from s where state <> 'missing' and status = 'rejected_budget') as rejected_budget,
 (select count(*) from s where state <> 'missing') as jobs_seen, (select count(*) from s where state = 'missing') as missing_jobs, (select coalesce(md5(string_agg(job_id::varchar, ',' order by nth)), md5('')) from s where state = 'pending') as unprocessed, (select coalesce(any_value(n), 0) <= {BUDGET} from s) as complete, (select max(day) from s where n > {BUDGET}) as cursor_day, (select arg_max(sk, nth) from s where n > {BUDGET}) as cursor_sk""")
def e18(spark, sf):
    """One round over a window of days: its counters, what it leaves to the next one, and where its budget ended."""
    pointers, js, verdicts, offers, candidates = log(spark, sf)
    w = R.walked(pointers.where(F.col("day").between(FROM, TO)), BUDGET)
    r = R.round_counts(w, js, verdicts, offers, candidates, CUTOFF, F.expr(f"timestamp_ntz '{NOW}'"))
    return r.withColumn("unprocessed", F.md5(F.array_join(F.transform("unprocessed", lambda i: i.cast("string")), ",").cast("binary")))


@query("j09_record_walk", f"with {SQL_LOG}, a as (select *, row_number() over (order by day, sk) as place from win where day > '2024-01-08' or (day = '2024-01-08' and sk > '12:00:00')), t as (select *, count(*) over () as total from a) select day, sk, job_id, total <= 500 as last from t where place <= 500")
def j09(spark, sf):
    """A bounded walk over days in order that goes on after a cursor, and whether it came to the end."""
    return R.walked(log(spark, sf)[0].where(F.col("day").between(FROM, TO)), 500, ("2024-01-08", "12:00:00"))


@query("e17_confusion", f"with {SQL_JOBS}, c as (select job_id, case when kind = 'view' then 'insufficient_retrieval' when tokens % 2 = 0 then 'answer_only' when tokens % 3 > 0 then 'review_candidate' end as label, case when job_id % 4 > 0 then case when tokens % 5 < 3 then 'answer_only' else 'review_candidate' end end as choice, job_id % 7 > 0 as ok, seconds from jobs), s as (select * from c where choice is not null and ok), t as (select * from s where label <> 'insufficient_retrieval') select 'pair' as part, label || '->' || choice as name, count(*)::double as value from t group by 2 union all select 'total', 'scored', count(*) from t union all select 'total', 'agreement', count(*) filter (label = choice) from t union all select 'total', 'always answer_only', count(*) filter (label = 'answer_only') from t union all select 'total', 'always review_candidate', count(*) filter (label = 'review_candidate') from t union all select 'total', 'median seconds', round(median(seconds), 6) from s")
def e17(spark, sf):
    """Labels against choices over scored rows, with agreement, what constant answers would reach, and the median latency of all that succeeded."""
    c = jobs(spark, sf).selectExpr("job_id", "case when kind = 'view' then 'insufficient_retrieval' when tokens % 2 = 0 then 'answer_only' when tokens % 3 > 0 then 'review_candidate' end as label", "case when job_id % 4 > 0 then case when tokens % 5 < 3 then 'answer_only' else 'review_candidate' end end as choice", "job_id % 7 > 0 as ok", "seconds")
    s = c.where("choice is not null and ok")
    t = s.where("label <> 'insufficient_retrieval'")
    pairs = t.groupBy(F.concat("label", F.lit("->"), "choice").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("pair").alias("part"), "name", "value")
    n = lambda cond: F.count_if(cond).cast("double")
    totals = t.agg(F.count(F.lit(1)).cast("double").alias("scored"), n(F.col("label") == F.col("choice")).alias("agreement"), n(F.col("label") == "answer_only").alias("always answer_only"), n(F.col("label") == "review_candidate").alias("always review_candidate"))
    middle = s.agg(F.round(F.median("seconds"), 6).alias("median seconds"))
    one = totals.join(F.broadcast(middle))  # two tables of one row each
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("value")) for c in one.columns]))
    return pairs.unionByName(one.select(cells.alias("x")).select(F.lit("total").alias("part"), "x.name", "x.value"))
