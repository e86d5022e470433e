"""Reconciliation and review: coverage of two sources, duplicate identities, issue queues, proposals, linkage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import present
from folioscope.lineage import new_table
from folioscope.functions import text as T
from folioscope.operators import audit, folds
from folioscope.plans import identity as IP
from folioscope.plans.registry import query
from folioscope.sources.tables import load

#: Lines of an order as records with two sources: the line's own fields and those its order and part give.
SQL_REVIEW = "rev as (select l_orderkey * 10 + l_linenumber as id, l_returnflag as scope, year(l_shipdate)::int as y1, case when l_orderkey % 9 > 0 then year(o_orderdate)::int end as y2, case when l_partkey % 6 > 0 then l_suppkey % 7 end as v1, l_partkey % 7 as v2, case when l_quantity > 40 then '' else l_linestatus end as s1, o_orderstatus as s2 from lineitem join orders on o_orderkey = l_orderkey)"


def review(spark, sf) -> DataFrame:
    l, o = load(spark, sf, "lineitem"), load(spark, sf, "orders")  # noqa: E741
    j = l.join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("scope"), F.year("l_shipdate").alias("y1"), F.when(F.col("l_orderkey") % 9 > 0, F.year("o_orderdate")).alias("y2"), F.when(F.col("l_partkey") % 6 > 0, F.col("l_suppkey") % 7).alias("v1"), (F.col("l_partkey") % 7).alias("v2"), F.when(F.col("l_quantity") > 40, "").otherwise(F.col("l_linestatus")).alias("s1"), F.col("o_orderstatus").alias("s2"))


def coverage_matrix(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """For each pair of fields how often either side is there, and how often both agree: one pass, unpivoted."""
    cells = F.array(*[F.struct(F.lit(k).alias("field"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for k, (a, b) in pairs.items()])
    x = df.select(F.explode(cells).alias("x")).select("x.*")
    pa, pb = present("a"), present("b")
    return x.groupBy("field").agg(F.count_if(pa).alias("left_present"), F.count_if(pb).alias("right_present"), F.count_if(~F.coalesce(pa, F.lit(False)) & pb).alias("right_only"), F.count_if(pa & pb).alias("both"), F.count_if(pa & pb & (F.col("a") != F.col("b"))).alias("disagree"))


def issues(df: DataFrame, rules: list[tuple[str, int, Column]]) -> DataFrame:
    """issues (array in rule order) and priority (the least of theirs) for rows with any."""
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, _, cond in rules]))
    least = F.least(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(p)).otherwise(F.lit(99)) for _, p, cond in rules])
    return df.select("*", found.alias("issues"), least.alias("priority")).where(F.size("issues") > 0)


PAIRS = {"year": ("y1", "y2"), "venue": ("v1", "v2"), "status": ("s1", "s2")}


@query("e06_coverage_matrix", f"with {SQL_REVIEW}, x as (select 'year' as field, y1::varchar as a, y2::varchar as b from rev union all select 'venue', v1::varchar, v2::varchar from rev union all select 'status', s1, s2 from rev) select field, count(*) filter (a <> '') as left_present, count(*) filter (b <> '') as right_present, count(*) filter (coalesce(a, '') = '' and b <> '') as right_only, count(*) filter (a <> '' and b <> '') as both, count(*) filter (a <> '' and b <> '' and a <> b) as disagree from x group by field")
def e06(spark, sf):
    return coverage_matrix(review(spark, sf), PAIRS)


#: Lines as catalogue rows with both sources' values of nine fields, by expressions of either dialect.
def nine(sql: bool) -> dict[str, str]:
    arr = (lambda *x: f"[{', '.join(x)}]") if sql else (lambda *x: f"array({', '.join(x)})")
    line = "l_orderkey * 7 + l_linenumber"
    return {
        "title": "case when l_partkey % 9 > 0 then l_returnflag || ': T' || (l_partkey % 5) end", "openalex_title": "lower(l_returnflag) || ' t' || (l_partkey % 4)", "year": "case when l_suppkey % 8 > 0 then 1990 + l_linenumber end", "openalex_year": "1990 + l_partkey % 7",
        "authors": IP.pick(IP.LISTS, line, sql), "openalex_authors": IP.pick(IP.LISTS, f"{line} * 5 + l_suppkey", sql), "journal": "case when l_tax > 0.06 then '' else 'J. of ' || l_linestatus end", "openalex_venue": "'J of ' || case when l_partkey % 2 = 0 then 'O' else 'F' end",
        "type": "case when l_partkey % 3 = 0 then 'Article' end", "openalex_type": "case when l_partkey % 5 > 0 then 'article' else '?' end", "pmid": IP.pick(IP.PMIDS, line, sql), "pmid_openalex": IP.pick(IP.PMIDS, f"{line} + l_partkey", sql),
        "pmcid": "'PMC' || (l_partkey % 3)", "pmcid_openalex": "'pmcid:PMC' || (l_suppkey % 3)", "referenced_works": f"case when l_partkey % 4 = 0 then {arr(chr(39) + 'W1' + chr(39), chr(39) + 'bad' + chr(39))} when l_partkey % 4 = 1 then {arr(chr(39) + 'W2' + chr(39), chr(39) + 'W1' + chr(39))} end",
        "openalex_referenced_works": f"case when l_suppkey % 2 = 0 then {arr(chr(39) + 'https://x.org/W1' + chr(39), chr(39) + 'W2' + chr(39))} else {arr(chr(39) + 'W3' + chr(39))} end", "is_open_access": "case when l_tax > 0.04 then l_discount > 0.05 end", "openalex_is_oa": "l_discount > 0.03",
    }


def sql_form(field: str, c: str) -> str:
    if field == "authors":
        first = rf"trim(regexp_split_to_array(trim({c}), '\s*(;|,|\band\b|&|\bet\s+al\.?|·)\s*')[1])"
        surname = T.SQL_FOLD.format(rf"regexp_extract(trim(regexp_replace(' ' || {first}, '(\s+([A-Z]\.?-?){{1,4}})+$', '')), '\S+$')")
        surname = f"regexp_replace({surname}, '[^a-z0-9]+', '', 'g')"
        return rf"case when not regexp_matches({first}, '(?i)consortium|collaboration|group|committee|\[|\{{|\]') and length({surname}) > 1 then {surname} end"
    if field in ("pmid", "pmcid"):
        return f"upper(regexp_replace(regexp_extract(regexp_replace(trim({c}), '/+$', ''), '[^/]*$'), '(?i)^{field}:', ''))"
    if field == "references":
        ids = f"list_transform({c}, lambda v: regexp_replace(v, '^https?://[a-z.]+/', ''))"
        return f"case when len(list_filter({ids}, lambda v: not regexp_full_match(v, 'W[0-9]+'))) = 0 then array_to_string(list_sort(list_distinct({ids})), ',') end"
    return f"({c})::varchar" if field == "oa" else f"nullif(lower(regexp_replace(({c})::varchar, '[^A-Za-z0-9]+', '', 'g')), '')"


def sql_there(field: str, c: str) -> str:
    return f"coalesce(len({c}) > 0, false)" if field == "references" else f"{c} is not null" if field == "oa" else f"coalesce(({c})::varchar <> '', false)"


SQL_NINE = f"rows9 as (select (l_orderkey * 10 + l_linenumber)::varchar as work_id, {', '.join(f'{e} as {c}' for c, e in nine(True).items())} from lineitem)"
SQL_CELLS = " union all ".join(f"select work_id, '{f}' as field, {sql_there(f, a)} as own, {sql_there(f, b)} as other, {sql_form(f, a)} as x, {sql_form(f, b)} as y, {'abs(year - openalex_year)' if f == 'year' else 'null::int'} as gap from rows9" for f, (a, b) in audit.FIELDS.items())


@query("e06_nine_pairs", f"""with {SQL_NINE}, cells as ({SQL_CELLS}), c as (select *, own and other and x is not null and y is not null as compared, coalesce(own and other and x <> y, false) as differs from cells), s as (select *, row_number() over (partition by field order by work_id) as nth from c where differs)
select field, count(*) filter (own) as catalogue, count(*) filter (other) as openalex, count(*) filter (other and not own) as missing_present, count(*) filter (own and other) as both_present, count(*) filter (compared) as compared, count(*) filter (own and other and not compared) as incomparable, count(*) filter (differs) as differing,
 count(*) filter (differs and gap = 1) as one_year, count(*) filter (differs and gap > 1) as more_years, coalesce((select string_agg(work_id, ',' order by work_id) from s where s.field = c.field and nth <= 3), '') as samples from c group by field""")
def e06_nine(spark, sf):
    """Nine pairs of fields: what either source has, what can be compared, what differs, and the first three works that it does."""
    l = load(spark, sf, "lineitem")  # noqa: E741
    return audit.coverage(l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("work_id"), *[F.expr(e).alias(c) for c, e in nine(False).items()]))


@query("e06_year_differences", f"with {SQL_REVIEW} select case when y1 is null or y2 is null then 'incomparable' when y1 = y2 then '0' when abs(y1 - y2) = 1 then '1' else '2+' end as bucket, count(*) as n from rev group by 1")
def e06b(spark, sf):
    d = F.abs(F.col("y1") - F.col("y2"))
    return review(spark, sf).groupBy(F.when(d.isNull(), "incomparable").when(d == 0, "0").when(d == 1, "1").otherwise("2+").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("e07_duplicate_identities", "with r as (select c_custkey, c_mktsegment as scope, round(c_acctbal / 40)::bigint as identity from customer), g as (select identity, scope, count(*) as n from r group by all), h as (select identity, sum(n) as n, count(*) as scopes from g group by 1 having sum(n) >= 2) select case when identity < 0 then 'placeholder' else 'valid' end as class, count(*) as groups, sum(n)::bigint as rows, count(*) filter (scopes = 1) as same_scope, count(*) filter (scopes > 1) as cross_scope from h group by 1")
def e07(spark, sf):
    """Two levels of sums: by identity and scope, then by identity."""
    r = load(spark, sf, "customer").select(F.col("c_mktsegment").alias("scope"), F.round(F.col("c_acctbal") / 40).cast("bigint").alias("identity"))
    h = r.groupBy("identity", "scope").agg(F.count(F.lit(1)).alias("n")).groupBy("identity").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("scopes")).where("n >= 2")
    return h.groupBy(F.when(F.col("identity") < 0, "placeholder").otherwise("valid").alias("class")).agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"), F.count_if(F.col("scopes") == 1).alias("same_scope"), F.count_if(F.col("scopes") > 1).alias("cross_scope"))




def rules() -> list[tuple[str, int, Column]]:
    return [("year_differs", 1, F.col("y1") != F.col("y2")), ("no_year", 2, F.col("y2").isNull()), ("venue_differs", 3, F.col("v1") != F.col("v2")), ("no_status", 4, F.col("s1") == "")]


SQL_ISSUES = f"""{SQL_REVIEW}, q0 as (select *, list_filter([case when y1 <> y2 then 'year_differs' end, case when y2 is null then 'no_year' end, case when v1 <> v2 then 'venue_differs' end, case when s1 = '' then 'no_status' end], lambda x: x is not null) as issues from rev),
q as (select *, list_min(list_transform(issues, lambda x: case x when 'year_differs' then 1 when 'no_year' then 2 when 'venue_differs' then 3 else 4 end)) as priority from q0 where len(issues) > 0)"""


@query("e08_issue_queue", f"with {SQL_ISSUES} select id, array_to_string(issues, ',') as issues, priority, sha256(id || ':' || array_to_string(issues, ',')) as fingerprint from q")
def e08(spark, sf):
    q = issues(review(spark, sf), rules())
    text = F.array_join("issues", ",")
    return q.select("id", text.alias("issues"), "priority", F.sha2(F.concat(F.col("id").cast("string"), F.lit(":"), text), 256).alias("fingerprint"))


@query("e09_issue_samples", f"with {SQL_ISSUES}, x as (select id, unnest(issues) as issue from q), r as (select *, row_number() over (partition by issue order by id) as nth from x), d as (select unnest(['year_differs', 'no_year', 'venue_differs', 'no_status', 'unknown_key']) as issue) select d.issue, count(id) as n, coalesce(string_agg(id::varchar, ',' order by id) filter (nth <= 3), '') as samples from d left join r using (issue) group by 1")
def e09(spark, sf):
    """Every known issue with its count, zero included, and its first three rows."""
    x = issues(review(spark, sf), rules()).select("id", F.explode("issues").alias("issue"))
    n = x.groupBy("issue").agg(F.count("id").alias("n"))
    three = x.withColumn("nth", F.row_number().over(Window.partitionBy("issue").orderBy("id"))).where("nth <= 3").groupBy("issue").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("samples"))
    every = spark.createDataFrame([(r,) for r in ("year_differs", "no_year", "venue_differs", "no_status", "unknown_key")], "issue string")
    return every.join(n, "issue", "left").join(three, "issue", "left").select("issue", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("samples", F.lit("")).alias("samples"))


@query("e10_folded_batches", f"with {SQL_ISSUES} select id % 4 as batch, priority, count(*) as n, count(*) filter (y2 is not null and y1 <> y2) as changes from q group by all")
def e10(spark, sf):
    return issues(review(spark, sf), rules()).groupBy((F.col("id") % 4).alias("batch"), "priority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y1") != F.col("y2")).alias("changes"))


#: Orders as results of a review, in four batches.
RESULTS = """select cast(o_orderkey as {0}) as work_id, o_orderkey as item_index, o_orderkey % 4 as batch, o_orderkey % 5 <> 0 as checked, o_orderkey % 3 = 0 as hashed, o_orderkey % 2 = 0 as has_doi, o_orderkey % 7 <> 0 as has_title,
 case when o_orderkey % 11 = 0 then 'timeout' when o_orderkey % 13 = 0 then 'unreadable' end as error, case o_orderkey % 8 when 0 then 'not_returned' when 1 then 'review_required' end as recheck,
 case when o_orderkey % 9 > 0 then 'd' || (o_orderkey % 6) end as old_doi, 'd' || (o_orderkey % 9) as new_doi, cast(o_custkey % 3 as {0}) as old_year, cast(o_custkey % 2 as {0}) as new_year, o_orderkey % 10 = 0 as supplied, o_orderstatus as decision from orders"""


@query("e10_incremental_fold", f"""with r as ({RESULTS.format('varchar')}), c as (select 'papers' as counter, '' as key from r union all select 'pdf_checked', '' from r where checked union all select 'pdf_hash_verified', '' from r where hashed
 union all select 'pdf_identity_confirmed', '' from r where hashed and has_doi and has_title union all select 'pdf_error', error from r where error is not null union all select 'doi_recheck', recheck from r where recheck is not null
 union all select 'changed_proposal', 'doi' from r where old_doi is distinct from new_doi union all select 'changed_proposal', 'year' from r where old_year <> new_year union all select 'supplement', 'pmid' from r where supplied union all select 'decision', 'title:' || decision from r),
s as (select 'changed_proposal' as counter, 'doi' as key, item_index from r where old_doi is distinct from new_doi union all select 'changed_proposal', 'year', item_index from r where old_year <> new_year union all select 'decision', 'title:' || decision, item_index from r),
f as (select *, row_number() over (partition by counter, key order by item_index) as nth from s), t as (select counter, key, string_agg(item_index::varchar, ',' order by item_index) as samples from f where nth <= 3 group by all)
select counter, key, n, coalesce(samples, '') as samples from (select counter, key, count(*) as n from c group by all) left join t using (counter, key)""")
def e10_folded(spark, sf):
    """Counters and first samples of four batches that come one after another, in no order, one of them twice."""
    r = _results(spark, sf)
    root = new_table(spark)
    for batch in (2, 0, 3, 0, 1):
        folds.fold(r.where(F.col("batch") == batch), root, f"batch-{batch}")
    s = folds.state(spark, root)
    three = s["samples"].groupBy(F.col("kind").alias("c"), F.col("key").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("item_index")), lambda i: i.cast("string")), ",").alias("samples"))
    return s["counters"].join(three, (F.col("counter") == F.col("c")) & (F.col("key") == F.col("k")), "left").select("counter", "key", "n", F.coalesce("samples", F.lit("")).alias("samples"))


def _results(spark, sf):
    load(spark, sf, "orders").createOrReplaceTempView("orders")
    x = spark.sql(RESULTS.format("string"))
    pair = lambda doi, year: F.create_map(F.lit("doi"), F.col(doi), F.lit("year"), F.col(year))
    pdf = F.struct(F.col("checked"), F.col("hashed").alias("sha256_matches"), F.col("has_doi").alias("doi_present"), F.col("has_title").alias("title_present"), F.array_compact(F.array("error")).alias("errors"))
    return x.select("work_id", "item_index", "batch", pdf.alias("pdf"), "recheck", pair("old_doi", "old_year").alias("original"), pair("new_doi", "new_year").alias("proposals"), F.when(F.col("supplied"), F.array(F.lit("pmid"))).alias("supplements"), F.create_map(F.lit("title"), F.col("decision")).alias("decisions"))


@query("d05_reconciliation", "with c as (select o_orderkey as id, o_orderstatus as status, o_orderdate as updated from orders where o_orderkey % 8 > 0), i as (select l_orderkey as id, max(l_shipdate) as indexed from lineitem where l_orderkey % 5 > 0 group by 1), j as (select coalesce(c.id, i.id) as id, status, case when c.id is null then 'not_catalogued' when i.id is null and status = 'F' then 'missing' when i.id is null then 'waiting' when status <> 'F' then 'not_ready' when updated > indexed - interval 30 day then 'newer' else 'ok' end as state from c full join i on i.id = c.id) select state, count(*) as n, min(id) as first from j group by 1")
def d05(spark, sf):
    """Catalogue against index in one full join, each row in one state."""
    c = load(spark, sf, "orders").where("o_orderkey % 8 > 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated"), F.lit(1).alias("c"))
    i = load(spark, sf, "lineitem").where("l_orderkey % 5 > 0").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").alias("indexed"))
    state = F.when(F.col("c").isNull(), "not_catalogued").when(F.col("indexed").isNull() & (F.col("status") == "F"), "missing").when(F.col("indexed").isNull(), "waiting").when(F.col("status") != "F", "not_ready").when(F.expr("updated > indexed - interval 30 day"), "newer").otherwise("ok")
    return c.join(i, "id", "full_outer").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query("d06_category_drift", "with w as (select doc_id, case when doc_id % 10 = 3 then 'xx' else lang end as target from documents where doc_id % 7 > 0) select coalesce(w.target, '(missing)') as target, count(*) filter (w.doc_id is null) as missing, count(*) filter (w.target <> d.lang) as differ from documents d left join w using (doc_id) group by 1")
def d06(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "lang")
    w = d.where("doc_id % 7 > 0").select("doc_id", F.when(F.col("doc_id") % 10 == 3, "xx").otherwise(F.col("lang")).alias("target"))
    return d.join(w, "doc_id", "left").groupBy(F.coalesce("target", F.lit("(missing)")).alias("target")).agg(F.count_if(F.col("target").isNull()).alias("missing"), F.count_if(F.col("target") != F.col("lang")).alias("differ"))


@query("d07_batch_match", "with k as (select l_suppkey % 90 as key, count(distinct l_partkey % 5) as ids, min(l_partkey % 5) as one from lineitem where l_returnflag = 'R' group by 1) select s_suppkey, case when k.key is null then 'unmatched' when ids > 4 then 'ambiguous' when one <> s_suppkey % 5 then 'mismatch' else 'matched' end as state from supplier left join k on k.key = s_suppkey")
def d07(spark, sf):
    """A key that several records answer is ambiguous, one with the wrong id a mismatch."""
    k = load(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy((F.col("l_suppkey") % 90).alias("s_suppkey")).agg(F.count_distinct(F.col("l_partkey") % 5).alias("ids"), F.min(F.col("l_partkey") % 5).alias("one"))
    return load(spark, sf, "supplier").join(k, "s_suppkey", "left").select("s_suppkey", F.when(F.col("ids").isNull(), "unmatched").when(F.col("ids") > 4, "ambiguous").when(F.col("one") != F.col("s_suppkey") % 5, "mismatch").otherwise("matched").alias("state"))


@query("d10_record_view", "with v as (select doc_id, quality, toxic from labels), o as (select doc_id, max(turn) as turn from (select conv_id as doc_id, turn from conversations where role = 'assistant') group by 1) select d.doc_id, d.source, v.quality, o.turn as latest_offer from documents d left join v using (doc_id) left join o using (doc_id) where v.quality = 1 or v.doc_id is null")
def d10(spark, sf):
    """Records with their verdict, if any, and the latest offer; unscored rows are kept on request."""
    o = load(spark, sf, "conversations").where("role = 'assistant'").groupBy(F.col("conv_id").alias("doc_id")).agg(F.max("turn").alias("latest_offer"))
    j = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left").join(o, "doc_id", "left")
    return j.where("quality = 1 or quality is null").select("doc_id", "source", "quality", "latest_offer")


@query("d16_member_usage", "with s as (select user_id, round(sum(value) filter (event_type = 'purchase'), 2) as spent, round(sum(value) filter (event_type = 'view'), 2) as reserved, count(*) filter (event_type = 'click') as clicks, count(*) filter (event_type = 'error') as errors from events where ts < timestamp '2024-01-20' group by 1) select c_custkey as member, coalesce(spent, 0) as spent, coalesce(reserved, 0) as reserved, coalesce(clicks, 0) as clicks, coalesce(errors, 0) as errors from customer left join s on user_id = c_custkey")
def d16(spark, sf):
    """Every member with usage, those without any included."""
    of = lambda k: F.round(F.sum(F.when(F.col("event_type") == k, F.col("value"))), 2)
    s = load(spark, sf, "events").where("ts < timestamp_ntz '2024-01-20'").groupBy(F.col("user_id").alias("member")).agg(of("purchase").alias("spent"), of("view").alias("reserved"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("member")).join(s, "member", "left").fillna(0)
