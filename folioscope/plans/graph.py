"""Link graph, memberships and closures over pages, documents and the sales tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import graph as G
from folioscope.plans.registry import query
from folioscope.sources import commits
from folioscope.sources.tables import SQL_LINKS, SQL_NOTES, load, notes, page_links

#: Pages as documents: a page is the last part of its url's path in lower case, as the links name it.
SQL_PAGES = r"pg as (select page_id, '/' || lower(regexp_extract(url, '([^/]*)$', 1)) as page, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, 'g' || (page_id % 7) as category from pages)"


def pages(spark, sf):
    p = load(spark, sf, "pages")
    return p.select("page_id", F.concat(F.lit("/"), F.lower(F.regexp_extract("url", "([^/]*)$", 1))).alias("page"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.concat(F.lit("g"), F.col("page_id") % 7).alias("category"))


#: Citations between documents: each document cites the one half its id, and every third one the next.
SQL_CITES = "cites as (select distinct doc_id as source, doc_id // 2 as target from documents where doc_id > 0 union select doc_id, doc_id + 1 from documents where doc_id % 3 = 0)"


def cites(spark, sf):
    d = load(spark, sf, "documents")
    return d.where("doc_id > 0").select(F.col("doc_id").alias("source"), F.expr("doc_id div 2").alias("target")).union(d.where("doc_id % 3 = 0").select("doc_id", F.col("doc_id") + 1)).distinct()


@query("d02_backlinks", f"with {SQL_LINKS}, {SQL_PAGES} select distinct l.target, l.page_id as doc_id, p.title from links l join pg p using (page_id)")
def d02(spark, sf):
    return G.backlinks(page_links(spark, sf).withColumnRenamed("page_id", "doc_id"), pages(spark, sf).select(F.col("page_id").alias("doc_id"), "title"))


@query("d03_orphans", f"with {SQL_CITES}, {SQL_NOTES} select doc_id, title from notes where doc_id not in (select target from cites)")
def d03(spark, sf):
    return G.orphans(notes(spark, sf).select("doc_id", "title"), cites(spark, sf))


@query("d04_coverage", f"with {SQL_CITES}, {SQL_NOTES}, c as (select distinct target from cites where source % 2 = 1) select category, count(*) as notes, count(target) as connected, count(*) - count(target) as orphans, round(count(target) / count(*), 3) as ratio from notes left join c on doc_id = target group by category")
def d04(spark, sf):
    return G.coverage(notes(spark, sf).select("doc_id", "category"), cites(spark, sf).where("source % 2 = 1"), "category")


@query("d23_edge_report", f"with {SQL_CITES}, b as (select distinct target as source, source as target, true as r from cites) select c.source, c.target, d.doc_id is not null as present, coalesce(b.r, false) as reciprocal from cites c left join documents d on d.doc_id = c.target left join b on b.source = c.source and b.target = c.target")
def d23(spark, sf):
    return G.edge_report(cites(spark, sf), load(spark, sf, "documents").select(F.col("doc_id").alias("page")))


@query("g06_reciprocal_plan", "with o as (select distinct user_id as source, event_type as target from events where ts < timestamp '2024-01-04'), n as (select distinct user_id as source, event_type as target from events where ts >= timestamp '2024-01-27') select coalesce(o.source, n.source) as source, coalesce(o.target, n.target) as target, case when o.source is null then 'add' when n.source is null then 'remove' else 'keep' end as action from o full join n on o.source = n.source and o.target = n.target")
def g06(spark, sf):
    e = load(spark, sf, "events").select("ts", F.col("user_id").alias("source"), F.col("event_type").alias("target"))
    return G.reciprocal_plan(e.where("ts < timestamp_ntz '2024-01-04'"), e.where("ts >= timestamp_ntz '2024-01-27'"))


MERGES = "m as (select p_partkey as slug, case when p_partkey % 5 = 0 then p_partkey - 1 when p_partkey % 7 = 0 then p_partkey // 2 end as target from part), n as (select * from m where target is not null union all values (-1, -2), (-2, -3), (-3, -1), (-4, -1))"


@query("g02_merge_closure", f"with recursive {MERGES}, w as (select slug, target, 1 as d from n union all select w.slug, n.target, d + 1 from w join n on w.target = n.slug where d < 60) select slug, target from w where target not in (select slug from n)")
def g02(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("slug"), F.expr("case when p_partkey % 5 = 0 then p_partkey - 1 when p_partkey % 7 = 0 then p_partkey div 2 end").alias("target")).where("target is not null")
    cycle = spark.createDataFrame([(-1, -2), (-2, -3), (-3, -1), (-4, -1)], "slug long, target long")
    return G.merge_closure(p.union(cycle))


RECORDS = "c_custkey as id, 'n' || (c_custkey * 7 % 900) as work, case when c_custkey % 4 > 0 then 'd' || (c_custkey * 11 % 1200) end as doi"
SQL_GROUPS = f"rec as (select {RECORDS}, ['q' || (c_custkey % 13), 'q' || (c_custkey % 5)] as queries, [c_mktsegment] as scopes from customer), val as (select id, work as v from rec union select id, doi from rec where doi is not null), ed as (select distinct a.id as x, b.id as y from val a join val b using (v)), reach(id, other) as (select id, id from rec union select r.id, e.y from reach r join ed e on e.x = r.other), grp as (select id, min(other) as root from reach group by id)"


def catalogue_records(spark, sf):
    return load(spark, sf, "customer").selectExpr(*[x.strip() for x in ("c_custkey as id", "concat('n', c_custkey * 7 % 900) as work", "case when c_custkey % 4 > 0 then concat('d', c_custkey * 11 % 1200) end as doi", "array(concat('q', c_custkey % 13), concat('q', c_custkey % 5)) as queries", "array(c_mktsegment) as scopes")])


@query("g03_record_groups", f"with recursive {SQL_GROUPS} select id, root from grp")
def g03(spark, sf):
    """Records joined over either of two keys, however indirectly."""
    return G.record_groups(catalogue_records(spark, sf), "id", ["work", "doi"])


@query("g03_merged_records", f"with recursive {SQL_GROUPS}, q as (select distinct root, unnest(queries) as q from grp join rec using (id)), s as (select distinct root, unnest(scopes) as s from grp join rec using (id)), n as (select root, count(*) as records from grp group by 1) select n.root, records, (select string_agg(q, ',' order by q) from q where q.root = n.root) as queries, (select string_agg(s, ',' order by s) from s where s.root = n.root) as scopes from n")
def g03_merged(spark, sf):
    """Each group as one record, with the queries and scopes of all of its records."""
    m = G.merged_records(catalogue_records(spark, sf), "id", ["work", "doi"], ["queries", "scopes"])
    return m.select("root", "records", F.array_join("queries", ",").alias("queries"), F.array_join("scopes", ",").alias("scopes"))


SNAP = "b as (select source as grp, doc_id as member, md5(coalesce(text, '')) as hash from documents where doc_id % 11 <> 0), a as (select source as grp, doc_id as member, case when doc_id % 50 = 1 then 'new' else md5(coalesce(text, '')) end as hash from documents where doc_id % 13 <> 0 or source in ('src1', 'src2'))"


def snapshots(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.col("source").alias("grp"), F.col("doc_id").alias("member"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    before = d.where("doc_id % 11 <> 0").drop("doc_id")
    after = d.where("doc_id % 13 <> 0 or grp in ('src1', 'src2')").withColumn("hash", F.when(F.col("doc_id") % 50 == 1, "new").otherwise(F.col("hash"))).drop("doc_id")
    return before, after


@query("g01_membership_change", f"with {SNAP}, j as (select coalesce(a.grp, b.grp) as grp, b.hash as h0, a.hash as h1 from b full join a on a.grp = b.grp and a.member = b.member), s as (select grp, count(h0) as was, count(h1) as now, count(*) filter (h0 is distinct from h1) as changed from j group by grp) select *, case when changed = 0 then 'skip' when changed >= 5 or changed >= 0.2 * was then 'generate' else 'refresh' end as mode from s")
def g01(spark, sf):
    return G.membership_change(*snapshots(spark, sf), "grp")


@query("g01_member_digest", f"with {SNAP}, l as (select grp, ('0x' || left(md5(member::varchar), 4))::int % 256 as bucket, member || ':' || hash as line from a), p as (select grp, bucket, sha256(string_agg(line, chr(10) order by line)) as part from l group by all) select grp, sha256(string_agg(bucket || ':' || part, chr(10) order by bucket)) as digest from p group by grp")
def g01b(spark, sf):
    return G.member_digest(snapshots(spark, sf)[1], "grp")


@query("g05_first_of_union", "with u as (select event_type as key, 0 as src, min(event_id) as pos from events where user_id < 20 group by 1 union all select 'u' || user_id, 1, min(event_id) from events group by 1 union all select event_type, 2, max(event_id) from events group by 1) select key, min((src, pos))[1] as src, min((src, pos))[2] as pos from u group by key")
def g05(spark, sf):
    e = load(spark, sf, "events")
    a = e.where("user_id < 20").select(F.col("event_type").alias("key"), F.col("event_id").alias("pos"))
    b = e.select(F.concat(F.lit("u"), "user_id").alias("key"), F.col("event_id").alias("pos"))
    c = e.groupBy(F.col("event_type").alias("key")).agg(F.max("event_id").alias("pos"))
    return G.first_of_union(a, b, c, key="key")


@query("g07_incremental_plan", f"with {SNAP}, j as (select coalesce(a.grp, b.grp) as grp, b.member as m0, a.member as m1, a.hash as h1, b.hash as h0 from b full join a on a.grp = b.grp and a.member = b.member) select grp, count(*) filter (m0 is null) as arrived, count(*) filter (m1 is null) as gone, count(*) filter (h0 <> h1) as stale, case when count(*) filter (m0 is null) < 0.2 * count(m0) then 'assign' else 'plan' end as mode from j group by grp")
def g07(spark, sf):
    b, a = snapshots(spark, sf)
    j = b.withColumnRenamed("hash", "h0").join(a.withColumnRenamed("hash", "h1"), ["grp", "member"], "full_outer")
    new = F.count_if(F.col("h0").isNull())
    return j.groupBy("grp").agg(new.alias("arrived"), F.count_if(F.col("h1").isNull()).alias("gone"), F.count_if(F.col("h0") != F.col("h1")).alias("stale"), F.when(new < 0.2 * F.count("h0"), "assign").otherwise("plan").alias("mode"))


@query("c13_partition_defects", "with a as (select c_custkey as member from customer where c_custkey % 17 <> 0 union all select c_custkey from customer where c_custkey % 19 = 0 union all select -c_custkey from customer where c_custkey % 500 = 1), n as (select member, count(*) as times from a group by 1) select coalesce(n.member, c.c_custkey) as member, case when c_custkey is null then 'unknown' when n.member is null then 'unassigned' else 'assigned twice' end as defect from n full join customer c on c.c_custkey = n.member where c_custkey is null or n.member is null or times > 1")
def c13(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("member"))
    assigned = c.where("member % 17 <> 0").union(c.where("member % 19 = 0")).union(c.where("member % 500 = 1").select(-F.col("member")))
    return G.partition_defects(assigned, c)


@query("d12_co_occurrence", "with m as (select distinct l_suppkey % 40 as slug, l_orderkey as member from lineitem), p as (select a.slug, b.slug as other, count(*) as shared from m a join m b using (member) where a.slug <> b.slug group by all), r as (select *, row_number() over (partition by slug order by shared desc, other) as rank from p) select * from r where rank <= 10")
def d12(spark, sf):
    m = load(spark, sf, "lineitem").select((F.col("l_suppkey") % 40).alias("slug"), F.col("l_orderkey").alias("member"))
    return G.co_occurrence(m, 10)


@query("d13_nearest_caption", "with i as (select l_orderkey as page, l_linenumber as item, l_quantity as x0, l_quantity + 5 as x1, l_discount * 100 as y0, l_discount * 100 + 3 as y1 from lineitem where l_returnflag = 'R'), c as (select l_orderkey as page, l_linenumber as caption, l_tax * 200 as cx0, l_tax * 200 + 9 as cx1, l_quantity / 2 as cy0, l_quantity / 2 + 2 as cy1 from lineitem where l_returnflag <> 'R'), d as (select page, item, caption, round(sqrt(greatest(0, x0 - cx1, cx0 - x1) ** 2 + greatest(0, y0 - cy1, cy0 - y1) ** 2) + case when cy1 < y0 then 80 else 0 end, 6) as cost from i join c using (page)) select page, item, min((cost, caption))[2] as caption, min((cost, caption))[1] as cost from d group by page, item")
def d13(spark, sf):
    l = load(spark, sf, "lineitem")  # noqa: E741
    i = l.where("l_returnflag = 'R'").selectExpr("l_orderkey as page", "l_linenumber as item", "l_quantity as x0", "l_quantity + 5 as x1", "l_discount * 100 as y0", "l_discount * 100 + 3 as y1")
    c = l.where("l_returnflag <> 'R'").selectExpr("l_orderkey as page", "l_linenumber as caption", "l_tax * 200 as cx0", "l_tax * 200 + 9 as cx1", "l_quantity / 2 as cy0", "l_quantity / 2 + 2 as cy1")
    return G.nearest_caption(i, c, F.when(F.col("cy1") < F.col("y0"), 80.0).otherwise(0.0))


SUMMARY = "trim(substr(replace(text, chr(10), ' '), 1, 260))"
CATALOGUED = f"'- [[sources/s' || doc_id || '|' || title || ']] (' || (1990 + doc_id % 30) || ', ' || journal || ')' || case when doc_id % 4 = 0 then '' else ' 10.5555/d' || doc_id end || ': ' || {SUMMARY}"


@query("b05_browse_pages", f"with {SQL_CITES}, {SQL_NOTES}, n as (select category, title, doc_id, {CATALOGUED} || case when doc_id in (select target from cites where source % 2 = 1) then '' else ' (orphan)' end as line from notes where text is not null), c as (select category, count(*) as notes, md5(string_agg(line, chr(10) order by title, doc_id)) as page from n group by category), r as (select '' as category, count(*) as notes, md5(string_agg('| ' || category || ' | ' || notes || ' |', chr(10) order by notes desc, category)) as page from c) select * from c union all select * from r")
def b05(spark, sf):
    """A page for each category, one line for each note, and the table of all categories, largest first; a page is one file, so its lines are one row."""
    cited = cites(spark, sf).where("source % 2 = 1").select(F.col("target").alias("doc_id"), F.lit(1).alias("c")).distinct()
    n = notes(spark, sf).where("text is not null").join(cited, "doc_id", "left").select("category", "title", "doc_id", F.concat(F.expr(CATALOGUED), F.when(F.col("c").isNull(), " (orphan)").otherwise("")).alias("line"))
    listed = lambda order: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"]), "\n").cast("binary")).alias("page")
    c = n.groupBy("category").agg(F.count(F.lit(1)).alias("notes"), listed(F.struct("title", "doc_id", "line")))
    row = F.concat(F.lit("| "), "category", F.lit(" | "), "notes", F.lit(" |")).alias("line")
    root = c.agg(F.count(F.lit(1)).alias("n"), listed(F.struct((-F.col("notes")).alias("size"), "category", row))).select(F.lit("").alias("category"), F.col("n").alias("notes"), "page")
    return c.unionByName(root)


STANDING = "Questions about this page"


@query("b09_question_hubs", f"with {SQL_CITES}, h as (select target, source, date '2024-01-01' + (source % 30)::int as day from cites), g as (select target, count(*) as questions, '# Questions' || chr(10) || string_agg('- ' || day || ' [[questions/q' || source || ']]', chr(10) order by day desc, source desc) as hub from h group by target) select target, questions, md5(hub) as hub, length(case when text like '%## {STANDING}%' then text else rtrim(text) || chr(10) || chr(10) || '## {STANDING}' || chr(10) || '[[hubs/h' || target || ']]' || chr(10) end) as page_chars from g left join documents on doc_id = target")
def b09(spark, sf):
    """For each cited page a hub of its questions, newest first, and the page with a standing link to it, added once."""
    h = cites(spark, sf).select("target", "source", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("source") % 30).cast("int")).alias("day"))
    line = F.concat(F.lit("- "), F.col("day").cast("string"), F.lit(" [[questions/q"), "source", F.lit("]]")).alias("line")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("day", "source", line)), asc=False), lambda x: x["line"])
    g = h.groupBy("target").agg(F.count(F.lit(1)).alias("questions"), F.md5(F.concat(F.lit("# Questions\n"), F.array_join(lines, "\n")).cast("binary")).alias("hub"))
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("target"), "text")
    linked = F.when(F.contains("text", F.lit(f"## {STANDING}")), F.col("text")).otherwise(F.concat(F.rtrim("text"), F.lit(f"\n\n## {STANDING}\n[[hubs/h"), "target", F.lit("]]\n")))
    return g.join(d, "target", "left").select("target", "questions", "hub", F.length(linked).alias("page_chars"))


@query("b09_answer_pages", "with q as (select conv_id, string_agg(text, chr(10) order by turn) filter (role = 'user') as question, string_agg(text, chr(10) order by turn) filter (role = 'assistant') as answer, max(turn) as last from conversations group by 1), l as (select conv_id, string_agg('- [[sources/s' || k || ']]', chr(10) order by k) as cited from (select conv_id, unnest(range(conv_id, conv_id + conv_id % 4)) as k from q) group by 1) select conv_id, md5('---' || chr(10) || 'question: q' || conv_id || chr(10) || 'period: 2024-' || lpad((1 + conv_id % 12)::varchar, 2, '0') || chr(10) || '---' || chr(10) || '## Question' || chr(10) || coalesce(question, '') || chr(10) || '## Answer' || chr(10) || coalesce(answer, '(none)') || chr(10) || '## Cited' || chr(10) || coalesce(cited, '')) as page from q left join l using (conv_id)")
def b09_answers(spark, sf):
    """A page for each answered question: header, question, answer, and what it cites."""
    of = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    q = load(spark, sf, "conversations").groupBy("conv_id").agg(of("user").alias("question"), of("assistant").alias("answer"), F.count_if(F.col("role") == "assistant").alias("answers"))
    n = (F.col("conv_id") % 4).cast("int")
    cited = F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(F.lit("- [[sources/s"), F.col("conv_id") + i, F.lit("]]"))), "\n")).otherwise("")
    page = F.concat(F.lit("---\nquestion: q"), "conv_id", F.lit("\nperiod: 2024-"), F.lpad((1 + F.col("conv_id") % 12).cast("string"), 2, "0"), F.lit("\n---\n## Question\n"), "question", F.lit("\n## Answer\n"), F.when(F.col("answers") > 0, F.col("answer")).otherwise("(none)"), F.lit("\n## Cited\n"), cited)
    return q.select("conv_id", F.md5(page.cast("binary")).alias("page"))


@query("b11_block_merge", "with o as (select user_id as page, event_type as entry, min(event_id) as v from events where ts < timestamp '2024-01-15' group by all), n as (select user_id as page, event_type as entry, max(event_id) as v from events where ts >= timestamp '2024-01-20' group by all), m as (select coalesce(o.page, n.page) as page, coalesce(o.entry, n.entry) as entry, coalesce(n.v, o.v) as v from o full join n on o.page = n.page and o.entry = n.entry) select page, string_agg(entry || '=' || v, ';' order by entry) as block from m group by page")
def b11(spark, sf):
    """A managed block: what was listed united with what is new, the new version of an entry winning."""
    e = load(spark, sf, "events").select("ts", F.col("user_id").alias("page"), F.col("event_type").alias("entry"), "event_id")
    o = e.where("ts < timestamp_ntz '2024-01-15'").groupBy("page", "entry").agg(F.min("event_id").alias("o"))
    n = e.where("ts >= timestamp_ntz '2024-01-20'").groupBy("page", "entry").agg(F.max("event_id").alias("n"))
    m = o.join(n, ["page", "entry"], "full_outer").select("page", F.concat("entry", F.lit("="), F.coalesce("n", "o")).alias("line"), "entry")
    return m.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry", "line"))), lambda x: x["line"]), ";").alias("block"))


@query("c12_link_validation", f"with {SQL_LINKS}, ok as (select distinct lower('/' || regexp_extract(url, '([^/]*)$', 1)) as target from pages) select page_id, count(*) as links, count(*) filter (ok.target is null) as unknown from links left join ok using (target) group by page_id")
def c12(spark, sf):
    ok = pages(spark, sf).select(F.col("page").alias("target"), F.lit(1).alias("ok")).distinct()
    return page_links(spark, sf).join(ok, "target", "left").groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("ok").isNull()).alias("unknown"))


@query("b04_index_tables", f"with {SQL_NOTES}, d as (select category, count(*) as n from notes group by 1), s as (select category, sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))) as n from notes group by 1), k as (select regexp_extract(url, '^https?://([^/]*)', 1) as category, count(*) as n from pages group by 1) select 'docs' as tab, category, n::bigint as n from d union all select 'sections', category, n::bigint from s union all select 'pages', category, n from k")
def b04(spark, sf):
    """What publishing the index would write, table by table."""
    from folioscope.operators import search as S

    n = notes(spark, sf)
    one = lambda df, name: df.groupBy("category").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tab"), "category", "n")
    return one(n, "docs").unionByName(one(S.sections(n), "sections")).unionByName(one(load(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/]*)", 1).alias("category")), "pages"))


@query("b04_published_index", f"""with {SQL_NOTES}, {SQL_LINKS}, n as (select *, row_number() over (partition by doc_id % 700 order by doc_id) as nth from notes), won as (select *, 'n' || (doc_id % 700) as id from n where nth = 1),
e as (select distinct page_id, 'n' || (length(target) * 37 % 700) as id from links)
select 'docs' as tab, 'note' as kind, count(*) as n from won union all select 'docs', 'concept', count(*) from pages union all select 'sections', 'note', sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))::bigint from won
union all select 'links', 'concept', count(*) from e union all select 'orphans', 'note', count(*) from won where id not in (select id from e)""")
def b04_published(spark, sf):
    """The index tables as one version: the first of two notes under one id, its sections, different links, and notes that nothing links to; read back from the commit."""
    from folioscope.lineage import new_table
    from folioscope.operators import search as S

    note = lambda d: d.select(F.lit("note").alias("doc_type"), F.concat(F.lit("n"), F.col("doc_id") % 700).alias("doc_id"), F.col("doc_id").alias("writer"))
    n = notes(spark, sf)
    concept = load(spark, sf, "pages").select(F.lit("concept").alias("doc_type"), F.concat(F.lit("p"), "page_id").alias("doc_id"), F.col("page_id").alias("writer"))
    links = page_links(spark, sf).select(F.lit("concept").alias("doc_type"), F.concat(F.lit("p"), "page_id").alias("doc_id"), F.col("page_id").alias("writer"), F.lit("note").alias("to_type"), F.concat(F.lit("n"), F.length("target") * 37 % 700).alias("to_id"))
    root = new_table(spark)
    version = commits.commit(commits.index_tables(note(n).unionByName(concept), note(S.sections(n)), links), root, follows=0)
    t = commits.snapshot(spark, root, version)
    count = lambda tab, d, kind: d.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(tab).alias("tab"), "kind", "n")
    out = count("docs", t["docs"], F.col("doc_type")).unionByName(count("sections", t["sections"], F.col("doc_type"))).unionByName(count("links", t["links"], F.col("from_type")))
    return out.unionByName(t["orphans"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphans").alias("tab"), F.lit("note").alias("kind"), "n"))
