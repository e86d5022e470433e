"""Queries over readers, sinks and packing, on contents made from the tables."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions.jsons import robust
from folioscope.lineage import shared_folder
from folioscope.operators import packing
from folioscope.plans.registry import query
from folioscope.sources import readers, sinks
from folioscope.sources.tables import SQL_NOTES, load, notes
from folioscope.streaming import jobs as stream

#: A page with a header that any text can stand in: its first characters without quotes and breaks are the title.
TITLE = "translate(left(text, 10), '\"' || chr(10), '  ')"
PAGE = f"'---' || chr(10) || 'title: \"' || {TITLE} || '\"' || chr(10) || 'category: ' || lang || chr(10) || ' more: x' || chr(10) || case when doc_id % 3 = 0 then 'no field' || chr(10) else '' end || 'year: ' || (1990 + doc_id % 30) || chr(10) || '---' || chr(10) || '# T' || chr(10) || text"
DIALECTS = {"quoted": {}, "json": {"values": "json"}, "raw": {"values": "raw"}, "known": {"known": ["category", "year"]}, "strict": {"strict": True}}


@query("a05_frontmatter", f"with p as (select doc_id, {TITLE} as head, lang, (1990 + doc_id % 30)::varchar as year, length('# T' || chr(10) || text) as body_chars, unnest(['quoted', 'json', 'raw', 'known', 'strict']) as dialect from documents where text is not null) select doc_id, dialect, case dialect when 'raw' then '\"' || head || '\"' when 'known' then null when 'strict' then case when doc_id % 3 > 0 then head end else head end as title, case when dialect <> 'strict' or doc_id % 3 > 0 then lang end as category, case when dialect <> 'strict' or doc_id % 3 > 0 then year end as year, body_chars from p")
def a05(spark, sf):
    """Headers of pages in five dialects."""
    d = load(spark, sf, "documents").where("text is not null").select("doc_id", F.expr(PAGE).alias("page"))
    read = [(k, *readers.frontmatter("page", **a)) for k, a in DIALECTS.items()]
    each = F.array(*[F.struct(F.lit(k).alias("dialect"), f.alias("f"), F.length(body).alias("body_chars")) for k, f, body in read])
    d = d.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*")
    return d.select("doc_id", "dialect", F.try_element_at("f", F.lit("title")).alias("title"), F.try_element_at("f", F.lit("category")).alias("category"), F.try_element_at("f", F.lit("year")).alias("year"), "body_chars")


@query("a04_listing", "select '/' || lang || '/' || source || '/' || doc_id || '.md' as key from documents where doc_id % 11 <> 0 and source <> 'src4' and n_chars >= 50")
def a04(spark, sf):
    """Keys to index: no drafts, no failed folder, nothing too small."""
    d = load(spark, sf, "documents").select(F.concat_ws("/", F.lit(""), "lang", "source", F.concat(F.when(F.col("doc_id") % 11 == 0, "drafts/").otherwise(""), "doc_id", F.lit(".md"))).alias("key"), "n_chars")
    return d.where(~F.col("key").rlike("/drafts/|/src4/") & (F.col("n_chars") >= 50)).select("key")


@query("a06_json_slices", "select event_id, (props::json->>'$.k')::int as k, substr('{' || chr(10) || '  \"event\": ' || event_id || ',' || chr(10) || '  \"k\": ' || (props::json->>'$.k') || chr(10) || '}', 3, 12) as part, coalesce(props::json->>'$.missing', 'none') as missing from events")
def a06(spark, sf):
    """A value of an object, a default for one that isn't there, and a window of the object's text laid out in lines."""
    e = load(spark, sf, "events").select("event_id", F.from_json("props", "k int, missing string").alias("p"))
    laid = F.concat(F.lit('{\n  "event": '), "event_id", F.lit(',\n  "k": '), "p.k", F.lit("\n}"))
    return e.select("event_id", "p.k", F.substring(laid, 3, 12).alias("part"), F.coalesce("p.missing", F.lit("none")).alias("missing"))


@query("a07_ledger_lines", "select event_type as step, count(*) as lines, sum(case when event_id % 4 = 0 then 0 else (props::json->>'$.k')::int end)::bigint as tokens from events group by 1")
def a07(spark, sf):
    """Lines of a ledger, a missing number being zero."""
    line = F.to_json(F.struct(F.col("event_type").alias("step"), F.when(F.col("event_id") % 4 != 0, F.get_json_object("props", "$.k").cast("int")).alias("tokens")))
    p = load(spark, sf, "events").select(F.from_json(line, "step string, tokens int").alias("l"))
    return p.groupBy("l.step").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.coalesce("l.tokens", F.lit(0))).alias("tokens"))


@query("a09_cell_match", "select doc_id, len(string_split(line, ' | ')) as cells from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where list_contains(list_transform(string_split(line, ' | '), lambda c: lower(trim(c))), 'on')")
def a09(spark, sf):
    """Rows of the tables in texts that have a cell equal to the needle, without regard to case."""
    l = load(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("c", F.split("line", r" \| "))  # noqa: E741
    return l.where(F.exists("c", lambda x: F.lower(F.trim(x)) == "on")).select("doc_id", F.size("c").alias("cells"))


TEI = "'<TEI><teiHeader><title level=\"a\">' || p_name || '</title><surname>' || p_brand || '</surname><surname>' || p_type || '</surname><date when=\"' || (1950 + p_size) || '-01\"/><idno type=\"DOI\">10.1/X' || p_partkey || '</idno></teiHeader><text><idno type=\"DOI\">10.9/other</idno></text></TEI>'"


@query("a15_tei_headers", "select p_partkey, p_name as title, p_brand || ';' || p_type as surnames, (1950 + p_size)::varchar as year, '10.1/x' || p_partkey as doi from part")
def a15(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", readers.tei_header(F.expr(TEI)).alias("h"))
    return p.select("p_partkey", "h.title", F.array_join("h.surnames", ";").alias("surnames"), "h.year", "h.doi")


@query("a17_converter_states", "with r as (select l_partkey as doi, count(distinct l_suppkey % 9) as ids, max(l_suppkey % 9) as id from lineitem where l_returnflag = 'A' group by 1) select p_partkey as doi, case when ids is null then 'error' when ids > 5 or id = 3 then 'mismatch' else 'ok' end as state from part left join r on r.doi = p_partkey")
def a17(spark, sf):
    """Every requested key has a state; keys answered in different ways are mismatches."""
    r = load(spark, sf, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("doi")).agg(F.count_distinct(F.col("l_suppkey") % 9).alias("ids"), F.max(F.col("l_suppkey") % 9).alias("id"))
    return load(spark, sf, "part").select(F.col("p_partkey").alias("doi")).join(r, "doi", "left").select("doi", F.when(F.col("ids").isNull(), "error").when((F.col("ids") > 5) | (F.col("id") == 3), "mismatch").otherwise("ok").alias("state"))


@query("a21_bounded_reads", "select doc_id, case when octet_length(encode(text)) > 8000 then 'too large' else 'ok' end as state, case when octet_length(encode(text)) <= 8000 then sha256(text) end as hash from documents")
def a21(spark, sf):
    n = F.octet_length("text")
    return load(spark, sf, "documents").select("doc_id", F.when(n > 8000, "too large").otherwise("ok").alias("state"), F.when(n <= 8000, F.sha2("text", 256)).alias("hash"))


@query("a22_related_keys", "select doc_id, case when doc_id % 3 = 0 then 'papers/' || doc_id || '/assets.md' when doc_id % 3 = 1 then 'sources/' || doc_id || '.assets.md' end as assets from documents")
def a22(spark, sf):
    """A stored text's key gives its figures' key; two layouts, null for others."""
    k = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("papers/"), "doc_id", F.lit("/clean.md"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("sources/"), "doc_id", F.lit(".md"))).otherwise("other")
    one, two = r"^(papers/[A-Za-z0-9._-]+)/clean\.md$", r"^(sources/[A-Za-z0-9._-]+)\.md$"
    return load(spark, sf, "documents").select("doc_id", k.alias("k")).select("doc_id", F.when(F.col("k").rlike(one), F.concat(F.regexp_extract("k", one, 1), F.lit("/assets.md"))).when(F.col("k").rlike(two), F.concat(F.regexp_extract("k", two, 1), F.lit(".assets.md"))).alias("assets"))


@query("a23_kept_files", "select l_orderkey as stem, l_linenumber || '-' || l_partkey as file, l_shipdate < timestamp '1997-01-01' as readable from lineitem where l_returnflag <> 'R'")
def a23(spark, sf):
    """Files a manifest kept, exploded, each with whether it can be read."""
    m = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_shipdate")).alias("files"))
    return m.select(F.col("l_orderkey").alias("stem"), F.explode("files").alias("f")).where("f.l_returnflag <> 'R'").select("stem", F.concat_ws("-", "f.l_linenumber", "f.l_partkey").alias("file"), F.expr("f.l_shipdate < timestamp_ntz '1997-01-01'").alias("readable"))


@query("b03_publish_outcomes", "with s as (select s_suppkey as key, s_suppkey % 4 as version from supplier where s_suppkey % 3 > 0), w as (select s_suppkey as key, case when s_suppkey % 3 = 0 then null when s_suppkey % 5 = 0 then 99 else s_suppkey % 4 end as expected from supplier where s_suppkey % 2 = 0) select coalesce(s.key, w.key) as key, case when w.key is null then 'kept' when s.key is null then 'created' when s.version = w.expected then 'replaced' else 'conflict' end as outcome, case when w.key is null then s.version when s.key is null then 1 when s.version = w.expected then s.version + 1 else s.version end as version from s full join w on s.key = w.key")
def b03(spark, sf):
    p = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("text"))
    s = p.where("key % 3 > 0").withColumn("version", F.col("key") % 4)
    w = p.where("key % 2 = 0").withColumn("expected", F.when(F.col("key") % 3 == 0, None).when(F.col("key") % 5 == 0, 99).otherwise(F.col("key") % 4))
    return sinks.publish(s, w).select("key", "outcome", "version")


@query("b10_assembled_pages", f"with {SQL_NOTES} select journal, count(*) as members, string_agg(distinct category, ',' order by category) as categories, md5(string_agg('- [[' || doc_id || ']] ' || md5(text), chr(10) order by doc_id)) as body from notes group by journal")
def b10(spark, sf):
    """Pages from aggregates: sorted categories, counts, a line for each member."""
    n = notes(spark, sf).select("journal", "category", "doc_id", F.concat(F.lit("- [["), "doc_id", F.lit("]] "), F.md5("text")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "line"))), lambda x: x["line"])
    return n.groupBy("journal").agg(F.count(F.lit(1)).alias("members"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.md5(F.array_join(lines, "\n")).alias("body"))


@query("b12_owned_fields", "select p_partkey, case when p_partkey % 4 = 0 then 'new' || p_size else p_name end as title, p_brand as created from part")
def b12(spark, sf):
    """The stored header wins, but for question pages, which only keep when they were created."""
    stored = F.create_map(F.lit("title"), F.col("p_name"), F.lit("created"), F.col("p_brand"))
    new = F.create_map(F.lit("title"), F.concat(F.lit("new"), F.col("p_size")), F.lit("created"), F.lit("today"))
    keep = F.when(F.col("p_partkey") % 4 == 0, F.map_filter(stored, lambda k, v: k == "created")).otherwise(stored)
    merged = F.map_concat(F.map_filter(new, lambda k, v: ~F.map_contains_key(keep, k)), keep)
    return load(spark, sf, "part").select("p_partkey", merged.alias("m")).select("p_partkey", F.col("m")["title"].alias("title"), F.col("m")["created"].alias("created"))


@query("b13_section_once", "select doc_id, (length(text) - length(replace(text, 'Licensed under', ''))) > 0 as had, length(case when text like '%Licensed under%' then text else rtrim(text) || chr(10) || chr(10) || '## Licensed under' || chr(10) || 'x' || chr(10) end) as chars from documents")
def b13(spark, sf):
    d = load(spark, sf, "documents")
    had = F.contains("text", F.lit("Licensed under"))
    once = sinks.with_section(F.col("text"), "Licensed under", "x")
    return d.select("doc_id", had.alias("had"), F.length(F.when(had, F.col("text")).otherwise(sinks.with_section(once, "Licensed under", "x"))).alias("chars"))


SIZED = "(l_quantity * 40)::bigint"
SQL_PARTS = f"l as (select l_orderkey // 100 as question, l_orderkey as doc_id, l_linenumber::int as ord, {SIZED} as size, dense_rank() over (partition by l_orderkey // 100 order by l_orderkey) as rank from lineitem), m as (select *, row_number() over (partition by question order by rank, ord, size) as n from l), o as (select *, n = min(n) over (partition by question, rank) as fresh from m)"


@query("f04_budget_allocation", f"""with recursive {SQL_PARTS},
r as (select question, 0::bigint as n, 24000::bigint as room, 9 as slots, 0::bigint as used, 0::bigint as share, null::bigint as doc_id, null::int as ord, 0::bigint as granted, null::varchar as reason from (select distinct question from o)
 union all select question, n, room - granted, slots, used + granted, share, doc_id, ord, granted, case when granted > 0 or ok then null when slots <= 0 then 'no slot' when size > room then 'over budget' else 'over share' end from (
  select *, case when ok then size else 0 end as granted from (select *, slots > 0 and size <= case when fresh then room else least(room, share - used) end as ok from (
   select o.question, o.n, o.doc_id, o.ord, o.size, o.fresh, r.room, r.slots - o.fresh::int as slots, case when o.fresh then 0 else r.used end as used, case when o.fresh then r.room // greatest(1, r.slots - 1) else r.share end as share from r join o on o.question = r.question and o.n = r.n + 1))))
select question, doc_id, ord, granted, reason from r where n > 0""")
def f04(spark, sf):
    """A byte budget over the documents of each question, in the order of their rank."""
    l = load(spark, sf, "lineitem").selectExpr("l_orderkey div 100 as question", "l_orderkey as doc_id", "l_linenumber as ord", "cast(l_quantity * 40 as bigint) as size")  # noqa: E741
    return packing.allocate(l.withColumn("rank", F.dense_rank().over(Window.partitionBy("question").orderBy("doc_id"))), 24_000, 8)


SQL_BATCHED = """i as (select source || '/' || (doc_id // 200) as grp, doc_id as item, n_chars as size, row_number() over (partition by source, doc_id // 200 order by doc_id, n_chars) as n from documents),
r as (select grp, 0::bigint as n, 0 as batch, 500::bigint as used, 0 as held, null::bigint as item, 0 as placed, 0::bigint as taken from (select distinct grp from i)
 union all select i.grp, i.n, case when size > 6000 then batch + (held > 0)::int + 1 when held > 0 and used + size > 6000 then batch + 1 else batch end, case when size > 6000 then 500 when held > 0 and used + size > 6000 then 500 + size else used + size end, case when size > 6000 then 0 when held > 0 and used + size > 6000 then 1 else held + 1 end,
  i.item, case when size > 6000 then batch + (held > 0)::int when held > 0 and used + size > 6000 then batch + 1 else batch end, least(size, 6000) from r join i on i.grp = r.grp and i.n = r.n + 1),
b as (select grp, item, placed as batch, taken from r where n > 0)"""


def batched(spark, sf):
    d = load(spark, sf, "documents").select(F.concat_ws("/", "source", F.expr("doc_id div 200")).alias("grp"), F.col("doc_id").alias("item"), F.col("doc_id").alias("pos"), F.col("n_chars").alias("size"))
    return packing.batches(d, 6000, 500)


@query("f10_batches", f"with recursive {SQL_BATCHED} select * from b")
def f10(spark, sf):
    """The notes of each page in batches that fit a call with its header."""
    return batched(spark, sf)


@query("f10_merge_tree", f"with recursive {SQL_BATCHED}, n as (select grp, max(batch) + 1 as size from b group by 1), v as (select grp, 0 as level, size, null::int as below from n union all select grp, level + 1, ceil(size / 4.0)::int, size from v where size > 1) select grp, level, node, case when level > 0 then node * 4 else node end as first, case when level > 0 then least(node * 4 + 4, below) - 1 else node end as last from (select *, unnest(range(size))::int as node from v)")
def f10_tree(spark, sf):
    """Which partials each page is merged from, four at a time, until one is left."""
    return packing.merge_tree(batched(spark, sf), 4)


@query("f15_trimmed_payloads", """with p as (select conv_id as grp, case role when 'system' then 'base' when 'user' then 'passage' else 'excerpt' end as kind, turn as pos, length(text)::bigint as size from conversations), e as (select *, sum(size) over (partition by grp order by pos) as upto from p where kind = 'excerpt'),
s as (select grp, coalesce(sum(size) filter (kind = 'base'), 0) as base, coalesce(sum(size), 0) as total, count(*) filter (kind = 'passage') as n_p, count(*) filter (kind = 'excerpt') as n_e from p group by 1),
k as (select s.*, (select count(*) from e where e.grp = s.grp and s.base + e.upto <= 900) as fit, (select max(upto) from e where e.grp = s.grp and s.base + e.upto <= 900) as used from s)
select grp, case when total <= 900 then n_p + n_e when base <= 900 then fit end as kept, case when total <= 900 then 0 when base <= 900 then n_p + n_e - fit else n_p + n_e end as dropped, case when total <= 900 then total when base <= 900 then base + coalesce(used, 0) end::bigint as bytes from k""")
def f15(spark, sf):
    c = load(spark, sf, "conversations")
    kind = F.when(F.col("role") == "system", "base").when(F.col("role") == "user", "passage").otherwise("excerpt")
    return packing.trimmed(c.select(F.col("conv_id").alias("grp"), kind.alias("kind"), F.col("turn").alias("pos"), F.length("text").cast("long").alias("size")), 900)


@query("f12_bounded_rows", "with r as (select lang, doc_id, sum(length(left(coalesce(text, ''), 100))) over (partition by lang order by doc_id rows unbounded preceding) as used from documents) select lang, count(*) filter (used <= 4000) as kept, count(*) filter (used > 4000) as dropped from r group by lang")
def f12(spark, sf):
    """Rows kept until the response is full: the running size is taken from bounded previews."""
    # Empty previews take no room: the row that fills the response is among the first 4,001 that take some.
    d = load(spark, sf, "documents").select("lang", "doc_id", F.length(F.left(F.coalesce("text", F.lit("")), F.lit(100))).alias("n"))
    order = Window.partitionBy("lang").orderBy("doc_id")
    top = d.where("n > 0").withColumn("nth", F.row_number().over(order)).where("nth <= 4001")
    full = top.withColumn("used", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("used > 4000").groupBy("lang").agg(F.min("doc_id").alias("full"))
    kept = F.count_if(F.col("full").isNull() | (F.col("doc_id") < F.col("full")))
    return d.join(full.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left").groupBy("lang").agg(kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("dropped"))


def _size_sql(cells: str) -> str:
    return f"(6 + length(no::varchar) + coalesce(list_sum(list_transform({cells}, lambda c: length(to_json(c)::varchar))), 0) + 2 * greatest(len({cells}) - 1, 0))::bigint"


def _narrow_sql(chars: int, width: int) -> str:
    return f"list_transform(cells[1:{width}], lambda c: case when length(c) <= {chars} then c else left(c, {chars}) || '…' end)"


LENS = ", ".join(f"{_size_sql(_narrow_sql(*x))} as len{k}" for k, x in enumerate(packing.STAGES, 1))
MARKED = ", ".join(f"size0 - less{k} + {len(packing.CELLS_CUT.format(*x))} * parts as size{k}" for k, x in enumerate(packing.STAGES, 1))


@query("f12_fitted_responses", f"""with w as (select coalesce(lang, '') as resp, coalesce(source, '') as part, doc_id as no, string_split(string_split(coalesce(text, ''), chr(10))[1], ' ') as cells from documents),
n as (select *, row_number() over (partition by resp, part order by no) as nth from w), r0 as (select resp, part, false as header, nth, no, cells from n union all select distinct resp, part, true, 1, 0, ['doc', 'words'] from w),
r as (select *, {_size_sql('cells')} as len, {LENS}, count(*) filter (not header) over (partition by resp, part) as last from r0), s as (select resp, 13 + 30 * count(distinct part) + sum(len)::bigint + 2 * (count(*) filter (not header) - count(distinct part)) as whole, count(distinct part) as parts from r group by resp),
c as (select resp, part, nth, len + 2 - case when nth = last then {len(packing.ROWS_CUT)} else 0 end as saves from r where not header and nth > 1), o as (select *, coalesce(sum(saves) over (partition by resp order by nth desc, part rows between unbounded preceding and 1 preceding), 0) as before from c),
g as (select o.resp, o.part, min(nth) - 1 as kept, sum(saves) as saved from o join s using (resp) where whole - before > 6000 group by all), k as (select r.* from r left join g using (resp, part) where header or g.kept is null or nth <= g.kept),
t as (select resp, whole - coalesce((select sum(saved) from g where g.resp = s.resp), 0) as size0, parts, {', '.join(f'(select sum(len - len{k}) from k where k.resp = s.resp) as less{k}' for k in (1, 2, 3))} from s), u as (select *, {MARKED} from t),
v as (select resp, case when size0 <= 6000 then 0 when size1 <= 6000 then 1 when size2 <= 6000 then 2 else 3 end as stage, size0, size1, size2, size3 from u), x as (select resp, stage, case stage when 0 then size0 when 1 then size1 when 2 then size2 else size3 end as size from v)
select resp, part, count(*) filter (not header) as kept, max(stage) as stage, least(max(size), 6000)::bigint as size, max(size) > 6000 as cut from k join x using (resp) group by resp, part""")
def f12_fitted(spark, sf):
    """Responses with a part for each source: the longest parts lose rows, then cells are narrowed, until 6,000 characters hold them."""
    d = load(spark, sf, "documents")
    w = d.select(F.coalesce("lang", F.lit("")).alias("resp"), F.coalesce("source", F.lit("")).alias("part"), F.col("doc_id").alias("no"), F.split(F.split(F.coalesce("text", F.lit("")), "\n")[0], " ").alias("cells"))
    placed = packing.positions(w.withColumn("list", F.struct("resp", "part")), "list", "no").select("resp", "part", F.lit(False).alias("header"), (F.col("at") + 1).cast("long").alias("nth"), "no", "cells")
    heads = w.select("resp", "part").distinct()
    rows = placed.unionByName(heads.select("resp", "part", F.lit(True).alias("header"), F.lit(1).cast("long").alias("nth"), F.lit(0).cast("long").alias("no"), F.array(F.lit("doc"), F.lit("words")).alias("cells")))
    kept, sizes = packing.fitted(rows, heads.groupBy("resp").agg((13 + 30 * F.count(F.lit(1))).alias("frame")), 6000)
    n = kept.groupBy("resp", "part").agg(F.count_if(~F.col("header")).alias("kept"))
    return n.join(sizes, "resp").select("resp", "part", "kept", "stage", "size", "cut")


def _made(spark, sf, make):
    """(path, content) of a small file for each nation, made by make(name, key)."""
    def run(frames):
        for f in frames:
            yield pd.DataFrame({"path": [f"n{k}" for k in f["n_nationkey"]], "content": [make(n, k) for n, k in zip(f["n_name"], f["n_nationkey"])]})

    return load(spark, sf, "nation").select("n_name", "n_nationkey").mapInPandas(run, "path string, content binary")


def _zip(files: dict[str, str]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return b.getvalue()


@query("a10_spreadsheets", "select 'n' || n_nationkey as path, 'sheet1' as sheet, 1::bigint as row, 1::bigint as col, n_name as value from nation union all select 'n' || n_nationkey, 'sheet1', 1, 28, n_nationkey::varchar from nation")
def a10(spark, sf):
    """Cells of workbooks; strings are shared ones."""
    made = _made(spark, sf, lambda n, k: _zip({"xl/sharedStrings.xml": f"<sst><si><t>other</t></si><si><t>{n}</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="AB1"><v>{k}</v></c></row></sheetData></worksheet>'}))
    return readers.spreadsheets(made).where("error is null").drop("error")


@query("a11_word_tables", "select 'n' || n_nationkey as path, 'table1' as sheet, 1::bigint as row, 2::bigint as col, n_name || ' ' || n_nationkey as value from nation union all select 'n' || n_nationkey, 'table1', 1, 1, 'name' from nation")
def a11(spark, sf):
    p = lambda *t: "<w:tc>" + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in t) + "</w:tc>"
    made = _made(spark, sf, lambda n, k: _zip({"word/document.xml": f'<w:document xmlns:w="x"><w:tbl><w:tr>{p("name")}{p(n, k)}</w:tr></w:tbl></w:document>'}))
    return readers.word_tables(made).where("error is null").drop("error")


@query("a12_archive_members", "select 'n' || n_nationkey as path, 'n' || n_nationkey || '::data/' || n_name || '.csv' as member, length(n_name)::bigint as size from nation")
def a12(spark, sf):
    return readers.archive_members(_made(spark, sf, lambda n, k: _zip({f"data/{n}.csv": n, "__MACOSX/x": "x"})))


@query("a14_tei_markdown", "select 'n' || n_nationkey as path, '# ' || n_name || chr(10) || chr(10) || '## H' || chr(10) || chr(10) || 'p ' || n_nationkey as markdown from nation")
def a14(spark, sf):
    return readers.tei_markdown(_made(spark, sf, lambda n, k: f"<TEI><teiHeader><title>{n}</title></teiHeader><head>H</head><p>p  {k}</p></TEI>".encode()))


@query("a16_citation_structs", "select p_partkey, p_name as title, 'k' || p_partkey as pmid, case when p_size % 2 = 0 then '10.1/a' || p_partkey end as doi from part")
def a16(spark, sf):
    """Nested structs of citation XML in a column; a DOI only if there is exactly one."""
    xml = F.expr("'<A><PMID>k' || p_partkey || '</PMID><T>' || p_name || '</T><Id type=\"doi\">10.1/A' || p_partkey || '</Id>' || case when p_size % 2 = 1 then '<Id type=\"doi\">10.1/other</Id>' else '' end || '<Id type=\"pmc\">x</Id></A>'")
    x = load(spark, sf, "part").select("p_partkey", F.from_xml(xml, "PMID string, T string, Id array<struct<_VALUE:string,_type:string>>").alias("x"))
    own = F.filter("x.Id", lambda i: i["_type"] == "doi")
    return x.select("p_partkey", F.col("x.T").alias("title"), F.col("x.PMID").alias("pmid"), F.when(F.size(own) == 1, F.lower(own[0]["_VALUE"])).alias("doi"))


@query("i10_robust_json", "select event_id, case when event_id % 5 = 4 then null else (props::json->>'$.k')::int end as k from events")
def i10(spark, sf):
    """Strict, fenced, embedded; without a value or with a repeated key there is none."""
    p = F.col("props")
    t = F.when(F.col("event_id") % 5 == 0, p).when(F.col("event_id") % 5 == 1, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```"))).when(F.col("event_id") % 5 == 2, F.concat(F.lit("so "), p, F.lit(" it is"))).when(F.col("event_id") % 5 == 3, F.concat(F.lit(" "), p, F.lit("\n"))).otherwise(F.lit('{"k": 1, "k": 2}'))
    return load(spark, sf, "events").select("event_id", F.try_variant_get(robust(t), "$.k", "int").alias("k"))


@query("b02_create_only", "select 1 as attempt, true as created, (select count(*) from nation) as rows union all select 2, false, (select count(*) from nation)")
def b02(spark, sf):
    """The second writer finds the first one's table."""
    path = f"{shared_folder(spark)}/once-{uuid.uuid4().hex}"
    n = load(spark, sf, "nation")
    found = [(k, sinks.create_only(df, path), spark.read.parquet(path).count()) for k, df in ((1, n), (2, n.limit(1)))]
    return spark.createDataFrame(found, "attempt int, created boolean, rows long")


@query("b07_html_report", "select s_suppkey as key, s_name || ' </script><b>\"&' as name, '2024-01-01'::date + (s_suppkey % 50)::int as day, (select '2024-01-01'::date + min(s_suppkey % 50)::int from supplier) as first, (select '2024-01-01'::date + max(s_suppkey % 50)::int from supplier) as last, true as alone, true as refused from supplier")
def b07(spark, sf):
    """The rows that a report's pages hold, read back out of them, with its dates; ``refused``: a page of more rows isn't made."""
    rows = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.concat("s_name", F.lit(' </script><b>"&')).alias("name"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("s_suppkey") % 50).cast("int")).alias("day"))
    pages = sinks.html_pages(rows, "Suppliers", "key", date="day")
    try:
        sinks.html_report(load(spark, sf, "supplier"), "Too many", most=5)
        refused = False
    except ValueError:
        refused = True
    read = sinks.page_parts(pages.withColumn("alone", F.size(F.split("html", "</script>")) == 2)).select(F.from_json("row", "key long, name string, day date").alias("r"), "first", "last", "alone")
    return read.select("r.*", F.col("first").cast("date").alias("first"), F.col("last").cast("date").alias("last"), "alone", F.lit(refused).alias("refused"))


@query("j01_new_objects", "select event_id, event_type from events where event_id % 3 > 0")
def j01(spark, sf):
    """New objects of a stream, but for those that an earlier run finished; the checkpoint makes each once."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events = load(spark, sf, "events").select("event_id", "event_type")
    new = spark.readStream.schema(load(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf).select("event_id", "event_type")
    done = events.where("event_id % 3 = 0")
    stream.process_new(new, lambda: done, "event_id", lambda df: df.write.mode("append").parquet(f"{root}/out"), f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{root}/out")


@query("j08_resumed_batches", "select event_id, event_type from events")
def j08(spark, sf):
    """A stream that stops after its first run and goes on: nothing twice, nothing lost."""
    root = f"{shared_folder(spark)}/resume-{uuid.uuid4().hex}"
    events = load(spark, sf, "events").select("event_id", "event_type")
    out = spark.createDataFrame([], events.schema)
    out.write.parquet(f"{root}/out")
    for _ in range(2):
        new = spark.readStream.schema(load(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf).select("event_id", "event_type")
        stream.process_new(new, lambda: spark.read.schema(events.schema).parquet(f"{root}/out"), "event_id", lambda df: df.write.mode("append").parquet(f"{root}/out"), f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{root}/out")
