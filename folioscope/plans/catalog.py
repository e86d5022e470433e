"""Catalogue queries: search, screening, verdicts, identifiers, projections, upserts, keyed reads and exports.

Orders with their customers stand for catalogued papers, parts for journals, nations and regions for the small
policy dimensions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import packing
from folioscope.plans.registry import query
from folioscope.sources import sinks
from folioscope.sources.tables import load


def papers(spark, sf) -> DataFrame:
    """One row for each order: id, status, year, priority, total, customer, segment, nation."""
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.year("o_orderdate").alias("year"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("total"), F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))


SQL_PAPERS = "papers as (select o_orderkey as id, o_orderstatus as status, year(o_orderdate)::int as year, o_orderdate::date as day, o_orderpriority as priority, o_totalprice as total, c_custkey as cust, c_mktsegment as segment, c_nationkey as nation from orders left join customer on o_custkey = c_custkey)"


@query("a01_filtered_scan", f"with {SQL_PAPERS} select id, status, year from papers where status = 'F' and year >= 1995")
def a01(spark, sf):
    return papers(spark, sf).where("status = 'F' and year >= 1995").select("id", "status", "year")


@query("a02_holder_of_key", "select a.s_suppkey as id, min(b.s_suppkey) as other from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey <> b.s_suppkey group by 1")
def a02(spark, sf):
    """For each record the least other record with the same secondary key."""
    s = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    # The least and the second least of each key, by two sums: no group is gathered.
    first = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("m"))
    marked = s.join(first, "s_nationkey")
    second = marked.where("s_suppkey <> m").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("m2"))
    return marked.join(second, "s_nationkey").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") == F.col("m"), F.col("m2")).otherwise(F.col("m")).alias("other"))


@query("a03_keyset_page", "select event_id, ts, event_type from events where user_id = 7 and event_type like 'p%' and event_id > 100 order by event_id limit 25")
def a03(spark, sf):
    return load(spark, sf, "events").where("user_id = 7 and event_type like 'p%' and event_id > 100").orderBy("event_id").limit(25).select("event_id", "ts", "event_type")


@query("b01_csv_projection", f"with {SQL_PAPERS} select id, coalesce(nullif(segment, ''), priority) as venue, coalesce(status, '') || '; ' || coalesce(priority, '') as tags, case when total = floor(total) then total::bigint::varchar else round(total, 2)::varchar end as shown from papers".replace("case when total = floor(total) then total::bigint::varchar else round(total, 2)::varchar end", "round(total, 2)"))
def b01(spark, sf):
    """The export's columns, two of them with a fallback, lists joined."""
    p = papers(spark, sf)
    return p.select("id", F.coalesce(F.nullif("segment", F.lit("")), "priority").alias("venue"), F.concat(F.coalesce("status", F.lit("")), F.lit("; "), F.coalesce("priority", F.lit(""))).alias("tags"), F.round("total", 2).alias("shown"))


#: Orders as catalogue items, each third of them a candidate whose metadata stand in its record only.
ITEMS = {
    "work_id": "'w' || o_orderkey", "id_kind": "case when o_orderkey % 3 > 0 then 'doi' end", "title": "o_orderpriority || ' of ' || o_orderkey", "year": "case when o_orderkey % 3 > 0 then year(o_orderdate) end",
    "journal": "case when o_orderkey % 3 > 0 then o_orderpriority when o_orderkey % 6 = 0 then '' end", "doi": "'10.1/' || o_orderkey", "openalex_status": "o_orderstatus", "openalex_year": "year(o_orderdate) + o_orderkey % 2", "category": "case when o_custkey % 4 > 0 then 'c' || (o_custkey % 4) end",
    "ingest_status": "case when o_orderkey % 5 = 0 then 'failed' else 'ready' end", "pdf_key": "case when o_orderkey % 7 > 0 then 'pdf/' || o_orderkey || '.pdf' end", "pdf_bytes": "o_orderkey * 10",
}
RECORD = {"authors": "case when o_orderkey % 2 = 0 then 'Ng; ' || 'Li ' || (o_custkey % 9) else 'Ng' end", "publication_year": "year(o_orderdate)", "source": "'s' || (o_custkey % 5)", "type": "'article'"}


def _shown(c: str) -> str:
    own = f"coalesce(({ITEMS[c]})::varchar, '')" if c in ITEMS else "''"
    if c in sinks.FROM_RECORD:
        return f"case when {own} = '' then ({RECORD[sinks.FROM_RECORD[c]]})::varchar else {own} end as {c}"
    return f"{own} as {c}"


@query("b01_catalogue_export", f"select {', '.join(map(_shown, sinks.CATALOGUE))} from orders where o_orderkey % 7 > 0")
def b01_export(spark, sf):
    """All columns of the export for items with a PDF; authors, year, journal and type of candidates come from their records."""
    o = load(spark, sf, "orders")
    authors = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("Ng"), F.concat(F.lit("Li "), F.col("o_custkey") % 9))).otherwise(F.array(F.lit("Ng")))
    record = F.struct(authors.alias("authors"), *[F.expr(RECORD[c]).alias(c) for c in ("publication_year", "source", "type")])
    return sinks.catalogue_rows(o.select(*[F.expr(e).alias(c) for c, e in ITEMS.items()], record.alias("record")))


@query("b06_upsert", "with n as (select c_custkey + 750 as k, c_name as nm, case when c_custkey % 3 = 0 then null else c_acctbal end as bal from customer where c_custkey % 2 = 0) select coalesce(c.c_custkey, n.k) as id, coalesce(c.c_name, n.nm) as name, coalesce(n.bal, c.c_acctbal) as balance, c.c_custkey is null as created from customer c full join n on n.k = c.c_custkey")
def b06(spark, sf):
    """Sets what the new row knows, keeps what the stored row owns."""
    c = load(spark, sf, "customer")
    n = c.where("c_custkey % 2 = 0").select((F.col("c_custkey") + 750).alias("k"), F.col("c_name").alias("nm"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("bal"))
    return c.join(n, F.col("k") == F.col("c_custkey"), "full_outer").select(F.coalesce("c_custkey", "k").alias("id"), F.coalesce("c_name", "nm").alias("name"), F.coalesce("bal", "c_acctbal").alias("balance"), F.col("c_custkey").isNull().alias("created"))


@query("b08_capped_work_list", f"with {SQL_PAPERS}, w as (select id, year, row_number() over (partition by year order by id) as nth, count(*) over (partition by year) as waiting from papers where status = 'P') select year, id, greatest(0, waiting - 20) as capped from w where nth <= 20")
def b08(spark, sf):
    w = papers(spark, sf).where("status = 'P'")
    per = Window.partitionBy("year")
    return w.select("year", "id", F.row_number().over(per.orderBy("id")).alias("nth"), F.count(F.lit(1)).over(per).alias("n")).where("nth <= 20").select("year", "id", F.greatest(F.lit(0), F.col("n") - 20).alias("capped"))


@query("c02_screening", f"""with {SQL_PAPERS} select id, case when day is null then 'missing_date' when day not between date '1993-01-01' and date '1997-12-31' then 'outside_range' when status not in ('F', 'O') then 'other_type' when not regexp_matches(priority, '(?i)urgent|high|low') then 'no_topic' else 'candidate' end as reason,
 case when day between date '1993-01-01' and date '1997-12-31' and status in ('F', 'O') and regexp_matches(priority, '(?i)urgent|high|low') then case when regexp_matches(priority, '(?i)urgent') then 'title' else 'topic' end end as scope from papers""")
def c02(spark, sf):
    """The first rule that fails is the reason."""
    day, topic = F.col("day"), F.col("priority").rlike("(?i)urgent|high|low")
    reason = F.when(day.isNull(), "missing_date").when(~day.between("1993-01-01", "1997-12-31"), "outside_range").when(~F.col("status").isin("F", "O"), "other_type").when(~topic, "no_topic").otherwise("candidate")
    return papers(spark, sf).withColumn("reason", reason).select("id", "reason", F.when(F.col("reason") == "candidate", F.when(F.col("priority").rlike("(?i)urgent"), "title").otherwise("topic")).alias("scope"))


#: Labels of the tagging rule, each with its pattern.
TAGS = {"size": "large|small|medium|jumbo", "price": "economy|promo", "plain": "standard|small"}


@query("c03_multi_label_tags", "select p_partkey, coalesce(nullif(array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(lower(p_type), '{p}') then '{k}' end" for k, p in TAGS.items()) + "], lambda x: x is not null), ';'), ''), 'general') as tags from part")
def c03(spark, sf):
    found = F.array_compact(F.array(*[F.when(F.lower("p_type").rlike(p), k) for k, p in TAGS.items()]))
    return load(spark, sf, "part").select("p_partkey", F.when(F.size(found) > 0, F.array_join(found, ";")).otherwise("general").alias("tags"))


@query("c04_priority_lookup", "select c_custkey, coalesce(s.verdict, n.verdict, r.verdict, 'outside') as verdict from customer c left join nation nn on c.c_nationkey = n_nationkey left join (select distinct c_mktsegment as seg, 'segment' as verdict from customer where c_mktsegment = 'BUILDING') s on s.seg = c_mktsegment left join (select n_nationkey as k, 'nation' as verdict from nation where n_nationkey % 6 = 0) n on n.k = c_nationkey left join (select r_regionkey as k, 'region' as verdict from region where r_name like 'A%') r on r.k = nn.n_regionkey")
def c04(spark, sf):
    """Three lookups in order of trust; the small sides are broadcast when their size allows."""
    c, n, r = (load(spark, sf, t) for t in ("customer", "nation", "region"))
    one = n.where("n_nationkey % 6 = 0").select(F.col("n_nationkey").alias("k1"), F.lit("nation").alias("v1"))
    two = n.join(r.where("r_name like 'A%'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("k2"), F.lit("region").alias("v2"))
    j = c.join(one, F.col("c_nationkey") == F.col("k1"), "left").join(two, F.col("c_nationkey") == F.col("k2"), "left")
    return j.select("c_custkey", F.coalesce(F.when(F.col("c_mktsegment") == "BUILDING", "segment"), "v1", "v2", F.lit("outside")).alias("verdict"))


@query("c04_denied_prefix", "select p_brand as publisher, count(*) as parts, bool_or(d.deny is not null) as denied from part left join (values ('brand 1'), ('brand 25')) d(deny) on lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', ' ', 'g')) = d.deny or lower(regexp_replace(p_brand, '[^A-Za-z0-9]+', ' ', 'g')) like d.deny || ' %' or replace(lower(p_brand), '#', ' ') like d.deny || '%' group by 1")
def c04b(spark, sf):
    """A publisher is denied by its name or by a longer name that begins with it."""
    key = T.journal_key("p_brand")
    hit = reduce(lambda a, b: a | b, [(key == d) | key.startswith(d + " ") | F.replace(F.lower("p_brand"), F.lit("#"), F.lit(" ")).startswith(d) for d in ("brand 1", "brand 25")])
    return load(spark, sf, "part").groupBy(F.col("p_brand").alias("publisher")).agg(F.count(F.lit(1)).alias("parts"), F.bool_or(hit).alias("denied"))


@query("c05_eligible", "select o_orderkey, o_orderstatus = 'F' and o_totalprice > 1000 and (o_orderpriority like '1%' or o_orderpriority in ('2-HIGH', '5-LOW')) as eligible from orders")
def c05(spark, sf):
    p = F.col("o_orderpriority")
    return load(spark, sf, "orders").select("o_orderkey", ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000) & (p.startswith("1") | p.isin("2-HIGH", "5-LOW"))).alias("eligible"))


@query("c06_flat_records", "select o_orderkey as id, count(l_linenumber) as n_authors, coalesce(array_to_string(list_slice(list_sort(list(distinct l_suppkey) filter (l_suppkey is not null)), 1, 3), ';'), '') as authors, count(distinct l_suppkey) > 3 as truncated from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def c06(spark, sf):
    """Nested authorships flattened, capped, and marked when cut."""
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    l = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_suppkey")  # noqa: E741
    own = F.array_sort(F.collect_set("l_suppkey"))
    return o.join(l, "id", "left").groupBy("id").agg(F.count("l_linenumber").alias("n_authors"), F.array_join(F.transform(F.slice(own, 1, 3), lambda x: x.cast("string")), ";").alias("authors"), (F.size(own) > 3).alias("truncated"))


RAW_DOI = "case p_partkey % 5 when 0 then 'https://doi.org/10.' || (1000 + p_partkey) || '/AbC' || p_size when 1 then 'doi: 10.' || (1000 + p_partkey) || '/X(' || p_size || ')' when 2 then ' 10.12/short' when 3 then '10.' || (1000 + p_partkey) || '/q' || p_size || '/pdf' else null end"


@query("c07_identifiers", f"with r as (select p_partkey, {RAW_DOI} as raw from part), b as (select *, lower(regexp_replace(trim(raw), '(?i)^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '')) as bare from r) select p_partkey, case when regexp_matches(bare, '^10\\.[0-9]{{4,9}}/[^ ]+$') then bare end as doi, nullif(bare, '') as loose, regexp_replace(lower(coalesce(raw, '')), '[^0-9x]', '', 'g') as issn from b")
def c07(spark, sf):
    raw = F.expr(RAW_DOI)
    return load(spark, sf, "part").withColumn("raw", raw).select("p_partkey", T.doi("raw").alias("doi"), T.doi("raw", strict=False).alias("loose"), F.regexp_replace(F.lower(F.coalesce("raw", F.lit(""))), "[^0-9x]", "").alias("issn"))


@query("c08_repaired_doi", f"with r as (select p_partkey, {RAW_DOI} as raw from part), c as (select p_partkey, regexp_replace(raw, '(/(full|pdf|abstract|epdf))?[.,;]*$', '') as cut from r) select p_partkey, case when cut like '%)' and length(cut) - length(replace(cut, ')', '')) > length(cut) - length(replace(cut, '(', '')) then substr(cut, 1, length(cut) - 1) else cut end as doi, length(regexp_extract(cut, '/(.*)$', 1)) < 6 as truncated from c")
def c08(spark, sf):
    return load(spark, sf, "part").withColumn("raw", F.expr(RAW_DOI)).select("p_partkey", T.repaired_doi("raw").alias("doi"), (F.length(F.regexp_extract(F.regexp_replace("raw", r"(/(full|pdf|abstract|epdf))?[.,;]*$", ""), "/(.*)$", 1)) < 6).alias("truncated"))


@query("c09_failures", f"with {SQL_PAPERS} select id, 'note' as stage, status, priority as problem from papers where status is not null and status <> 'F' and segment = 'MACHINERY'")
def c09(spark, sf):
    return papers(spark, sf).where("status is not null and status <> 'F' and segment = 'MACHINERY'").select("id", F.lit("note").alias("stage"), "status", F.col("priority").alias("problem"))


@query("c10_notices_excluded", "select d.doc_id, d.source from documents d join labels l using (doc_id) where l.quality = 1 and not regexp_matches(d.text, '(?i)licensed under|released under') and d.lang in ('en', 'de')")
def c10(spark, sf):
    d = load(spark, sf, "documents").where(~F.col("text").rlike("(?i)licensed under|released under") & F.col("lang").isin("en", "de"))
    return d.join(load(spark, sf, "labels").where("quality = 1"), "doc_id").select("doc_id", "source")


@query("c14_cutoff", "select vec_id, case when vec_id % 7 = 0 then 'unscored' when embedding[2]::double >= 0.1 then 'pass' else 'below' end as state from embeddings")
def c14(spark, sf):
    """A missing score is never a zero."""
    p = F.when(F.col("vec_id") % 7 != 0, F.col("embedding")[1].cast("double"))
    return load(spark, sf, "embeddings").select("vec_id", F.when(p.isNull() | F.isnan(p), "unscored").when(p >= 0.1, "pass").otherwise("below").alias("state"))


@query("c16_reasons", f"with {SQL_PAPERS} select id, case when segment = 'AUTOMOBILE' then 'off_list' when status = 'P' then 'licence' when total is null then 'no_source' end as reason from papers")
def c16(spark, sf):
    return papers(spark, sf).select("id", F.when(F.col("segment") == "AUTOMOBILE", "off_list").when(F.col("status") == "P", "licence").when(F.col("total").isNull(), "no_source").alias("reason"))


@query("c19_source_choice", "with l as (select l_orderkey, list(case when l_returnflag <> 'R' then l_suppkey end order by l_linenumber, l_suppkey) as named, list(l_suppkey order by l_linenumber, l_suppkey) as every from lineitem group by 1), f as (select l_orderkey, list_filter(named, lambda x: x is not null) as named, every from l) select l_orderkey, coalesce(named[1], every[1]) as source, case when len(named) > 0 then 'location' else 'repository' end as basis from f")
def c19(spark, sf):
    """The first location that isn't a repository, else the repository, with the basis of the choice."""
    l = load(spark, sf, "lineitem")  # noqa: E741
    first = lambda c: F.min(F.when(c, F.struct("l_linenumber", "l_suppkey")))
    g = l.groupBy("l_orderkey").agg(first(F.col("l_returnflag") != "R").alias("a"), first(F.lit(True)).alias("b"))
    return g.select("l_orderkey", F.coalesce("a.l_suppkey", "b.l_suppkey").alias("source"), F.when(F.col("a").isNotNull(), "location").otherwise("repository").alias("basis"))


@query("c20_records_of_three_bases", "select 'p' || p_partkey as id, p_name as title, p_size as year, 'authority' as basis from part union all select 's' || s_suppkey, s_name, null, 'registry' from supplier union all select 'd' || doc_id, left(text, 20), null, 'document' from documents")
def c20(spark, sf):
    p = load(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("year"), F.lit("authority").alias("basis"))
    none = F.lit(None).cast("int").alias("year")
    s = load(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("title"), none, F.lit("registry").alias("basis"))
    d = load(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.left("text", F.lit(20)).alias("title"), none, F.lit("document").alias("basis"))
    return p.unionByName(s).unionByName(d)


@query("c21_citation_flags", "with c as (select l_orderkey as answer, l_partkey as cited, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as nth from lineitem) select answer, cited, p.p_partkey is not null as verified from c left join (select p_partkey from part where p_size > 10) p on p.p_partkey = cited where nth <= 5")
def c21(spark, sf):
    c = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("answer"), F.col("l_partkey").alias("cited"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).alias("nth")).where("nth <= 5")
    packet = load(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("cited"), F.lit(True).alias("in"))
    return c.join(packet, "cited", "left").select("answer", "cited", F.col("in").isNotNull().alias("verified"))


@query("c22_exclusion_reasons", "select l_orderkey, l_linenumber, array_to_string(list_filter([case when l_returnflag = 'R' then 'returned' end, case when l_discount > 0.08 then 'discount' end, case when l_quantity < 3 then 'small' end], lambda x: x is not null), ',') as reasons from lineitem")
def c22(spark, sf):
    why = F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", "returned"), F.when(F.col("l_discount") > 0.08, "discount"), F.when(F.col("l_quantity") < 3, "small")))
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(why, ",").alias("reasons"))


@query("d08_upsert_merge", "with s as (select s_suppkey as k, s_name as name, s_acctbal as bal, 'raw' || s_suppkey as raw from supplier where s_suppkey % 3 > 0), d as (select s_suppkey as k, case when s_suppkey % 4 > 0 then lower(s_name) end as name, null::double as bal, 'rawer' || s_suppkey as raw from supplier where s_suppkey % 5 > 0) select coalesce(d.k, s.k) as k, coalesce(d.name, s.name) as name, coalesce(d.bal, s.bal) as bal, case when length(coalesce(s.raw, '')) > length(coalesce(d.raw, '')) then s.raw else coalesce(d.raw, s.raw) end as raw from d full join s on d.k = s.k")
def d08(spark, sf):
    """New non-null values win; of two raw payloads the longer stays."""
    p = load(spark, sf, "supplier")
    s = p.where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n0"), F.col("s_acctbal").alias("b0"), F.concat(F.lit("raw"), "s_suppkey").alias("r0"))
    d = p.where("s_suppkey % 5 > 0").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 4 > 0, F.lower("s_name")).alias("n1"), F.concat(F.lit("rawer"), "s_suppkey").alias("r1"))
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    return d.join(s, "k", "full_outer").select("k", F.coalesce("n1", "n0").alias("name"), F.col("b0").alias("bal"), F.when(size("r0") > size("r1"), F.col("r0")).otherwise(F.coalesce("r1", "r0")).alias("raw"))


@query("d17_suffix_lookup", "select p_partkey, p_name from part where suffix(lower(p_name), 'widget') order by p_partkey limit 5")
def d17(spark, sf):
    return load(spark, sf, "part").where(F.lower("p_name").endswith("widget")).orderBy("p_partkey").limit(5).select("p_partkey", "p_name")


@query("d11_marker_join", "with c as (select l_partkey as cand, unnest(list_distinct(list('gap:' || (l_orderkey % 50)))) as marker from lineitem group by 1) select cand, count(*) as gaps from c where marker in ('gap:3', 'gap:7', 'gap:11') group by cand")
def d11(spark, sf):
    """Array membership made an equi-join: the markers are exploded first."""
    c = load(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("cand")).agg(F.collect_set(F.concat(F.lit("gap:"), F.col("l_orderkey") % 50)).alias("markers"))
    gaps = spark.createDataFrame([("gap:3",), ("gap:7",), ("gap:11",)], "marker string")
    return c.select("cand", F.explode("markers").alias("marker")).join(gaps, "marker", "left_semi").groupBy("cand").agg(F.count(F.lit(1)).alias("gaps"))


@query("d18_holder_kind", f"with {SQL_PAPERS}, h as (select cust, min(id) as holder from papers where status = 'F' group by 1) select p.id, case when h.holder is null then 'none' when h.holder = p.id then 'self' when p.status = 'P' then 'discovery' else 'noted' end as kind from papers p left join h on h.cust is not distinct from p.cust".replace("is not distinct from", "="))
def d18(spark, sf):
    p = papers(spark, sf)
    h = p.where("status = 'F'").groupBy("cust").agg(F.min("id").alias("holder"))
    return p.join(h, "cust", "left").select("id", F.when(F.col("holder").isNull(), "none").when(F.col("holder") == F.col("id"), "self").when(F.col("status") == "P", "discovery").otherwise("noted").alias("kind"))


@query("d19_known_categories", "select category from (select lang || '-' || source as category, count(*) as n from documents group by 1) where n >= 20 and category not in ('en-src1', 'en-src2') union select 'opened'")
def d19(spark, sf):
    big = load(spark, sf, "documents").groupBy(F.concat_ws("-", "lang", "source").alias("category")).agg(F.count(F.lit(1)).alias("n")).where("n >= 20").select("category")
    closed = spark.createDataFrame([("en-src1",), ("en-src2",)], "category string")
    return big.join(closed, "category", "left_anti").union(spark.createDataFrame([("opened",)], "category string")).distinct()


@query("d22_request_state", f"with {SQL_PAPERS}, r as (select cust as k, max(id) as req from papers where status = 'O' group by 1) select c_custkey, case when i.k is not null then 'indexed' when r.k is not null then 'requested' else 'new' end as state from customer left join (select distinct cust as k from papers where status = 'F') i on i.k = c_custkey left join r on r.k = c_custkey")
def d22(spark, sf):
    p = papers(spark, sf)
    i = p.where("status = 'F'").select(F.col("cust").alias("c_custkey"), F.lit(1).alias("i")).distinct()
    r = p.where("status = 'O'").select(F.col("cust").alias("c_custkey"), F.lit(1).alias("r")).distinct()
    return load(spark, sf, "customer").select("c_custkey").join(i, "c_custkey", "left").join(r, "c_custkey", "left").select("c_custkey", F.when(F.col("i") == 1, "indexed").when(F.col("r") == 1, "requested").otherwise("new").alias("state"))


@query("d24_fill_in", "select outcome, count(*) as n, count(filled) as with_id from (select case when p_partkey % 4 = 0 then 'already' when p_partkey % 3 = 0 then 'no_doi' when s.s_suppkey is null then 'not_found' else 'resolved' end as outcome, s.s_suppkey as filled from part left join supplier s on s.s_suppkey = p_partkey % 150) group by outcome")
def d24(spark, sf):
    j = load(spark, sf, "part").join(load(spark, sf, "supplier").select("s_suppkey"), F.col("s_suppkey") == F.col("p_partkey") % 150, "left")
    out = F.when(F.col("p_partkey") % 4 == 0, "already").when(F.col("p_partkey") % 3 == 0, "no_doi").when(F.col("s_suppkey").isNull(), "not_found").otherwise("resolved")
    return j.groupBy(out.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.count("s_suppkey").alias("with_id"))


@query("d25_missing_profiles", "select u.user_id, c.c_name as name, c.c_custkey is null as missing from (select distinct user_id from events) u left join (select * from customer where c_custkey % 3 > 0) c on c.c_custkey = u.user_id")
def d25(spark, sf):
    u = load(spark, sf, "events").select("user_id").distinct()
    c = load(spark, sf, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.lit(1).alias("c"))
    return u.join(c, "user_id", "left").select("user_id", "name", F.col("c").isNull().alias("missing"))


@query("d26_scope_targets", "with h as (select p_partkey as k, 0 as src, p_size::double as score from part where p_size in (1, 2) union all select l_partkey, 1, sum(l_quantity) from lineitem group by 1 having sum(l_quantity) >= 20), b as (select k, min((src, -score)) as best from h group by k), r as (select k, best[1] as src, row_number() over (order by best[1], best[2], k) as place from b) select * from r where place <= 200")
def d26(spark, sf):
    """Hints that exist first, then hits of a score that counts, each once, capped."""
    hint = load(spark, sf, "part").where("p_size in (1, 2)").select(F.col("p_partkey").alias("k"), F.lit(0).alias("src"), F.col("p_size").cast("double").alias("score"))
    hit = load(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.sum("l_quantity").alias("score")).where("score >= 20").select("k", F.lit(1).alias("src"), "score")
    best = hint.unionByName(hit).groupBy("k").agg(F.min(F.struct("src", (-F.col("score")).alias("low"))).alias("b"))
    top = best.select("k", "b.src", "b.low").orderBy("src", "low", "k").limit(200)
    return top.select("k", "src", F.row_number().over(Window.orderBy("src", "low", "k")).alias("place"))


@query("f09_page_of_ids", f"with {SQL_PAPERS}, t as (select id, count(*) over () as total from papers where segment = 'BUILDING' order by id limit 20 offset 40) select id, total from t")
def f09(spark, sf):
    p = papers(spark, sf).where("segment = 'BUILDING'")
    total = p.agg(F.count(F.lit(1)).alias("total"))
    return p.select("id").orderBy("id").offset(40).limit(20).join(F.broadcast(total))


@query("f14_most_cited_first", "select p_partkey, p_retailprice, p_size from part order by p_retailprice desc, p_size desc, p_partkey limit 30")
def f14(spark, sf):
    return load(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size").orderBy(F.desc("p_retailprice"), F.desc("p_size"), "p_partkey").limit(30)


@query("f07_hash_sample", "select doc_id, sha256('seed7:' || doc_id) as h from (select min(doc_id) as doc_id from documents group by text) order by h limit 40")
def f07(spark, sf):
    """A sample that stays the same: by hash of seed and id, each text once."""
    d = load(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("t")).agg(F.min("doc_id").alias("doc_id"))
    return d.select("doc_id", F.sha2(F.concat(F.lit("seed7:"), "doc_id"), 256).alias("h")).orderBy("h").limit(40)


@query("f11_stride_shards", "select c_custkey, (row_number() over (partition by c_nationkey order by c_custkey) - 1) % 4 as shard, (row_number() over (partition by c_nationkey order by c_custkey) - 1) // 10 as chunk from customer")
def f11(spark, sf):
    placed = packing.positions(load(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey")
    return placed.select("c_custkey", (F.col("at") % 4).alias("shard"), F.expr("at div 10").alias("chunk"))


@query("i09_inverted_to_text", "with t as (select conv_id, turn, unnest(string_split(text, ' ')) as token, generate_subscripts(string_split(text, ' '), 1) as pos from conversations where role = 'user') select conv_id, turn, string_agg(token, ' ' order by pos, token) as text from t group by all")
def i09(spark, sf):
    """token -> positions maps back to text."""
    c = load(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    inverted = c.groupBy("conv_id", "turn", "token").agg(F.collect_list("pos").alias("positions"))
    flat = inverted.select("conv_id", "turn", "token", F.explode("positions").alias("pos"))
    return flat.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("text"))


@query("i11_bibliography", "select l_orderkey, case when n > 5 then array_to_string(list_slice(a, 1, 3), ', ') || ', …, ' || array_to_string(list_slice(a, -2, -1), ', ') else array_to_string(a, ', ') end as authors from (select l_orderkey, list(l_suppkey order by l_linenumber, l_suppkey) as a, count(*) as n from lineitem group by 1)")
def i11(spark, sf):
    """Long author lists keep their first and last names."""
    g = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"].cast("string")).alias("a"))
    return g.select("l_orderkey", F.when(F.size("a") > 5, F.concat(F.array_join(F.slice("a", 1, 3), ", "), F.lit(", …, "), F.array_join(F.slice("a", -2, 2), ", "))).otherwise(F.array_join("a", ", ")).alias("authors"))


@query("i06_journal_keys", "select p_brand, p_type, regexp_replace(trim(regexp_replace(lower('The ' || p_brand || ', ' || p_type), '[^a-z0-9]+', ' ', 'g')), '^the ', '') as journal from part group by all")
def i06(spark, sf):
    return load(spark, sf, "part").select("p_brand", "p_type", T.journal_key(F.concat(F.lit("The "), "p_brand", F.lit(", "), "p_type")).alias("journal")).distinct()


@query("i08_canonical_digest", "select s_suppkey, sha256('name=' || s_name || chr(10) || 'nation=' || s_nationkey) as digest from supplier")
def i08(spark, sf):
    return load(spark, sf, "supplier").select("s_suppkey", T.canonical_digest(("nation", F.col("s_nationkey")), ("name", F.col("s_name"))).alias("digest"))


@query("i13_column_letters", "select n_nationkey, n_name, list_reduce(list_transform(string_split(left(upper(n_name), 3), ''), lambda x: ord(x) - 64), lambda a, b: a * 26 + b) as idx from nation where regexp_matches(left(n_name, 3), '^[A-Z]{3}$')")
def i13(spark, sf):
    return load(spark, sf, "nation").where(F.left("n_name", F.lit(3)).rlike("^[A-Z]{3}$")).select("n_nationkey", "n_name", T.column_letters_to_index(F.left("n_name", F.lit(3))).alias("idx"))


@query("i14_one_line", r"select conv_id, turn, case when length(s) > 40 then rtrim(substr(s, 1, 39)) || '…' else s end as line from (select conv_id, turn, trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) as s from conversations)")
def i14(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", T.one_line("text", 40).alias("line"))


MODEL_ID = "'eu.maker.' || case p_partkey % 4 when 0 then 'brand-' || lower(p_type) || '-' || p_size || '-' || (p_partkey % 9) || '-2025' when 1 then 'brand-' || lower(p_type) || '-' || p_size || ':0' when 2 then 'other-' || lower(p_type) || '-3' else p_brand end"


@query("i15_provenance", rf"with m as (select p_partkey, {MODEL_ID} as id from part) select p_partkey, case when regexp_matches(id, 'brand-[a-z]+-[0-9]+') then regexp_extract(id, 'brand-([a-z]+)-[0-9]+', 1) else id end as family, regexp_extract(id, 'brand-[a-z]+-([0-9]+)', 1) || case when regexp_matches(id, 'brand-[a-z]+-[0-9]+-[0-9]+') then '.' || regexp_extract(id, 'brand-[a-z]+-[0-9]+-([0-9]+)', 1) else '' end as version from m")
def i15(spark, sf):
    """Family and version of model ids of one maker; other ids are their own family without a version."""
    m = T.model_family(F.expr(MODEL_ID), "brand")
    return load(spark, sf, "part").select("p_partkey", m.alias("m")).select("p_partkey", "m.family", "m.version")


@query("i01_folded_words", f"select doc_id, len({T.SQL_TOKENS.format('text')}) as words, md5(regexp_replace({T.SQL_FOLD.format('text')}, '[^a-z0-9]+', '', 'g')) as squashed from documents")
def i01(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.size(T.tokens("text")).alias("words"), F.md5(T.squash("text")).alias("squashed"))
