"""Reports: counts, sums, percentiles, outcome tables, rounds and money over the event log and the sales tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.lineage import cut
from folioscope.operators import packing, ranks
from folioscope.plans.registry import query
from folioscope.sources.tables import SQL_JOBS, jobs, load

#: Outcomes that a report always lists, whether they occur or not.
OUTCOMES = ["click", "error", "purchase", "refund", "timeout"]
#: Prices per token in millionths of a dollar: first fragment of the model's name that fits decides.
PRICES = [("purch", "3.25"), ("p", "1.1"), ("c", "0.37"), ("", "0.05")]


def with_domain(counts: DataFrame, key: str, domain: list[str]) -> DataFrame:
    """Counts with a row for every value of a fixed domain; values outside it are summed as ``other``."""
    named = counts.groupBy(F.when(F.col(key).isin(domain), F.col(key)).otherwise("other").alias(key)).agg(F.sum("n").alias("n"))
    every = counts.sparkSession.createDataFrame([(x,) for x in [*domain, "other"]], f"{key} string")
    return every.join(named, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


@query("e01_category_type_counts", "select lang, count(*) filter (source in ('src0', 'src1')) as main, count(*) filter (source not in ('src0', 'src1')) as rest, count(*) as total from documents group by rollup(lang)")
def e01(spark, sf):
    d = load(spark, sf, "documents")
    main = F.col("source").isin("src0", "src1")
    return d.rollup("lang").agg(F.count_if(main).alias("main"), F.count_if(~main).alias("rest"), F.count(F.lit(1)).alias("total"))


@query("e02_frequencies", "select coalesce(q, 'unlabelled') as verdict, count(*) as n from (select case when doc_id in (select doc_id from labels) then (select max('q' || quality) from labels l where l.doc_id = d.doc_id) end as q from documents d) group by 1")
def e02(spark, sf):
    l = load(spark, sf, "labels").groupBy("doc_id").agg(F.max(F.concat(F.lit("q"), "quality")).alias("q"))  # noqa: E741
    return load(spark, sf, "documents").join(l, "doc_id", "left").groupBy(F.coalesce("q", F.lit("unlabelled")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("e03_sums_by_kind", f"with {SQL_JOBS} select kind, count(*) as items, round(sum(seconds), 2) as seconds, sum(tokens)::bigint as tokens, max(tokens) as most from jobs group by rollup(kind)")
def e03(spark, sf):
    return jobs(spark, sf).rollup("kind").agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("seconds"), 2).alias("seconds"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"))


@query("e04_cost_ledger", f"with {SQL_JOBS} select kind as step, count(*) as n, round(sum(tokens) * 25 / 1e6, 6) as usd, round(sum(seconds), 1) as seconds, sum(tokens)::bigint as tokens from jobs where seconds is not null group by rollup(kind)")
def e04(spark, sf):
    return jobs(spark, sf).where("seconds is not null").rollup(F.col("kind").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("tokens") * 25 / 1e6, 6).alias("usd"), F.round(F.sum("seconds"), 1).alias("seconds"), F.sum("tokens").alias("tokens"))


@query("e05_top_reasons", "with r as (select case when len(w) = 0 then ['(none)'] else w end as w from (select list_filter([case when l_discount > 0.05 then 'd' || l_linenumber end, case when l_tax > 0.05 then 't' || l_linenumber end, case when l_returnflag = 'R' then 'r' || l_linenumber end], lambda x: x is not null) as w from lineitem)), c as (select unnest(w) as reason, count(*) as n from r group by 1), k as (select *, row_number() over (order by n desc, reason) as nth from c) select case when nth <= 12 then reason else '(others)' end as reason, sum(n)::bigint as n, count(*) as reasons from k group by 1")
def e05(spark, sf):
    """The commonest reasons, and how many reasons and occurrences are left out."""
    l = load(spark, sf, "lineitem")  # noqa: E741
    tag = lambda cond, ch: F.when(cond, F.concat(F.lit(ch), F.col("l_linenumber")))
    why = F.array_compact(F.array(tag(F.col("l_discount") > 0.05, "d"), tag(F.col("l_tax") > 0.05, "t"), tag(F.col("l_returnflag") == "R", "r")))
    c = l.select(F.explode(F.when(F.size(why) > 0, why).otherwise(F.array(F.lit("(none)")))).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    k = c.withColumn("nth", F.row_number().over(Window.orderBy(F.desc("n"), "reason")))  # one row for each reason
    return k.groupBy(F.when(F.col("nth") <= 12, F.col("reason")).otherwise("(others)").alias("reason")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("reasons"))


@query("e13_latency", f"with {SQL_JOBS} select kind, count(*) as n, percentile_disc(0.5) within group (order by seconds) as p50, percentile_disc(0.95) within group (order by seconds) as p95, max(seconds) as longest from jobs group by kind")
def e13(spark, sf):
    j = jobs(spark, sf)
    ranked = ranks.nearest_ranks(j, ["kind"], "seconds", {"p50": 50, "p95": 95})
    n = j.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("seconds").alias("longest"))
    r = ranked.withColumnRenamed("kind", "k")
    return n.join(r, F.col("kind").eqNullSafe(F.col("k")), "left").select("kind", "n", "p50", "p95", "longest")


@query("e23_session_load", f"with {SQL_JOBS}, s as (select *, case when row_number() over (partition by member_id order by moment, job_id) = 1 then 'first' else 'later' end as position from jobs) select position, kind, count(*) as n, percentile_disc(0.95) within group (order by seconds) as p95, count(*) filter (kind = 'error') as errors from s group by all")
def e23(spark, sf):
    """Latency and errors of first and later calls of a session."""
    first = F.row_number().over(Window.partitionBy("member_id").orderBy("moment", "job_id")) == 1
    s = jobs(spark, sf).withColumn("position", F.when(first, "first").otherwise("later"))
    s = cut(s.select("position", "kind", "seconds"))
    n = s.groupBy("position", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "error").alias("errors"))
    r = ranks.nearest_ranks(s, ["position", "kind"], "seconds", {"p95": 95}).withColumnsRenamed({"position": "p", "kind": "k"})
    return n.join(r, F.col("position").eqNullSafe(F.col("p")) & F.col("kind").eqNullSafe(F.col("k")), "left").select("position", "kind", "n", "p95", "errors")


@query("e14_outcome_domain", f"with {SQL_JOBS}, c as (select case when kind in {tuple(OUTCOMES)} then kind else 'other' end as kind, count(*) as n from jobs group by 1) select k as kind, coalesce(n, 0) as n from (select unnest({[*OUTCOMES, 'other']}) as k) left join c on c.kind = k")
def e14(spark, sf):
    return with_domain(jobs(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind", OUTCOMES)


@query("e15_upper_median", f"with {SQL_JOBS}, o as (select member_id, seconds, row_number() over (partition by member_id order by seconds) - 1 as i, count(*) over (partition by member_id) as n from jobs where seconds is not null) select member_id, seconds as median from o where i = n // 2")
def e15(spark, sf):
    """The element at n div 2: for even n not a nearest rank."""
    w = Window.partitionBy("member_id")
    o = jobs(spark, sf).where("seconds is not null").select("member_id", "seconds", (F.row_number().over(w.orderBy("seconds")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    return o.where("i = n div 2").select("member_id", F.col("seconds").alias("median"))


@query("e16_campaign_progress", "with d as (select source, doc_id, doc_id in (select doc_id from labels) as done, doc_id % 5 = 0 as claimed from documents) select source, count(*) filter (done) as completed, count(*) filter (not done and claimed) as claimed, count(*) filter (not done and not claimed) as not_started, array_to_string(list_slice(list_sort(list(doc_id) filter (done), 'DESC'), 1, 5), ',') as recent from d group by source")
def e16(spark, sf):
    l = load(spark, sf, "labels").select("doc_id", F.lit(True).alias("l")).distinct()  # noqa: E741
    d = load(spark, sf, "documents").join(l, "doc_id", "left").select("source", "doc_id", F.col("l").isNotNull().alias("done"), (F.col("doc_id") % 5 == 0).alias("claimed"))
    top = d.where("done").withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id")))).where("nth <= 5").groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id"), asc=False), lambda x: x.cast("string")), ",").alias("recent"))
    n = d.groupBy("source").agg(F.count_if("done").alias("completed"), F.count_if(~F.col("done") & F.col("claimed")).alias("claimed"), F.count_if(~F.col("done") & ~F.col("claimed")).alias("not_started"))
    return n.join(top, "source", "left")


@query("e19_page_metrics", r"select doc_id, length(text) as chars, len(list_distinct(regexp_extract_all(text, '[0-9]+(\.[0-9]+)?'))) as numbers, len(list_distinct(regexp_extract_all(text, '[A-Z]{2,}'))) as symbols from documents")
def e19(spark, sf):
    distinct = lambda p: F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(p), F.lit(0))))
    return load(spark, sf, "documents").select("doc_id", F.length("text").alias("chars"), distinct(r"[0-9]+(\.[0-9]+)?").alias("numbers"), distinct("[A-Z]{2,}").alias("symbols"))


def price() -> Column:
    """The price of the first fragment that the name holds."""
    out = F.when(F.contains(F.col("kind"), F.lit(PRICES[0][0])), F.lit(PRICES[0][1]))
    for fragment, p in PRICES[1:]:
        out = out.when(F.contains(F.col("kind"), F.lit(fragment)), F.lit(p))
    return out.cast("decimal(9,4)")


PRICE_SQL = "(case " + " ".join(f"when contains(kind, '{f}') then {p}" for f, p in PRICES) + " end)::decimal(9,4)"


@query("e20_exact_micros", f"with {SQL_JOBS} select kind, sum(ceil(tokens * {PRICE_SQL}))::bigint as micros, round(sum(tokens * {PRICE_SQL})::double / 1e6, 5) as usd from jobs group by kind")
def e20(spark, sf):
    """Money in whole millionths, each line rounded up; decimals, never doubles."""
    cost = F.col("tokens").cast("decimal(18,0)") * price()
    return jobs(spark, sf).groupBy("kind").agg(F.sum(F.ceil(cost)).cast("bigint").alias("micros"), F.round(F.sum(cost).cast("double") / 1e6, 5).alias("usd"))


@query("e21_refusals", "select o_orderpriority as reason, count(*) as n, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as refused from orders join customer on c_custkey = o_custkey where o_orderstatus = 'P' group by 1")
def e21(spark, sf):
    o = load(spark, sf, "orders").where("o_orderstatus = 'P'").join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return o.groupBy(F.col("o_orderpriority").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("refused"))


@query("e22_gap_outcomes", "select l_suppkey as gap, count(*) filter (l_returnflag = 'A') as saved, count(*) filter (l_returnflag = 'N') as skipped, count(*) filter (l_returnflag = 'R') as errors from lineitem group by 1")
def e22(spark, sf):
    n = lambda x: F.count_if(F.col("l_returnflag") == x)
    return load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("gap")).agg(n("A").alias("saved"), n("N").alias("skipped"), n("R").alias("errors"))


@query("e25_usage_shares", f"with {SQL_JOBS} select member_id, count(*) as calls, sum(tokens)::bigint as tokens, count(*) filter (kind = 'error') as fallback, count(*) filter (kind = 'click') as declined, sum(case when kind = 'error' then tokens else 0 end)::bigint as fallback_tokens from jobs group by 1")
def e25(spark, sf):
    k = F.col("kind")
    return jobs(spark, sf).groupBy("member_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.count_if(k == "error").alias("fallback"), F.count_if(k == "click").alias("declined"), F.sum(F.when(k == "error", F.col("tokens")).otherwise(0)).alias("fallback_tokens"))


@query("e26_capped_per_tag", "with t as (select p_partkey, p_retailprice, unnest(string_split(p_name, ' ')) as tag from part), r as (select *, row_number() over (partition by tag order by p_retailprice desc, p_partkey) as nth from t) select tag, p_partkey, nth from r where nth <= 20")
def e26(spark, sf):
    t = load(spark, sf, "part").select("p_partkey", "p_retailprice", F.explode(F.split("p_name", " ")).alias("tag"))
    return t.withColumn("nth", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("p_retailprice"), "p_partkey"))).where("nth <= 20").select("tag", "p_partkey", "nth")


@query("f05_latest_per_key", f"with {SQL_JOBS}, r as (select *, row_number() over (partition by member_id order by moment desc, job_id desc) as nth from jobs) select member_id, job_id, kind, moment from r where nth = 1")
def f05(spark, sf):
    g = jobs(spark, sf).groupBy("member_id").agg(F.max_by(F.struct("job_id", "kind", "moment"), F.struct("moment", "job_id")).alias("l"))
    return g.select("member_id", "l.job_id", "l.kind", "l.moment")


@query("f06_samples_per_group", f"with {SQL_JOBS}, r as (select kind, job_id, row_number() over (partition by kind order by job_id) as nth, count(*) over (partition by kind) as n from jobs) select kind, job_id, nth, n from r where nth <= 3")
def f06(spark, sf):
    j = jobs(spark, sf)
    top = j.select("kind", "job_id", F.row_number().over(Window.partitionBy("kind").orderBy("job_id")).alias("nth")).where("nth <= 3")
    return top.join(j.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind")


@query("f13_smallest_first", """with f as (select doc_id // 50 as stem, doc_id, n_chars, case when text is null or trim(text) = '' then 'no text' when n_chars > 6000 then 'too large' end as skipped, len(regexp_extract_all(coalesce(text, ''), 'the|der|les|los')) as hits from documents),
r as (select *, coalesce(sum(hits) filter (skipped is null) over (partition by stem order by n_chars, doc_id rows between unbounded preceding and 1 preceding), 0) as before, row_number() over (partition by stem order by n_chars, doc_id) as place from f)
select stem, place, doc_id, case when skipped is not null then skipped when before >= 300 then 'not reached' else 'searched' end as state, case when skipped is null and before < 300 then least(hits, 300 - before) else 0 end::bigint as matches from r""")
def f13(spark, sf):
    """The files of each stem, smallest first, until enough matches are found: what was searched, skipped or not reached."""
    hits = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("the|der|les|los"), F.lit(0)))
    skipped = F.when(F.col("text").isNull() | (F.trim("text") == ""), "no text").when(F.col("n_chars") > 6000, "too large")
    f = load(spark, sf, "documents").select(F.expr("doc_id div 50").alias("stem"), "doc_id", "n_chars", skipped.alias("skipped"), hits.alias("hits"))
    return packing.searched(f, 300).select("stem", "place", "doc_id", "state", "matches")


@query("f16_detail_slice", "select doc_id, string_split(text, chr(10))[2] as line, len(string_split(text, chr(10))) as lines from documents where len(string_split(text, chr(10))) >= 2")
def f16(spark, sf):
    d = load(spark, sf, "documents").withColumn("l", F.split("text", "\n"))
    return d.where(F.size("l") >= 2).select("doc_id", F.element_at("l", 2).alias("line"), F.size("l").alias("lines"))


@query("j09_daily_windows", f"with {SQL_JOBS} select date_trunc('day', moment) as day, kind, count(*) as n, round(sum(seconds), 2) as seconds from jobs group by all")
def j09(spark, sf):
    g = jobs(spark, sf).groupBy(F.window("moment", "1 day").alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds"), 2).alias("seconds"))
    return g.select(F.col("w.start").alias("day"), "kind", "n", "seconds")


@query("b15_request_log", f"with {SQL_JOBS} select job_id, moment, kind, round((tokens * 5 + tokens * 25) / 1e6, 6) as usd from jobs where moment >= timestamp '2024-01-20' order by moment desc, job_id desc limit 50")
def b15(spark, sf):
    return jobs(spark, sf).where("moment >= timestamp_ntz '2024-01-20'").orderBy(F.desc("moment"), F.desc("job_id")).limit(50).select("job_id", "moment", "kind", F.round((F.col("tokens") * 5 + F.col("tokens") * 25) / 1e6, 6).alias("usd"))
