"""Queries over what services and requests stand for: lookups that someone else answers, ranged reads, first pages, guards, waits, stores, actions.

The other side is a rule over the keys, so that the same rule in SQL gives what must come back.
"""

from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope import api
from folioscope.functions import guards
from folioscope.plans.registry import query
from folioscope.sources import connectors as C
from folioscope.sources import store as S
from folioscope.sources.tables import load


def _answers(keys: list[str]) -> list[tuple[str, dict]]:
    """Records of works by DOI: none for some, two for others."""
    out = []
    for k in keys:
        n = int(k.rpartition("p")[2])
        if n % 7:
            out.append((k, {"id": f"W{n}"}))
        if n % 10 == 0:
            out.append((k, {"id": f"W{n}x"}))
    return out


@query("a18_batch_get", "with k as (select distinct '10.5555/p' || (l_partkey) as key, l_partkey as n from lineitem) select key, case when n % 7 > 0 and n % 10 = 0 then 'ambiguous' when n % 7 > 0 or n % 10 = 0 then 'matched' else 'unmatched' end as state, case when n % 7 > 0 and n % 10 = 0 then '[{\"id\": \"W' || n || '\"}, {\"id\": \"W' || n || 'x\"}]' when n % 7 > 0 then '{\"id\": \"W' || n || '\"}' when n % 10 = 0 then '{\"id\": \"W' || n || 'x\"}' end as record from k")
def a18(spark, sf):
    """Each distinct key asked once, fifty at a time; several records of one key are kept as an ambiguity."""
    k = load(spark, sf, "lineitem").select(F.concat(F.lit("10.5555/p"), "l_partkey").alias("key"))
    return C.looked_up(k, "key", _answers, 50)


def _strict(keys: list[str]) -> list[tuple[str, dict]]:
    if any(int(k.rpartition("p")[2]) % 31 == 0 for k in keys):
        raise C.Rejected("bad key")
    return _answers(keys)


@query("a24_batched_lookup", "with k as (select p_partkey as n, case when p_partkey % 9 = 0 then 'x' || p_partkey else '10.5555/p' || p_partkey end as key from part) select key, case when n % 9 = 0 then 'invalid' when n % 31 = 0 then 'rejected' when n % 7 > 0 and n % 10 = 0 then 'ambiguous' when n % 7 > 0 or n % 10 = 0 then 'matched' else 'unmatched' end as state from k")
def a24(spark, sf):
    """Batches that are refused are halved until the bad key is alone; keys of no valid shape are never asked for."""
    k = load(spark, sf, "part").select(F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("x"), "p_partkey")).otherwise(F.concat(F.lit("10.5555/p"), "p_partkey")).alias("key"))
    return C.looked_up(k, "key", _strict, 200, r"^10\.[0-9]{4,9}/[^\s,]+$").select("key", "state")


@query("a13_ranged_reads", "select n_nationkey as key, 'member of ' || n_name as member, true as few from nation")
def a13(spark, sf):
    """One member of an archive read through a view that fetches blocks; ``few``: most of the archive was never fetched."""

    def run(frames):
        for f in frames:
            rows = []
            for k, n in zip(f["n_nationkey"], f["n_name"]):
                b = io.BytesIO()
                with zipfile.ZipFile(b, "w") as z:
                    z.writestr("padding", bytes(range(256)) * 4000)
                    z.writestr("member", f"member of {n}")
                raw = b.getvalue()
                view = C.Ranged(lambda a, e, raw=raw: raw[a:e], len(raw), 4096)
                with zipfile.ZipFile(view) as z:
                    text = z.read("member").decode()
                rows.append((k, text, view.requests * 10 < len(raw) // 4096))
            yield pd.DataFrame(rows, columns=["key", "member", "few"])

    return load(spark, sf, "nation").select("n_nationkey", "n_name").mapInPandas(run, "key long, member string, few boolean")


def _pdf(lines: list[str], flate: bool) -> bytes:
    """A file of two pages, the first of which shows the lines."""
    shown = "BT /F1 12 Tf 72 720 Td " + " T* ".join(f"[({a[:3]}) -20 ({a[3:]})] TJ" if i % 2 else f"({a}) Tj" for i, a in enumerate(x.replace("(", "\\(").replace(")", "\\)") for x in lines)) + " ET"
    data = zlib.compress(shown.encode("latin-1")) if flate else shown.encode("latin-1")
    stream = b"<< /Length %d %s>> stream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode " if flate else b"", data)
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 6 0 R] /Count 2 >>", b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>", stream, b"<< /Length 20 >> stream\nBT (second) Tj ET\nendstream", b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, x) for i, x in enumerate(bodies, 1)) + b"trailer << /Root 1 0 R >>"


@query("a19_first_pages", "select n_nationkey as key, case when n_nationkey % 5 <> 0 and n_nationkey % 7 <> 3 then n_name || ' (one)' || chr(10) || 'doi: 10.5555/' || n_nationkey end as text, case when n_nationkey % 5 = 0 then 'sha256_mismatch' when n_nationkey % 7 = 3 then 'no accessible first page' end as error from nation")
def a19(spark, sf):
    """The text of first pages, of files that have the hash that is stored for them."""

    def run(frames):
        for f in frames:
            made = [b"junk" if k % 7 == 3 else _pdf([f"{n} (one)", f"doi: 10.5555/{k}"], k % 2 == 0) for k, n in zip(f["n_nationkey"], f["n_name"])]
            yield pd.DataFrame({"key": f["n_nationkey"], "content": made})

    made = load(spark, sf, "nation").select("n_nationkey", "n_name").mapInPandas(run, "key long, content binary")
    stored = F.when(F.col("key") % 5 == 0, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.sha2("content", 256))
    return made.select("key", C.first_pages("content", stored).alias("p")).select("key", "p.text", "p.error")


KEY = "case doc_id % 12 when 0 then 'wiki/papers/' || doc_id || '.md' when 1 then 'wiki/a/b/' || doc_id || '.md' when 2 then 'wiki/drafts/' || doc_id || '.md' when 3 then 'wiki/a/failed/' || doc_id || '.md' when 4 then 'wiki/../' || doc_id || '.md' when 5 then 'wiki/' || doc_id || '.md' when 6 then 'wiki/a/' || doc_id || '.txt' when 7 then 'wiki//' || doc_id || '.md' when 8 then 'wiki/a b/' || doc_id || '.md' when 9 then 'other/a/' || doc_id || '.md' when 10 then 'wiki/a/' || repeat('x', 1100) || '.md' end"


@query("c15_guards", f"with g as (select doc_id, {KEY} as key, doc_id % 50 - 5 as start, n_chars * 3 as size, date '2024-01-01' as first, date '2024-01-01' + (doc_id % 90 - 10)::int as last from documents) select doc_id, case when key is null or doc_id % 12 > 1 then 'expected a published Markdown key under wiki/' end as key_problem, case when not (start >= 0 and size between 1 and 20000) then 'start must not be negative and size must be 1 to 20000' end as window_problem, case when last < first then 'the last day must not precede the first' when last - first >= 62 then 'a window covers at most 62 days' end as days_problem, case when last >= first and last - first < 62 then (last - first + 1)::int end as days from g")
def c15(spark, sf):
    """What is wrong with keys, windows and ranges of days."""
    g = load(spark, sf, "documents").select("doc_id", F.expr(KEY).alias("key"), (F.col("doc_id") % 50 - 5).alias("start"), (F.col("n_chars") * 3).alias("size"), F.lit("2024-01-01").cast("date").alias("first"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90 - 10).cast("int")).alias("last"))
    first, last = F.col("first"), F.col("last")
    return g.select("doc_id", guards.page_key_problem(F.col("key")).alias("key_problem"), guards.window_problem(F.col("start"), F.col("size")).alias("window_problem"), guards.days_problem(first, last).alias("days_problem"), F.size(guards.days(first, last)).alias("days"))


@query("i12_backoff", "with e as (select event_id, event_id % 8 - 1 as attempt, (event_id % 97) / 97.0 as chance, event_id % 40 as remaining, case when event_id % 3 = 0 then 30 when event_id % 3 = 1 then 1700000100 end as reset, case when event_id % 6 = 0 then event_id % 20 end as retry_after from events) select event_id, case when attempt >= 0 then round((chance * least(5.0, 0.2 * pow(2.0, attempt)))::double, 6) end as seconds, greatest(case when remaining <= 10 then 1700000000 + greatest(1, case when reset > 1000000000 then reset - 1700000000 else coalesce(reset, 60) end) + 2 end, case when retry_after is not null then 1700000000 + greatest(1, retry_after) end)::bigint as until from e")
def i12(spark, sf):
    """Pauses before retries, and the moment from which a service may be asked again."""
    e = load(spark, sf, "events").selectExpr("event_id", "event_id % 8 - 1 as attempt", "cast((event_id % 97) as double) / 97.0D as chance", "event_id % 40 as remaining", "case when event_id % 3 = 0 then 30L when event_id % 3 = 1 then 1700000100L end as reset", "case when event_id % 6 = 0 then event_id % 20 end as retry_after")
    return e.select("event_id", F.round(C.backoff(F.col("attempt"), F.col("chance")), 6).alias("seconds"), C.blocked_until(F.lit(1_700_000_000), F.col("remaining"), F.col("reset"), F.col("retry_after")).cast("long").alias("until"))


@query("k03_model_calls", "select doc_id as key, case when length(coalesce(text, '')) % 3 > 0 then 'label: ' || (length(coalesce(text, '')) % 3) end as reply, case when length(coalesce(text, '')) % 3 = 0 then 'unknown label' end as problem, case when length(coalesce(text, '')) % 3 = 0 then 2 else 1 end as calls from documents")
def k03(spark, sf):
    """A model asked with each text; a reply that doesn't pass the check is asked for once more. The model is a rule."""
    ask = lambda p: f"label: {len(p) % 3}"
    check = lambda r: "unknown label" if r.endswith(" 0") else None
    return C.called(load(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", ask, check)


@query("k04_actions", "select 'read' as action, doc_id::varchar as name, length(substr(text, 11, 300))::bigint as n from documents where doc_id = 3 union all select 'categories', lang, count(*) from documents group by lang union all select 'unknown', 'refused', 1 union all select 'arguments', 'refused', 1")
def k04(spark, sf):
    """Actions by name, with their arguments checked."""
    read = api.handle(spark, sf, {"action": "read", "doc_id": 3, "start": 10, "size": 300}).select(F.lit("read").alias("action"), F.col("doc_id").cast("string").alias("name"), F.length("part").cast("long").alias("n"))
    counts = api.handle(spark, sf, {"action": "categories"}).select(F.lit("categories").alias("action"), F.col("category").alias("name"), F.col("notes").alias("n"))
    refused = []
    for label, event in (("unknown", {"action": "drop"}), ("arguments", {"action": "read", "doc_id": 3, "size": 10**9})):
        try:
            api.handle(spark, sf, event)
        except api.BadRequest:
            refused.append((label, "refused", 1))
    return read.unionByName(counts).unionByName(spark.createDataFrame(refused, "action string, name string, n long"))


@query("k02_store", "select 'CUSTOMER' as pk, lpad(c_custkey::varchar, 9, '0') as sk, case when c_custkey = 2 then 2 else 1 end::bigint as revision, '{\"name\": \"' || case when c_custkey = 2 then 'changed' else c_name end || '\"}' as value from customer where c_custkey <> 3 union all select 'CUSTOMER', 'new', 1, '{\"name\": \"new\"}'")
def k02(spark, sf):
    """A table of items after batches of writes, one of which fails as a whole."""
    value = F.concat(F.lit('{"name": "'), "c_name", F.lit('"}')).alias("value")
    items: DataFrame = load(spark, sf, "customer").select(F.lit("CUSTOMER").alias("pk"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("sk"), F.lit(1).cast("long").alias("revision"), value)
    s = S.TableStore(spark, items)
    s.transact([("update", "CUSTOMER", "000000002", 1, {"name": "changed"}), ("delete", "CUSTOMER", "000000003", 1, None), ("check", "CUSTOMER", "000000004", 1, None)])
    try:
        s.transact([("create", "CUSTOMER", "lost", None, {}), ("update", "CUSTOMER", "000000002", 1, {"name": "stale"})])
    except S.Conflict:
        S.put(s, "CUSTOMER", "new", {"name": "new"})
    return s.table


@query("k01_injected_lookups", "select s_suppkey as id, case when s_suppkey % 7 > 0 and s_suppkey % 10 = 0 then 'ambiguous' when s_suppkey % 7 > 0 or s_suppkey % 10 = 0 then 'found' else 'searched' end as how from supplier")
def k01(spark, sf):
    """Suppliers resolved by a lookup that is passed in; what it doesn't find goes to a search that is passed in too."""
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("10.5555/p"), "s_suppkey").alias("key"))
    first = C.looked_up(s, "key", _answers, 50)
    rest = C.looked_up(first.where("state = 'unmatched'"), "key", lambda keys: [(k, {"q": k}) for k in keys], 10).select("key", F.lit("searched").alias("found"))
    return s.join(first, "key").join(rest, "key", "left").select("id", F.coalesce("found", F.when(F.col("state") == "matched", "found").otherwise(F.col("state"))).alias("how"))
