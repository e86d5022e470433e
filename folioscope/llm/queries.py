"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, langid, linededup, media, minhash, mixing, qualitycrf, qualityrules, runs, secretscan, sharding, toxicity, vectorcodes
from folioscope.llm.common import crc_mod, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.token_digests(docs, "text", public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return found.select("__row.doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
l as (select r, doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from d),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.r, k.doc_id, k.line, k.i, c.key is not null and k.doc_id <> c.keeper as gone from k left join c using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by r, doc_id
"""


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # The texts are read for their sizes only; the mixture is a list of copies in training order.
    copies = mixing.replicate(docs, "doc_id", "source", "text", alpha=0.5)
    slim = copies.select("__row.doc_id", "__row.source", "copy", "shuffle_key")
    return mixing.shuffled(slim)


OP2_SQL = """
with s as (select source, sum(octet_length(encode(coalesce(text, ''))) + 1) as size from documents group by source),
w as (select source, size, sqrt(size) as weight from s),
r as (select source, weight * (select sum(size) from w) / ((select sum(weight) from w) * size) as rate from w),
f as (select k, coalesce(sum(ln(k)) over (order by k), 0) as lf from generate_series(1, 400) as g(k)),
p as (select source, rate, 0 as k, exp(-rate) as p from r union all select source, rate, k, exp(k * ln(rate) - rate - lf) from r, f where k <= ceil(rate + 12 * sqrt(rate) + 40)),
c as (select source, k, sum(p) over (partition by source order by k) as c from p),
d as (select doc_id, source, ('0x' || substr(md5('42:' || coalesce(doc_id::varchar, '') || ':1'), 1, 13))::bigint / 4503599627370496.0 as u from documents),
n as (select d.doc_id, d.source, count(*) as n from d join c on d.source is not distinct from c.source and c.c <= d.u group by all),
e as (select doc_id, source, unnest(generate_series(1, n)) as copy from n)
select doc_id, source, copy, md5('order42:' || coalesce(doc_id::varchar, '') || ':' || copy) as shuffle_key from e
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = crc_mod("doc_id", 4)
    model = langid.train(docs.where(fold != 2), "doc_id", "text", "lang")
    return langid.identify(docs.select("doc_id", (fold == 2).alias("held_out"), "text"), "text", model)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualityrules.verdicts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id", "text", "source")


OP4_SQL = r"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
k as (select distinct on (doc_id, t, source) r as k, doc_id as kid, t as kt, source as ks from d),
ws as (select r, list_filter(string_split_regex(t, '[ \t\n\v\f\r]+'), lambda x: x <> '') as w from d),
w as (select r, unnest(w) as w, generate_subscripts(w, 1) as i from ws),
g as (select r, i, w as a, lead(w) over (partition by r order by i) as b, lead(w, 2) over (partition by r order by i) as c from w),
h as (select r, i, count(*) over (partition by r, a, b, c) as n from g where c is not null),
rep as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from h where n >= 2) group by r),
l as (select r, unnest(string_split(t, chr(10))) as line from d),
lw as (select r, line from l where regexp_matches(line, '[^ \t\n\v\f\r]')),
dup as (select r, count(*) - count(distinct line) as n from lw group by r),
nl as (select r, regexp_replace(lower(trim(regexp_replace(line, '[ \t\n\v\f\r]+', ' ', 'g'))), '[0-9]', '0', 'g') as line from lw),
held as (select ks, line, kid, kt, any_value(k) as k, sum(len(string_split(line, ' '))) as words from nl join k on nl.r = k.k group by ks, line, kid, kt),
often as (select ks, line from held group by ks, line having count(*) >= 10),
gone as (select held.kid, held.kt, held.ks, sum(words) as n from held join often on held.ks is not distinct from often.ks and held.line = often.line group by held.kid, held.kt, held.ks),
o as (select d.doc_id, len(ws.w) as n_words, coalesce(list_sum(list_transform(ws.w, lambda x: length(x))), 0)::bigint as word_chars,
 length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, coalesce(gone.n, 0)::bigint as n_boilerplate_words
 from d join ws using (r) left join dup using (r) left join rep using (r) left join gone on gone.kid is not distinct from d.doc_id and gone.kt = d.t and gone.ks is not distinct from d.source)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_words - n_boilerplate_words >= 0.5 * n_words as kept from o
"""


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.byte_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(crc_mod("doc_id", 3) != 1), "doc_id", "text", "toxic")
    found = toxicity.score(docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "text"), "text", model)
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 2, 80)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP8_SQL = r"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) end as g from d),
e as (select doc_id, len(g) as n, unnest(g) as g from s),
c as (select a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny, count(*) as i from e a join e b on a.g = b.g and a.doc_id < b.doc_id and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n group by all),
l as (select x, y from c where 100 * i >= 80 * (nx + ny - i)),
u as (select x, y from l union select y, x from l),
r(doc_id, reached) as (select doc_id, doc_id from documents union select r.doc_id, u.y from r join u on r.reached = u.x),
m as (select doc_id, min(reached) as component_id from r group by doc_id)
select s.doc_id, len(s.g) as n_shingles, m.component_id, s.doc_id = m.component_id as kept from s join m using (doc_id)
"""


def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    model = qualitycrf.train(docs, labels.where(crc_mod("doc_id", 3) != 1), "doc_id", "text", "quality")
    found = qualitycrf.score(docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "text"), "text", model)
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.with_label_errors(vectorcodes.encode(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"))


def _op11_sql() -> str:
    """Vectors of 64 components in 16 parts of 4, two rounds and a last assignment."""
    apart = " + ".join(f"(p.{c} - b.{c}) * (p.{c} - b.{c})" for c in "wxyz")
    steps = [
        "kept as (select row_number() over (order by vec_id, embedding) - 1 as r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings"
        " where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        "p as (select r, vec_id, label, part, v[4 * part + 1] as w, v[4 * part + 2] as x, v[4 * part + 3] as y, v[4 * part + 4] as z from kept, range(16) as parts(part))",
        "b0 as (select part, r as entry, w, x, y, z from p where r < 64)",
    ]
    for k in range(3):
        steps.append(f"a{k} as (select p.r, p.part, min(({apart}) * 64 + b.entry) as best from p join b{k} b on p.part = b.part group by p.r, p.part)")
        if k < 2:
            means = ", ".join(f"coalesce(floor(m.{c})::bigint, b.{c}) as {c}" for c in "wxyz")
            steps.append(f"m{k} as (select a.part, a.best % 64 as entry, {', '.join(f'sum({c}) / count(*) as {c}' for c in 'wxyz')} from a{k} a join p using (r, part) group by a.part, a.best % 64)")
            steps.append(f"b{k + 1} as (select b.part, b.entry, {means} from b{k} b left join m{k} m on b.part = m.part and b.entry = m.entry)")
    steps.append("c as (select r, string_agg(lpad(printf('%x', best % 64), 2, '0'), '' order by part) as code, sum(best // 64)::bigint as error from a2 group by r)")
    steps.append("g as (select sha256(string_agg(concat_ws(',', w, x, y, z), ',' order by part, entry)) as codebooks_sha256 from b2)")
    return f"with {', '.join(steps)} select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from kept join c using (r), g"


def op12_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secretscan.scan(docs, "text", secretscan.train(secretscan.labelled(docs, "text")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "__row.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secretscan.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), secretscan.written(F.col("spans")).alias("spans"),
    )


def _op12_sql() -> str:
    """The same rules, samples, counts and weights over rows of matches."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    pairs = "".join(secretscan.ALPHABET)
    steps = ["d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents)"]

    def matched(name: str, source: str, text: str, pattern: str) -> None:
        """Matches m after pieces p, with their starts, and the last piece of each row."""
        p = quote(pattern)
        steps.append(f"{name}l as (select r, {text} as t, regexp_extract_all({text}, {p}) as ms, string_split_regex({text}, {p}) as ps from {source})")
        steps.append(f"{name}u as (select r, unnest(ms) as m, unnest(ps[1:len(ms)]) as p, generate_subscripts(ms, 1) as i from {name}l where len(ms) > 0)")
        steps.append(f"{name} as (select *, (sum(length(p)) over w + coalesce(sum(length(m)) over (partition by r order by i rows between unbounded preceding and 1 preceding), 0))::bigint as start from {name}u window w as (partition by r order by i))")

    def blanked(name: str, before: str, taken: str) -> None:
        steps.append(f"{name} as (select l.r, case when len(l.ms) = 0 then l.t else (select string_agg(u.p || case when {taken} then repeat(' ', length(u.m)) else u.m end, '' order by u.i) from {before} u where u.r = l.r) || l.ps[-1] end as t from {before}l l)")

    valued = f"length(regexp_extract(m, {quote(secretscan.ASSIGN)}, 2)) >= 6"
    matched("a", "d", "t", secretscan.ASSIGN)
    matched("k", "d", "t", secretscan.ACCESS)
    matched("h", "d", "t", secretscan.HEX)
    blanked("r1", "a", valued)
    matched("b", "r1", "t", f"{secretscan.ACCESS}|{secretscan.HEX}")
    blanked("r2", "b", "true")
    matched("c", "r2", "t", secretscan.TOKEN)
    steps += [
        f"base as (select r, start, 0 as kind, start + length(m) as stop, regexp_extract(m, {quote(secretscan.ASSIGN)}, 2) as v from a where {valued} union all select r, start, 1, start + length(m), m from k union all select r, start, 2, start + length(m), m from h)",
        f"chosen as (select min(r) as r, any_value(t) as t, md5(t) as m from d where length(t) between 1 and {secretscan.LONGEST} group by md5(t) order by m limit {secretscan.SAMPLED})",
        "drawn as (select v as token from base join chosen using (r) union select sha256(t) from chosen union select base64(unhex(sha256(t))) from chosen)",
        f"words as (select distinct w as token from (select unnest(regexp_extract_all(r2.t, {quote(secretscan.WORD)})) as w from r2 join chosen using (r)) where regexp_matches(w, '[A-Za-z]'))",
        "samples as (select token, true as random from drawn union all select token, false from words)",
        "pairs as (select random, case when i = 1 then '' else token[i - 1] end as a, token[i] as b from (select random, token, unnest(generate_series(1, length(token))) as i from samples))",
        f"letters as (select unnest(string_split('{pairs}', '')) as x)",
        f"counts as (select random, a, b, count(*) as n from pairs where (a = '' or strpos('{pairs}', a) > 0) and strpos('{pairs}', b) > 0 group by all)",
        "grid as (select f.random, a.x as a, b.x as b from (values (true), (false)) f(random), (select x from letters union all select '') a, letters b)",
        f"smooth as (select g.random, g.a, g.b, ln((coalesce(n, 0) + 0.5::double) / (sum(coalesce(n, 0)) over (partition by g.random, g.a) + {0.5 * len(pairs)}::double)) as s from grid g left join counts c on g.random = c.random and g.a = c.a and g.b = c.b)",
        "weights as (select a, b, floor(1000 * (max(s) filter (random) - max(s) filter (not random)) + 0.5)::bigint as w from smooth group by a, b)",
        "tokens as (select distinct m as token from c where regexp_matches(m, '[A-Za-z]'))",
        "weighed as (select token, sum(w) as ratio from (select token, case when i = 1 then '' else token[i - 1] end as a, token[i] as b from (select token, unnest(generate_series(1, length(token))) as i from tokens)) join weights using (a, b) group by token)",
        "spans as (select r, start, kind, stop from base union all select r, start, 3, start + length(m) from c join weighed on m = token where ratio >= greatest(10000, 500 * length(m)))",
        "o as (select r, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,"
        " string_agg(concat_ws(':', (['assign', 'access', 'hex'])[kind + 1], start, stop), ',' order by start, kind) filter (kind < 3) as base, string_agg(concat_ws(':', (['assign', 'access', 'hex', 'markov'])[kind + 1], start, stop), ',' order by start, kind) as spans from spans group by r)",
    ]
    return f"with {', '.join(steps)} select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join o using (r)"


def replanted(doc_id: str, text: str) -> Column:
    """The text with its tail replaced by a repetition of words where the id's crc32 ends in 0; a null id changes nothing."""
    code = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    words = F.split(qualityrules.squeezed(F.coalesce(F.col(text), F.lit(""))), " ")
    g, n = F.floor(code / 10), F.size(words).cast("long")
    start = g % n
    period = 1 + F.floor((n - start) / (3 + g % 8))
    # Three parts of the words: as they were, whole periods, and what is left of one; concatenation looks no word up by number.
    head, body = F.slice(words, F.lit(1), start.cast("int")), F.slice(words, (start + 1).cast("int"), period.cast("int"))
    whole = F.flatten(F.array_repeat(body, F.floor((n - start) / period).cast("int")))
    new = F.array_join(F.concat(head, whole, F.slice(body, F.lit(1), ((n - start) % period).cast("int"))), " ")
    return F.when(code % 10 == 0, new).otherwise(F.col(text))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", replanted("doc_id", "text").alias("text"))
    found = runs.collapsed(docs, "text")
    longest = F.expr("reduce(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (a, b) -> if(a is null or b.length * a.period > a.length * b.period, b, a))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    exponent = F.expr("(1000 * r.length) div r.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "r.start", "r.length", "r.period", exponent, "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op10_line_dedup": op10_line_dedup,
    "op2_source_mixing": op2_source_mixing,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_byte_bpe": op5_byte_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_quality_crf": op9_quality_crf,
    "op6_byte_shards": op6_byte_shards,
    "op11_vector_codes": op11_vector_codes,
    "op12_secret_spans": op12_secret_spans,
    "op13_word_runs": op13_word_runs,
}

SQL: dict[str, str] = {"op10_line_dedup": OP10_SQL, "op2_source_mixing": OP2_SQL, "op4_quality_rules": OP4_SQL, "op8_minhash_near_dedup": OP8_SQL, "op11_vector_codes": _op11_sql(), "op12_secret_spans": _op12_sql()}
