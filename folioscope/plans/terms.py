"""Term queries: glossaries, aliases, symbols, mentions, and the figures and tables that papers refer to.

Every line of a document is a line of its note's glossary: the first words are the term, in one of four shapes, the line is its definition.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.lineage import cut
from folioscope.operators import assets as A
from folioscope.operators import mentions as M
from folioscope.operators import terms as G
from folioscope.plans.registry import query
from folioscope.sizes import parted, spread
from folioscope.sources.tables import load

#: A line with its words w1, w2, w3 as a line of a glossary; n is its place in the document.  {0} is where the names are found.
ENTRY = """case {0}n % 4 when 0 then '- **' || {0}w1 || ' (' || {0}w2 || ')**: about ' || {0}line when 1 then ' * **' || {0}w2 || ' / ' || {0}w3 || '** ： other ' || {0}line
 when 2 then '-  **' || upper(left({0}w3, 3)) || 's vs ' || {0}w1 || '**:third ' || {0}line else '- **' || {0}w1 || '–' || {0}w2 || ' / β' || {0}w3 || ' (αγ' || {0}w3 || ')**: ' || {0}line end"""
NOTE = "'# Note' || chr(10) || '## ' || case when doc_id % 2 = 0 then '7. Glossary' else 'Glossary' end || chr(10) || lines || chr(10) || '## End' || chr(10) || '- **no**: no'"
SQL_GLOSS = rf"""w0 as (select doc_id, lang, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents),
w as (select doc_id, lang, n, line, regexp_extract_all(line, '[A-Za-z]+') as w from w0), e as (select doc_id, lang, n, line, w[1] as w1, w[2] as w2, w[3] as w3 from w where len(w) >= 3),
t as (select doc_id, lang, {NOTE.replace('lines', f'string_agg({ENTRY.format('')}, chr(10) order by n)')} as text from e group by doc_id, lang), s as (select doc_id, lang, regexp_extract(text, '(?:^|\n)## (?:7\. )?Glossary[ \t]*\n((?s).*?)(?:\n## |$)', 1) as sec from t),
g as (select doc_id, lang, trim(unnest(regexp_extract_all(sec, '(?m)^[ \t]*[-*][ \t]+\*\*(.+?)\*\*[ \t]*[:：][ \t]*(.*)$', 1))) as term, trim(unnest(regexp_extract_all(sec, '(?m)^[ \t]*[-*][ \t]+\*\*(.+?)\*\*[ \t]*[:：][ \t]*(.*)$', 2))) as definition from s)"""
GREEK_SQL = "lower(form)"
for _letter, _plain in G.GREEK.items():
    GREEK_SQL = f"replace({GREEK_SQL}, '{_letter}', '{_plain}')"
SQL_FORMS = SQL_GLOSS + rf""", f0 as (select row_number() over () as rn, doc_id, lang, definition, regexp_split_to_array(regexp_split_to_array(term, '\s+versus\s+|\s+vs\.?\s+')[1], '\s+/\s+') as p from g),
f1 as (select rn, doc_id, lang, definition, trim(trim(trim(unnest(p)), ',;')) as p from f0),
f2 as (select distinct rn, doc_id, lang, definition, unnest(case when regexp_matches(p, '^(.*?\S)\s*\(([^()]{{1,60}})\)\s*$') then [regexp_extract(p, '^(.*?\S)\s*\(([^()]{{1,60}})\)\s*$', 1), trim(regexp_extract(p, '^(.*?\S)\s*\(([^()]{{1,60}})\)\s*$', 2))] else [p] end) as form from f1),
f3 as (select *, trim(regexp_replace(regexp_replace(regexp_replace({GREEK_SQL}, '[‐‑–—]', '-', 'g'), '[^a-z0-9+.\- ]+', ' ', 'g'), ' +', ' ', 'g'), ' .-') as low, regexp_extract(trim(form), '\S*$') as last from f2 where length(form) >= 2),
f as (select doc_id, lang, definition, form, case when low like '%s' and (regexp_matches(last, '^[A-Z][A-Za-z0-9-]*[A-Z0-9]s$') or (length(regexp_extract(low, '[^ ]*$')) > 4 and not regexp_matches(low, '(ss|us|is)$'))) then left(low, -1) else low end as slug from f3)"""


#: The first three words of a line.
WORDS = "^[^A-Za-z]*([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)[^A-Za-z]+([A-Za-z]+)"


def gloss(spark, sf):
    """The glossaries of notes.  A note is made where its document lies; texts are shuffled only where documents share an id, of which one note is made."""
    alone, shared = parted(load(spark, sf, "documents").select("doc_id", "lang", "text").where("text is not null"), "doc_id", "lang")
    d = alone.select("doc_id", "lang", F.array("text").alias("texts")).unionByName(shared.groupBy("doc_id", "lang").agg(F.collect_list("text").alias("texts")))
    word = lambda line, k: F.regexp_extract(line, WORDS, k).alias(f"w{k}")
    lines = F.flatten(F.transform("texts", lambda t: F.transform(F.split(t, "\n"), lambda line, n: F.struct(n.alias("n"), line.alias("line"), *[word(line, k) for k in (1, 2, 3)]))))
    e = d.select("doc_id", "lang", F.size("texts").alias("of"), lines.alias("e")).select("doc_id", "lang", F.when(F.col("of") > 1, F.sort_array("e")).otherwise(F.col("e")).alias("e"))
    e = e.select("doc_id", "lang", F.expr(f"array_join(transform(filter(e, x -> x.w3 <> ''), x -> {ENTRY.format('x.')}), '\n')").alias("lines"))
    return G.glossary(e.select("doc_id", "lang", F.expr(NOTE).alias("text")))


def forms(spark, sf):
    g = gloss(spark, sf).select("doc_id", "lang", "definition", F.explode(G.aliases(F.col("term"))).alias("form"))
    return g.withColumn("slug", G.normal(F.col("form")))


@query("h09_glossary", f"with {SQL_GLOSS} select doc_id, term, definition from g")
def h09(spark, sf):
    return gloss(spark, sf).select("doc_id", "term", "definition")


@query("h10_aliases", f"with {SQL_FORMS} select distinct doc_id, definition, form, slug from f")
def h10(spark, sf):
    return forms(spark, sf).select("doc_id", "definition", "form", "slug").distinct()


SYMBOLS = "sym as (select upper(left(p_name, 4)) || (p_partkey % 300) as symbol, case when p_partkey % 3 = 0 then upper(left(p_name, 4)) || (p_partkey % 300 + 1) when p_partkey % 3 = 1 then upper(left(p_name, 3)) || (p_partkey % 40) end as alias from part)"
SYM_OK = SYMBOLS + ", own as (select distinct upper(symbol) as key, symbol from sym), cl as (select upper(alias) as key, min(symbol) as symbol from sym where alias is not null group by 1 having min(symbol) = max(symbol)), tab as (select * from own union all select * from cl where key not in (select key from own))"


@query("a08_unambiguous_aliases", f"with {SYM_OK} select key, symbol from tab")
def a08(spark, sf):
    return G.resolved_symbols(symbols(spark, sf))


def symbols(spark, sf):
    return load(spark, sf, "part").select(F.expr("upper(left(p_name, 4)) || (p_partkey % 300)").alias("symbol"), F.expr("case when p_partkey % 3 = 0 then upper(left(p_name, 4)) || (p_partkey % 300 + 1) when p_partkey % 3 = 1 then upper(left(p_name, 3)) || (p_partkey % 40) end").alias("alias"))


@query("h11_symbol_lookup", f"with {SYM_OK} select s_suppkey, coalesce(a.symbol, b.symbol) as symbol from supplier left join tab a on a.key = 'BLUE' || (s_suppkey * 3) left join tab b on b.key = 'RED' || s_suppkey where 'BLUE' || (s_suppkey * 3) not in ('BLUE9', 'BLUE30')")
def h11(spark, sf):
    """A term's key, else a shorter key, in the table of symbols; blocked keys never resolve."""
    t = G.resolved_symbols(symbols(spark, sf))
    s = load(spark, sf, "supplier").select("s_suppkey", F.expr("'BLUE' || (s_suppkey * 3)").alias("k1"), F.expr("'RED' || s_suppkey").alias("k2")).where("k1 not in ('BLUE9', 'BLUE30')")
    return s.join(t.select(F.col("key").alias("k1"), F.col("symbol").alias("a")), "k1", "left").join(t.select(F.col("key").alias("k2"), F.col("symbol").alias("b")), "k2", "left").select("s_suppkey", F.coalesce("a", "b").alias("symbol"))


CAND = ", t0 as (select slug, doc_id as stem, lang = 'en' as scope, form, definition from f)"


@query("e11_candidates", f"with {SQL_FORMS}{CAND}, nn as (select slug, count(distinct stem) as notes, count(distinct case when scope then stem end) as in_scope from t0 group by 1 having count(distinct case when scope then stem end) >= 3), c as (select slug, form, row_number() over (partition by slug order by count(*) desc, length(form) desc, form) as nth from t0 group by slug, form), o as (select slug, stem, min(definition) as d from t0 group by all), p as (select slug, stem, d, row_number() over (partition by slug order by stem) as nth from o), d as (select slug, string_agg(d, ' | ' order by stem, d) as definitions from p where nth <= 2 group by 1) select nn.slug, notes, in_scope, c.form as title, definitions from nn join c on c.slug = nn.slug and c.nth = 1 join d on d.slug = nn.slug")
def e11(spark, sf):
    t = forms(spark, sf).select("slug", F.col("doc_id").alias("stem"), (F.col("lang") == "en").alias("scope"), "form", "definition")
    return G.candidates(t, 3)


@query("e12_merged_counts", f"with {SQL_FORMS}, m as (select slug, left(slug, 2) as target from (select distinct slug from f) where length(slug) = 3) select coalesce(target, slug) as slug, count(distinct doc_id) as notes, count(distinct form) as forms from f left join m using (slug) group by 1")
def e12(spark, sf):
    # Written once: the merge map is made of the same forms.
    f = cut(forms(spark, sf).select("slug", F.col("doc_id").alias("stem"), "form"))
    m = f.select("slug").distinct().where("length(slug) = 3").withColumn("target", F.left("slug", F.lit(2)))
    return G.folded(f, m)


@query("g04_safe_merges", "with m as (select p_partkey as a, p_partkey + 7 as b from part where p_partkey % 11 = 0) select a, b, case when y.p_partkey is null then 'missing' when x.p_type = 'SMALL' or y.p_type = 'SMALL' then 'gene' when len(list_intersect(string_split(x.p_name, ' '), string_split(y.p_name, ' '))) = 0 then 'no shared name' else 'accepted' end as outcome from m join part x on x.p_partkey = a left join part y on y.p_partkey = b")
def g04(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    m = p.where("p_partkey % 11 = 0").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 7).alias("b"), F.split("p_name", " ").alias("na"), F.col("p_type").alias("ta"))
    j = m.join(p.select(F.col("p_partkey").alias("b"), F.split("p_name", " ").alias("nb"), F.col("p_type").alias("tb")), "b", "left")
    return j.select("a", "b", F.when(F.col("nb").isNull(), "missing").when((F.col("ta") == "SMALL") | (F.col("tb") == "SMALL"), "gene").when(~F.arrays_overlap("na", "nb"), "no shared name").otherwise("accepted").alias("outcome"))


#: Each item is a term of two words with a plural and an alias of three capitals, every third one a gene that is written as its forms are.
FORMS = """select item_id as slug, case when item_id % 3 = 0 then 'gene' else 'term' end as kind, {0} as form from w where len(w) >= 2"""
SHAPES = ["w[1] || ' ' || w[2]", "w[1]", "upper(left(w[2], 3))", "w[2]"]


#: A part is a candidate with a title of two words and two aliases, and every even one is to be merged into the seventh after it.
MERGE_FORMS = ["p_name", "upper(p_name) || 's'", "p_type || ' ' || p_brand", "upper(left(p_type, 3))"]


@query("g04_accepted_merges", f"""with f as (select p_partkey as slug, p_type as kind, unnest([{', '.join(MERGE_FORMS)}]) as form from part), n as (select slug, list(distinct lower(regexp_replace(regexp_replace(trim(form), '[^A-Za-z0-9+.\\- ]+', ' ', 'g'), 's$', ''))) filter (contains(trim(form), ' ')) as names from f group by slug),
m as (select p_partkey as source, p_partkey + 7 as target from part where p_partkey % 2 = 0) select source, target, case when b.slug is null then '{G.UNKNOWN}' when x.p_type = 'SMALL' or y.p_type = 'SMALL' then '{G.GENE}' when len(list_intersect(a.names, b.names)) = 0 then '{G.UNSHARED}' end as reason
 from m join n a on a.slug = source join part x on x.p_partkey = source left join n b on b.slug = target left join part y on y.p_partkey = target""")
def g04_accepted(spark, sf):
    """Merges that share a name of several words; genes and unknown candidates are never merged."""
    p = load(spark, sf, "part")
    c = p.select(F.col("p_partkey").alias("slug"), F.when(F.col("p_type") == "SMALL", "gene").otherwise("term").alias("kind"), F.array(*[F.expr(x) for x in MERGE_FORMS]).alias("forms"))
    return G.safe_merges(c, p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("source"), (F.col("p_partkey") + 7).alias("target")))


@query("h12_mentions", rf"""with w as (select item_id, regexp_extract_all(text, '[A-Za-z]+') as w from benchmark), f as ({" union ".join(FORMS.format(x) for x in SHAPES)}),
k as (select slug, lower(list_reduce(regexp_extract_all(form, '[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*'), lambda a, b: case when length(b) > length(a) then b else a end)) as token from f),
t as (select doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*'), lambda x: lower(x)))) as token from documents), p as (select distinct slug, doc_id from k join t using (token)),
r as (select slug from p group by 1 having count(*) <= 400), c as (select slug, doc_id, text from p join r using (slug) join documents using (doc_id))
select distinct c.slug, c.doc_id from c join f using (slug) where case when kind = 'gene' or regexp_full_match(form, '[A-Z0-9]{{1,3}}') then regexp_matches(text, '(^|[^A-Za-z0-9])' || regexp_escape(form) || '([^A-Za-z0-9]|$)')
 else regexp_matches(lower(text), '(^|[^a-z0-9])' || regexp_escape(lower(form)) || '(s|es)?([^a-z0-9]|$)') end""")
def h12(spark, sf):
    """The documents that mention terms, by the terms' own case rules; terms in question for over 400 documents are left out."""
    w = load(spark, sf, "benchmark").select(F.col("item_id").alias("slug"), F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w")).where("size(w) >= 2")
    one, two = F.col("w")[0], F.col("w")[1]
    shapes = F.array(F.concat_ws(" ", one, two), one, F.upper(F.left(two, F.lit(3))), two)
    f = w.select("slug", F.explode(shapes).alias("form"), F.when(F.col("slug") % 3 == 0, "gene").otherwise("term").alias("kind"))
    return M.mentions(load(spark, sf, "documents").select("doc_id", "text"), f, 400)


#: Papers: documents with sentences that refer to figures and tables.
PAPER = "text || ' As shown in Fig. ' || (1 + doc_id % 3) || 'a-' || (2 + doc_id % 3) || ', the effect holds for this cohort. See Extended Data Table 2 and Supplementary Figs. 1, 3 and S4 for details of it, and Figure 9. (Tables 1–2 list more values than Fig. ' || (doc_id % 5) || ' does.) Suppl. Fig. ' || (doc_id % 2) || 'b is shorter than Table 12 and table 7 here! As shown again in Fig. 2.  Short Fig. 1.'"
SQL_NUMBERS = "list_filter(list_transform(regexp_split_to_array({0}, '\\s*(?:[,–-]|and)\\s*'), lambda x: regexp_extract(x, '(?i)^\\s*S?([0-9]+)', 1)), lambda n: n <> '')"
REF = A.REFERENCE.replace("\\d", "[0-9]").replace("'", "''")
SQL_MENTIONS = rf"""p as (select doc_id, {PAPER} as text from documents where text is not null), c as (select doc_id, string_split(regexp_replace(text, '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)) as s from p),
s as (select doc_id, unnest(s) as raw, generate_subscripts(s, 1) as pos from c), t as (select doc_id, pos, trim(raw, ' ' || chr(9) || chr(10) || chr(13) || chr(12)) as sentence from s), u as (select * from t where length(sentence) >= 25),
m as (select doc_id, pos, sentence, unnest(regexp_extract_all(sentence, '{REF}', 1)) as pre, unnest(regexp_extract_all(sentence, '{REF}', 2)) as noun, unnest(regexp_extract_all(sentence, '{REF}', 3)) as chunk, generate_subscripts(regexp_extract_all(sentence, '{REF}'), 1) as nth from u),
k as (select *, case when lower(pre) like 'extended%' then 'extdata' when lower(pre) like 'suppl%' then 'supp' else '' end || case when lower(noun) like 'table%' then 'table' when lower(pre) like 'extended%' or lower(pre) like 'suppl%' then 'fig' else 'figure' end as kind, {SQL_NUMBERS.format('chunk')} as numbers from m),
named as (select doc_id, pos, sentence, kind, unnest(numbers) as number from k),
keys as (select doc_id, kind || number as key, sentence, min(pos) as pos from named group by all), kept as (select *, row_number() over (partition by doc_id, key order by pos) as nth from keys),
top as (select * from kept where nth <= 12), rel as (select distinct t.doc_id, t.key, n.kind, n.number from top t join named n on n.doc_id = t.doc_id and n.sentence = t.sentence where n.kind || n.number <> t.key),
best as (select *, row_number() over (partition by doc_id, key order by kind, number::bigint, number) as nth from rel), rr as (select doc_id, key, string_agg(kind || number, ' ' order by kind, number::bigint, number) as related from best where nth <= 10 group by all),
mm as (select doc_id, key, count(*) as n, md5(string_agg(sentence, chr(10) order by pos)) as digest from top group by all)"""


@query("h15_mentions", f"with {SQL_MENTIONS} select doc_id, key, n, digest, coalesce(related, '') as related from mm left join rr using (doc_id, key)")
def h15_mentions(spark, sf):
    """The sentences that mention each figure and table of a paper, and what else they name."""
    # A null text stays null and mentions nothing; a filter would read texts where ids are counted.
    p = load(spark, sf, "documents").select("doc_id", F.expr(PAPER).alias("text"))
    m = A.mentions(p)
    return m.select("doc_id", "key", F.size("sentences").cast("bigint").alias("n"), F.md5(F.array_join("sentences", "\n").cast("binary")).alias("digest"), F.array_join("related", " ").alias("related"))


KINDS = ["Fig. ", "Figure ", "Extended Data Fig. ", "Extended Data Table ", "Supplementary Figure ", "Supplementary Table ", "Table "]
TAILS = ["| Overview. (a) x, (b) y; c, z and d. w", ": a Amyloid burden, b Tau burden", " A Top: traces, B Summary; E None", ". One thing only (a)", " (a)(b) and (d)", " | a, b, c. d) e, f. g, h. i, j, k. l) m", "without any"]
CAP = "case when p_partkey % 11 = 0 then 'No label ' else element_at(kinds, cast(p_partkey % 7 + 1 as int)) || (1 + p_partkey % 30) end || element_at(tails, cast(p_partkey div 7 % 7 + 1 as int)) || ' of ' || p_name"


@query("h15_captions", rf"""with c as (select p_partkey, case when p_partkey % 11 = 0 then 'No label ' else ({KINDS})[p_partkey % 7 + 1] || (1 + p_partkey % 30) end || ({TAILS})[p_partkey // 7 % 7 + 1] || ' of ' || p_name as cap from part),
x as (select *, regexp_extract(cap, '{A.CAPTION}', 1) as noun, regexp_extract(cap, '{A.CAPTION}', 2) as num, case when instr(cap, '|') between 1 and 120 then substr(cap, instr(cap, '|') + 1) else cap end as body from c),
y as (select *, regexp_replace(body, '{A.LABEL}', '') as rest from x),
z as (select *, list_distinct(list_transform(list_concat(regexp_extract_all(rest, '{A.PANEL_MARKED}', 1), regexp_extract_all(rest, '{A.PANEL_SPACED}', 1)), lambda l: lower(l))) as found from y),
w as (select *, coalesce(list_min(list_filter(range(1, 13), lambda i: not list_contains(found, 'abcdefghijkl'[i]))), 13) - 1 as run from z)
select p_partkey, case when num <> '' then case when noun ilike 'extended%table' then 'extdatatable' when noun ilike 'extended%' then 'extdatafig' when noun ilike 'supp%table' then 'supptable' when noun ilike 'supp%' then 'suppfig' when noun ilike 'table' then 'table' else 'figure' end || num end as key,
 case when num <> '' then case when noun ilike 'extended%table' then 'Extended Data Table ' when noun ilike 'extended%' then 'Extended Data Fig. ' when noun ilike 'supp%table' then 'Supplementary Table ' when noun ilike 'supp%' then 'Supplementary Fig. ' when noun ilike 'table' then 'Table ' else 'Figure ' end || num end as label, case when run >= 2 then left('abcdefghijkl', run) else '' end as panels from w""")
def h15_captions(spark, sf):
    """The key, label and panels that captions give."""
    p = spread(load(spark, sf, "part").select("p_partkey", "p_name")).withColumns({"kinds": F.array(*[F.lit(x) for x in KINDS]), "tails": F.array(*[F.lit(x) for x in TAILS])})
    c = p.select("p_partkey", F.expr(CAP).alias("cap"))
    return c.select("p_partkey", A.asset_name(F.col("cap")).alias("n"), F.array_join(A.panels(F.col("cap")), "").alias("panels")).select("p_partkey", "n.key", "n.label", "panels")


@query("h15_extended_captions")
def h15_extended(spark, sf):
    """Unfinished captions with the blocks that go on with them; turns are a page's blocks.  A fold, beyond SQL, tested against a plain one."""
    kind = F.when(F.col("turn") % 4 == 0, "cap").when(F.col("turn") % 4 == 3, "fig").otherwise("txt")
    text = F.when(F.col("turn") % 4 == 0, F.rtrim(F.col("text"), F.lit(".!? \n"))).otherwise(F.col("text"))
    b = load(spark, sf, "conversations").select("conv_id", F.struct("turn", kind.alias("kind"), text.alias("text")).alias("b"))
    pages = b.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("items"))
    return pages.select("conv_id", A.extended_caption(F.col("items"), F.col("items")[0]["text"]).alias("caption"))
