"""Queries over Markdown pages: outlines, section kinds and selection, the index of pages and links, snippets, clean text, evidence.

Conversations are the pages (a turn is a section under a heading of a fixed list), documents the papers and notes; texts are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import search as S
from folioscope.plans.registry import query
from folioscope.sources.tables import load

HEADINGS = ["Methods and cohort", "3. Key Results", "Limitations", "Discussion", "한계와 반례", "결과", "Open question", "Linked pages", "Notes"]
#: A turn as a section, and the beginning of a page, as expressions that both dialects share.
PIECE = "'## ' || {heading} || chr(10) || chr(10) || text || chr(10) || case when (conv_id + turn) % 4 = 0 then '### Linked pages' || chr(10) || '- [[concepts/a|b]]' || chr(10) || '* [x](y.md)' || chr(10) when (conv_id + turn) % 4 = 1 then '### Detail' || chr(10) || '  of this  ' || chr(10) else '' end"
BEGIN = "case when conv_id % 3 = 0 then '# Conversation ' || conv_id || chr(10) when conv_id % 3 = 1 then '' else chr(10) || ' ' || chr(10) || '# T' || chr(10) || 'Opening words.' || chr(10) end"
SQL_WIKI = f"wiki as (select conv_id, {BEGIN} || string_agg({PIECE.format(heading=f'({HEADINGS})[(turn + conv_id) % 9 + 1]')}, chr(10) order by turn) as body from conversations group by conv_id)"
SQL_WHITE = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def wiki(spark, sf) -> DataFrame:
    """conv_id, body: a page for each conversation."""
    heading = F.element_at(F.array(*[F.lit(h) for h in HEADINGS]), ((F.col("turn") + F.col("conv_id")) % 9 + 1).cast("int"))
    c = load(spark, sf, "conversations").withColumn("heading", heading).select("conv_id", F.struct("turn", F.expr(PIECE.format(heading="heading")).alias("piece")).alias("t"))
    pieces = F.transform(F.array_sort(F.collect_list("t")), lambda t: t["piece"])
    return c.groupBy("conv_id").agg(F.array_join(pieces, "\n").alias("b")).select("conv_id", F.concat(F.expr(BEGIN), "b").alias("body"))


#: Sections cut out of the body by character positions, each from the end of its heading's line to the next heading.
SQL_OUTLINE = f"""{SQL_WIKI},
lines as (select conv_id, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as pos from wiki),
heads as (select *, coalesce(sum(length(line) + 1) over (partition by conv_id order by pos rows between unbounded preceding and 1 preceding), 0) as o, regexp_matches(line, '^## ') or (regexp_matches(line, '^### ') and lower(trim(substr(line, 5))) in ('linked pages', 'connected wiki pages')) as head from lines),
starts as (select conv_id, o as hs, o + length(line) as cs, trim(regexp_replace(line, '^#+ ', '')) as name from heads where head union all select conv_id, -1, length(regexp_extract(body, '^\\s*# [^\\n]*\\n?')), null from wiki),
cuts as (select s.*, body, substr(body, (cs + 1)::bigint, (coalesce(lead(hs) over (partition by conv_id order by hs), length(body)) - cs)::bigint) as raw from starts s join wiki using (conv_id)),
sec as (select conv_id, hs, coalesce(name, '(opening)') as heading, trim(raw, {SQL_WHITE}) as content, (cs + length(raw) - length(ltrim(raw, {SQL_WHITE})))::bigint as start from cuts where trim(raw, {SQL_WHITE}) <> ''),
outl as (select conv_id, row_number() over (partition by conv_id order by hs) - 1 as ord, heading, start, start + length(content) as "end", content,
 case when lower(heading) in ('linked pages', 'connected wiki pages') or length(regexp_replace(regexp_replace(regexp_replace(content, '\\[\\[[^\\[\\]\\n]*\\]\\]|\\[[^\\[\\]\\n]*\\]\\([^()\\n]*\\)|https?://\\S+', '', 'g'), '(?m)^[ \\t]*(?:[-*+]|[0-9]+[.)])[ \\t]*', '', 'g'), '\\s+', '', 'g')) < 0.1 * length(content) then 'links'
  when regexp_matches(lower(heading), 'limitation|caveat|counter|contradict|open question|untested|한계|반례|미해결') then 'limitations' when regexp_matches(lower(heading), 'result|finding|결과') then 'results'
  when regexp_matches(lower(heading), 'method|design|cohort|sample|방법|설계') then 'methods' when regexp_matches(lower(heading), 'discussion|interpretation|synthesis|conclusion|해석|논의|종합') then 'interpretation' else 'other' end as kind from sec)"""


@query("h01_outline", f'with {SQL_OUTLINE} select conv_id, ord, heading, start, "end", kind, md5(content) as digest, substr(w.body, (start + 1)::bigint, ("end" - start)::bigint) = content as exact from outl join wiki w using (conv_id)')
def h01_outline(spark, sf):
    """Sections of pages with offsets into the body; ``exact``: the offsets cut out the section's text."""
    w = wiki(spark, sf)
    o = S.outline(w, "conv_id", "body").join(w, "conv_id")
    return o.select("conv_id", "ord", "heading", "start", "end", "kind", F.md5(F.col("content").cast("binary")).alias("digest"), (F.substring(F.col("body"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("content")).alias("exact"))


@query("h01_index_sections", f"""with {SQL_WIKI}, p as (select conv_id, regexp_split_to_array(chr(10) || body, '\\n## ') as parts from wiki), q as (select conv_id, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as ord from p),
r as (select conv_id, ord, case when ord = 0 then '' else trim(regexp_extract(part, '^[^\\n]*')) end as heading, trim(case when ord = 0 then regexp_replace(trim(part, {SQL_WHITE}), '^# [^\\n]+\\n?', '') else regexp_replace(part, '^[^\\n]*\\n?', '') end, {SQL_WHITE}) as content from q) select conv_id, ord, heading, md5(content) as digest from r where content <> ''""")
def h01_index(spark, sf):
    """The index's own grammar: level-two headings only, an empty heading for what stands before them."""
    return S.markdown_sections(wiki(spark, sf), "body").select("conv_id", "ord", "heading", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("h07_section_kinds", f"with {SQL_OUTLINE} select heading, kind, count(*) as sections, sum(length(content))::bigint as chars from outl group by all")
def h07(spark, sf):
    return S.outline(wiki(spark, sf), "conv_id", "body").groupBy("heading", "kind").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.length("content")).alias("chars"))


SQL_CONTENT_WORDS = f"list_distinct(list_filter({T.SQL_TOKENS}, lambda w: length(w) > 2 and not list_contains([{STOP}], w)))"
WANTED = "case when conv_id % 4 = 0 then 'limitations ' when conv_id % 4 = 1 then '' when conv_id % 4 = 2 then 'Not There' end"


@query("f03_section_selection", f"""with {SQL_OUTLINE},
ask as (select conv_id, {SQL_CONTENT_WORDS.format("string_agg(text, ' ' order by turn)")} as asked from conversations where role = 'user' group by conv_id),
o as (select conv_id, ord, heading, kind, len(list_intersect({SQL_CONTENT_WORDS.format('content')}, coalesce(asked, []))) as overlap, {WANTED} as wanted from outl left join ask using (conv_id)),
n as (select *, case when wanted is null then false when trim(wanted) = '' then heading = '(opening)' else lower(heading) = lower(trim(wanted)) end as named from o),
b as (select conv_id, arg_max(ord, (named, case when named then 0 else (kind <> 'links')::int end, case when named then 0 else overlap end, -ord)) as best from n group by 1),
g as (select n.*, ord = best as is_best, case kind when 'limitations' then 1 when 'results' then 2 when 'methods' then 3 when 'interpretation' then 3 end as own from n join b using (conv_id)),
h as (select *, max(case when is_best then coalesce(own, 0) end) over (partition by conv_id) as of_best from g),
c as (select *, case when is_best then 0 when own <> of_best then own end as grp from h),
f as (select *, row_number() over (partition by conv_id, grp order by overlap desc, ord) as nth from c),
p as (select *, case when grp is not null and nth = 1 then grp when kind <> 'links' then 4 end as place from f),
r as (select conv_id, ord, kind, overlap, row_number() over (partition by conv_id order by place, case when place = 4 then -overlap else 0 end, ord) as pick from p where place is not null)
select * from r where pick <= 5""")
def f03(spark, sf):
    """The best section of each page, one of each kind of evidence, then the rest by shared words, five in all."""
    u = load(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), " ").alias("q"))
    o = S.outline(wiki(spark, sf), "conv_id", "body").join(u.select("conv_id", T.content_words("q").alias("asked")), "conv_id", "left")
    o = o.select("conv_id", "ord", "heading", "kind", T.content_words("content").alias("words"), F.coalesce("asked", F.array().cast("array<string>")).alias("asked"), F.expr(WANTED).alias("wanted"))
    return S.select_sections(o, "conv_id", 5, everything=True)


#: Documents as pages of five folders, with a header, a heading, a summary and links.
KEY = "'wiki/' || case doc_id % 6 when 0 then 'sources/s' when 1 then 'overviews/' || source || '/o' when 2 then 'concepts/c' when 3 then 'questions/q' when 4 then 'papers/p' else 'indexes/i' end || doc_id || '.md'"
PAGE = """case when doc_id % 2 = 0 then '---' || chr(10) || case when doc_id % 4 = 0 then 'title: "Page ' || doc_id || '"' || chr(10) else '' end || 'category: ' || lang || chr(10) || ' more: x' || chr(10) || case when doc_id % 8 = 0 then 'publication_year: 1999' else 'year: 2001' end || chr(10) || 'journal: ' || source || chr(10) || '---' || chr(10) else '' end
 || case when doc_id % 5 < 3 then '# Heading ' || doc_id || chr(10) else '' end || text || chr(10) || '## One-line Summary' || chr(10) || chr(10) || text || chr(10) || '## Links' || chr(10) || '- [[concepts/c' || (doc_id + 1) || '.md|label]] [[wiki/papers/p' || (doc_id + 2) || '#part]] [[sources/s1]] [[unknown/z]]'"""


@query("h02_documents", f"""with p as (select {KEY} as key, {PAGE} as text from documents where text is not null), k as (select *, string_split(key, '/') as parts, text like '---' || chr(10) || '%' as headed from p where not starts_with(key, 'wiki/indexes/')),
f as (select *, parts[2] as folder, regexp_replace(array_to_string(parts[3:], '/'), '\\.md$', '') as doc_id, case when headed then regexp_extract(text, '^---\\n((?s).*?)\\n---\\n', 1) else '' end as head, case when headed then substr(text, length(regexp_extract(text, '^---\\n(?s).*?\\n---\\n')) + 1) else text end as body from k),
x as (select *, nullif(regexp_extract(head, '(?m)^title: "(.*)"$', 1), '') as t, regexp_extract(body, '(?m)^# (.+)$', 1) as h, regexp_extract(body, '(?:^|\\n)## One-line Summary[^\\n]*\\n((?s).*?)(?:\\n## .|$)', 1) as s, regexp_extract_all(body, '\\[\\[(?:wiki/)?([a-z]+)/([^\\]|#]+)(?:[|#][^\\]]*)?\\]\\]', 1) as kinds, regexp_extract_all(body, '\\[\\[(?:wiki/)?([a-z]+)/([^\\]|#]+)(?:[|#][^\\]]*)?\\]\\]', 2) as ids from f)
select case folder when 'sources' then 'note' when 'overviews' then 'overview' when 'concepts' then 'concept' when 'questions' then 'question' else 'paper' end as doc_type, doc_id, coalesce(t, nullif(trim(h), ''), doc_id) as title,
 case when folder = 'sources' then coalesce(nullif(regexp_extract(head, '(?m)^category: (.*)$', 1), ''), 'note') when folder = 'overviews' then parts[3] else folder end as category,
 coalesce(nullif(regexp_extract(head, '(?m)^publication_year: (.*)$', 1), ''), regexp_extract(head, '(?m)^year: (.*)$', 1)) as year, regexp_extract(head, '(?m)^journal: (.*)$', 1) as journal, '' as doi, substr(trim(regexp_replace(s, '\\s+', ' ', 'g')), 1, 260) as summary,
 array_to_string(list_filter(list_transform(list_zip(kinds, ids), lambda z: case z[1] when 'concepts' then 'concept:' when 'papers' then 'paper:' when 'sources' then 'note:' end || regexp_replace(z[2], '\\.md$', '')), lambda y: y is not null), ' ') as links from x""")
def h02(spark, sf):
    pages = load(spark, sf, "documents").where("text is not null").select(F.expr(KEY).alias("key"), F.expr(PAGE).alias("text"))
    return S.index_documents(pages).withColumn("links", F.array_join(F.transform("links", lambda x: F.concat(x["type"], F.lit(":"), x["id"])), " "))


@query("h06_snippets", f"""with t as (select doc_id, text, ['th', 'license', 'eau', 'qui'] as terms from documents),
p as (select *, coalesce(list_min(list_filter(list_transform(terms, lambda w: instr(lower(text), w)), lambda x: x > 0)), 0) as f from t),
s as (select *, greatest(0, case when f > 0 then f - 1 - 106 else 0 end) as st from p),
m as (select *, regexp_replace(regexp_replace(regexp_replace(substr(text, (st + 1)::bigint, 320), '(license)', '[\\1]', 'gi'), '(eau)', '[\\1]', 'gi'), '(qui)', '[\\1]', 'gi') as x from s)
select doc_id, (case when st > 0 then '… ' else '' end) || trim(replace(x, chr(10), ' ')) || (case when st + 320 < length(text) then ' …' else '' end) as snippet from m""")
def h06(spark, sf):
    terms = F.array(*[F.lit(w) for w in ("th", "license", "eau", "qui")])
    return load(spark, sf, "documents").select("doc_id", T.snippet("text", terms).alias("snippet"))


CHECKED = "text || case when doc_id % 3 = 0 then chr(10) || 'Nature Portfolio Reporting Summary' || chr(10) || 'Field-specific reporting' || chr(10) || text when doc_id % 3 = 1 then ' Reporting summary. ' || text || ' life sciences study design' else '' end || case when doc_id % 5 = 0 then ' ' || repeat('x y ', 30) || 'end' else '' end"


@query("h14_noise_removed", f"""with t as (select doc_id, {CHECKED} as text from documents), l as (select doc_id, text, list_filter([{', '.join(f"instr(lower(text), '{m}')" for m in T.CHECKLIST)}], lambda x: x > 2000) as cuts from t),
c as (select doc_id, case when len(cuts) > 0 then rtrim(substr(text, 1, list_min(cuts)::bigint - 1), {SQL_WHITE}) else text end as cut from l), b as (select doc_id, length(cut) as cut_chars, regexp_replace(cut, '(\\S\\s){{41,}}', '', 'g') as x from c),
n as (select *, len(regexp_extract_all(x, '\\S+')) as n, length(regexp_replace(x, '\\s+', '', 'g')) as solid from b) select doc_id, cut_chars, length(case when n >= 15 and solid < 2 * n then '' else x end) as kept_chars from n""")
def h14(spark, sf):
    """Texts without their reporting checklists, and without runs of single characters or scattered letters."""
    d = load(spark, sf, "documents").select("doc_id", F.expr(CHECKED).alias("text")).select("doc_id", T.without_checklist("text").alias("cut"))
    return d.select("doc_id", F.length("cut").alias("cut_chars"), F.length(T.without_blobs("cut")).alias("kept_chars"))


SAID = "case when doc_id % 3 = 0 then 'As in Li et al.  In Fig. 3, e.g. The one. ' when doc_id % 3 = 1 then '  So it is vs. Others? ' else '' end || text"


@query("h16_first_sentence", rf"""with t as (select doc_id, trim({SAID}, {SQL_WHITE}) as text from documents), m as (select doc_id, regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g') as text from t),
k as (select doc_id, regexp_replace(text, '(e\.g\.|i\.e\.|al\.|vs\.|cf\.|Fig\.)' || chr(1), '\1 ', 'g') as text from m) select doc_id, split_part(text, chr(1), 1) as sentence from k""")
def h16(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.first_sentence(F.expr(SAID)).alias("sentence"))


#: Papers with DOIs and years in their text, a reference list, and the titles that are looked for.
EVIDENCE = "case doc_id % 4 when 0 then 'doi: 10.5555/D' || doc_id || '). Since 1998 and 2003. ' when 1 then 'https://doi.org/10.5555/(x)' || doc_id || ', doi:10.5555/d' || (doc_id + 1) || ' ' when 2 then 'DOI: 10.1/short and 17990 x1850 ' else '' end || text || case when doc_id % 5 = 0 then ' The Nrxn2α-STUDY ' else '' end || case when doc_id % 3 = 0 then chr(10) || 'References:' || chr(10) || 'doi: 10.5555/late 1899' || chr(10) || text else '' end"
SQL_STRIP = "regexp_replace({0}, '[.,;:]+$', '')"


@query("h17_text_evidence", rf"""with b as (select item_id, text as candidate, (select count(*) from benchmark) as items from benchmark),
d as (select doc_id, {EVIDENCE} as text, '10.5555/d' || doc_id as doi, case doc_id % 10 when 0 then 'nrxn2a study' when 5 then 'nrxn2 study' else regexp_extract(text, '^[^\n]*') end as title from documents where text is not null),
c as (select d.*, b.candidate, regexp_split_to_array(d.text, '(?im)^[ \t]*(?:references(?:[ \t]+and[ \t]+notes)?|bibliography|literature[ \t]+cited|reference[ \t]+list)[ \t]*:?[ \t]*$')[1] as content from d left join b on b.item_id = d.doc_id % b.items),
f as (select *, list_transform(regexp_extract_all(content, '(?i)(?:\bdoi[ \t]*:\s*|https?://(?:dx\.)?doi\.org/)(10\.[0-9]{{4,9}}/[^\s<>"'']+)', 1), lambda x: lower({SQL_STRIP.format('x')})) as raw from c),
g as (select *, list_transform(raw, lambda x: case when right(x, 1) = ')' and length(replace(x, '(', '')) > length(replace(x, ')', '')) then left(x, -1) else x end) as dois, regexp_replace({T.SQL_FOLD.format("replace(content, 'α', 'a')")}, '[^a-z0-9]+', '', 'g') as sq from f),
s as (select *, regexp_replace({T.SQL_FOLD.format('title')}, '[^a-z0-9]+', '', 'g') as st, regexp_replace({T.SQL_FOLD.format("coalesce(candidate, '')")}, '[^a-z0-9]+', '', 'g') as sc from g)
select doc_id, list_contains(dois, doi) as doi_present, st <> '' and contains(sq, st) as title_present, sc <> '' and contains(sq, sc) as candidate_present, array_to_string(list_distinct(dois).list_sort(), ' ') as dois,
 array_to_string(list_sort(list_distinct(regexp_extract_all(content, '\b(?:18|19|20)[0-9]{{2}}\b'))), ' ') as years, length(substr(content, 1, 1500)) as excerpt_chars from s""")
def h17(spark, sf):
    """What each paper's text before its references says of its own DOI and title, and of a title found elsewhere."""
    b = load(spark, sf, "benchmark")
    n = b.agg(F.count(F.lit(1)).alias("n")).scalar()
    d = load(spark, sf, "documents").where("text is not null").select("doc_id", F.expr(EVIDENCE).alias("text"), F.expr("'10.5555/d' || doc_id").alias("doi"), F.when(F.col("doc_id") % 10 == 0, "nrxn2a study").when(F.col("doc_id") % 10 == 5, "nrxn2 study").otherwise(F.regexp_extract("text", r"^[^\n]*", 0)).alias("title"), (F.col("doc_id") % n).alias("item_id"))
    found = S.classified(d.join(b.select("item_id", F.col("text").alias("candidate_title")), "item_id", "left"))
    return found.select("doc_id", "doi_present", "title_present", "candidate_present", F.array_join(F.array_sort("dois"), " ").alias("dois"), F.array_join(F.transform("years", lambda y: y.cast("string")), " ").alias("years"), F.length("excerpt").alias("excerpt_chars"))
