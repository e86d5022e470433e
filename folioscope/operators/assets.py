"""Figures and tables of papers: names in captions, panels, sentences that mention them, related ones, captions that go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import let
from folioscope.sizes import parted

#: How captions and sentences name a figure or table.
CAPTION = r"(?i)(Extended\s+Data\s+Fig(?:ure)?\.?|Supplementary\s+Fig(?:ure)?\.?|Supplementary\s+Table|Extended\s+Data\s+Table|Fig(?:ure)?\.?|Table)\s*([0-9]+)"
REFERENCE = r"(?i)(Extended\s+Data\s+|Supplementary\s+|Suppl\.\s*)?(Fig(?:ure)?s?\.?|Tables?)\s*(S?\d+[A-Za-z]?(?:\s*(?:[-–,]|and)\s*S?\d+[A-Za-z]?)*)"
LABEL = r"(?i)^\s*(Extended\s+Data\s+|Supplementary\s+)?(Fig(?:ure)?\.?|Table)\s*\d+\s*[.:|]?\s*"
PANEL_MARKED, PANEL_SPACED = r"(?:^|[(\s.,;])([a-lA-L])\s*[),.]", r"(?:^|[.;,(]\s?|\s\s)([a-lA-L])\s+[A-Z]"
PANELS = "abcdefghijkl"
FINISHED = r"[.!?\")\]]\s*$"
NEXT_CAPTION = r"(?i)^\s*(Extended\s+Data\s+|Supplementary\s+)?(Fig(?:ure)?\.?|Table)\s*\d"
NEXT_SECTION = r"(?i)^\s*(Methods|Results|Discussion|Introduction|References|Acknowledge|Data availability|Code availability|Supplementary)"
#: Sentences and related assets kept, least length of a sentence, and what a caption may take in.
MOST_MENTIONS, MOST_RELATED, LEAST_SENTENCE, MOST_BLOCKS, LEAST_BLOCK = 12, 10, 25, 4, 20


def asset_kind(prefix: Column, noun: Column) -> Column:
    """extdatafig, extdatatable, suppfig, supptable, table or figure."""
    extended, supplement, table = F.lower(prefix).startswith("extended"), F.lower(prefix).startswith("suppl"), F.lower(noun).startswith("table")
    head = F.when(extended, "extdata").when(supplement, "supp").otherwise("")
    return F.concat(head, F.when(table, "table").when(extended | supplement, "fig").otherwise("figure"))


def asset_name(caption: Column) -> Column:
    """(key, label) of the first figure or table that a caption names; nulls if none."""
    noun, number = F.regexp_extract(caption, CAPTION, 1), F.regexp_extract(caption, CAPTION, 2)
    last = F.regexp_extract(noun, r"(?i)(Fig|Table)[^ ]*$", 1)
    kind = asset_kind(noun, last)
    label = F.when(kind == "figure", "Figure ").when(kind == "table", "Table ").when(kind == "extdatatable", "Extended Data Table ").when(kind == "extdatafig", "Extended Data Fig. ").when(kind == "supptable", "Supplementary Table ").otherwise("Supplementary Fig. ")
    return F.struct(F.when(number != "", F.concat(kind, number)).alias("key"), F.when(number != "", F.concat(label, number)).alias("label"))


def panels(caption: Column) -> Column:
    """The panel letters from a on without a gap; fewer than two are none."""
    bar = F.instr(caption, "|")
    body = F.when((bar > 0) & (bar <= 120), F.substring(caption, bar + 1, F.length(caption))).otherwise(caption)
    body = F.regexp_replace(body, LABEL, "")
    found = F.transform(F.concat(*[F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in (PANEL_MARKED, PANEL_SPACED)]), F.lower)
    letters = F.array(*[F.lit(x) for x in PANELS])
    gap = F.array_position(F.transform(letters, lambda x: F.array_contains(found, x)), False)
    run = F.when(gap == 0, letters).otherwise(F.slice(letters, 1, gap.cast("int") - 1))
    return F.when(F.size(run) >= 2, run).otherwise(F.array().cast("array<string>"))


def references(sentence: Column) -> Column:
    """The references of a sentence in order, as (kind, numbers); of a range only its ends."""
    part = lambda k: F.regexp_extract_all(sentence, F.lit(REFERENCE), F.lit(k))
    numbers = lambda chunk: F.filter(F.transform(F.split(chunk, r"\s*(?:[,–-]|and)\s*"), lambda x: F.regexp_extract(x, r"(?i)^\s*S?(\d+)", 1)), lambda n: n != "")
    zipped = F.arrays_zip(part(1).alias("p"), part(2).alias("n"), part(3).alias("c"))
    return F.transform(zipped, lambda x: F.struct(asset_kind(x["p"], x["n"]).alias("kind"), numbers(x["c"]).alias("numbers")))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z(])"), lambda s: F.btrim(s, F.lit(" \t\n\r\f"))), lambda s: F.length(s) >= LEAST_SENTENCE)


def named(sentence: Column) -> Column:
    """(keys, first): what a sentence refers to, as keys in order and as the first (kind, number, text) in sorted order, one more than may be related."""
    part = lambda r, k: F.transform(r["numbers"], k)
    keys = lambda refs: F.array_distinct(F.flatten(F.transform(refs, lambda r: part(r, lambda n: F.concat(r["kind"], n)))))
    every = lambda refs: F.flatten(F.transform(refs, lambda r: part(r, lambda n: F.struct(r["kind"].alias("kind"), n.cast("bigint").alias("number"), n.alias("text")))))
    return let(references(sentence), lambda refs: F.struct(keys(refs).alias("keys"), F.slice(F.sort_array(F.array_distinct(every(refs))), 1, MOST_RELATED + 1).alias("first")))


def may_refer(sentence: Column) -> Column:
    """Whether a sentence holds a word that every reference has; most don't, and no pattern is tried on them."""
    return let(F.lower(sentence), lambda low: low.contains("fig") | low.contains("table"))


def related(first: Column, key: Column) -> Column:
    """The keys, but for the sentences' own, of what its sentences name: the first of each one hold the first of all."""
    name = lambda x: F.concat(x["kind"], x["text"])
    return F.transform(F.slice(F.filter(F.sort_array(F.array_distinct(F.flatten(first))), lambda x: name(x) != key), 1, MOST_RELATED), name)


def text_mentions(text: Column) -> Column:
    """(key, sentences, related) of each figure and table that a text mentions: its sentences' keys are sorted, and of each key's run the first are taken."""
    found = F.transform(F.array_distinct(F.filter(sentences(F.coalesce(text, F.lit(""))), may_refer)), lambda s: F.struct(s.alias("sentence"), named(s).alias("named")))

    def grouped(found: Column, pairs: Column) -> Column:
        begins = F.filter(F.transform(pairs, lambda p, j: F.when((j == 0) | (F.get(pairs, j - 1)["key"] != p["key"]), j)), lambda j: j.isNotNull())

        def group(key: Column, own: Column) -> Column:
            of = F.transform(own, lambda p: F.get(found, p["at"]))
            return F.struct(key.alias("key"), F.transform(of, lambda x: x["sentence"]).alias("sentences"), related(F.transform(of, lambda x: x["named"]["first"]), key).alias("related"))

        return F.transform(begins, lambda j: let(F.get(pairs, j)["key"], lambda key: let(F.filter(F.slice(pairs, j + 1, F.lit(MOST_MENTIONS)), lambda p: p["key"] == key), lambda own: group(key, own))))

    pairs = lambda found: F.sort_array(F.flatten(F.transform(found, lambda x, i: F.transform(x["named"]["keys"], lambda k: F.struct(k.alias("key"), i.alias("at"))))))
    return let(found, lambda found: let(pairs(found), lambda pairs: grouped(found, pairs)))


def mentions(papers: DataFrame) -> DataFrame:
    """doc_id, key, sentences (the first twelve different ones that mention it, in order), related (keys named in the same ones).

    ``papers``: doc_id, text.  Every reference of a sentence is a mention of what it names.  A paper's mentions are gathered where its text lies;
    sentences are shuffled only where papers share an id.
    """
    alone, shared = parted(papers.select("doc_id", "text"), "doc_id")
    own = alone.select("doc_id", F.explode(text_mentions(F.col("text"))).alias("m")).select("doc_id", "m.key", "m.sentences", "m.related")
    s = shared.select("doc_id", F.posexplode(sentences(F.coalesce("text", F.lit("")))).alias("at", "sentence")).where(may_refer(F.col("sentence")))
    m = s.select("doc_id", "at", "sentence", named(F.col("sentence")).alias("n")).select("doc_id", "at", "sentence", "n.first", F.explode("n.keys").alias("key"))
    m = m.groupBy("doc_id", "key", "sentence").agg(F.min("at").alias("at"), F.first("first").alias("first"))
    m = m.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("at", "sentence"))).where(F.col("nth") <= MOST_MENTIONS)
    # At most MOST_MENTIONS sentences of a key are gathered.
    g = m.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("at", "sentence"))).alias("s"), F.collect_list("first").alias("first"))
    return own.unionByName(g.select("doc_id", "key", F.col("s.sentence").alias("sentences"), related(F.col("first"), F.col("key")).alias("related")))


def extended_caption(items: Column, caption: Column) -> Column:
    """A caption with the blocks that go on with its unfinished sentence.

    ``items``: the page's blocks in reading order as (kind, text), where kind is cap, txt or another; the blocks after the caption's
    are taken while they are text of twenty characters and more, at most four, until the sentence ends or another caption or section begins.
    """
    own = F.rtrim(F.ltrim(caption))
    where = F.array_position(F.transform(items, lambda b: (b["kind"] == "cap") & (b["text"] == caption)), True)
    rest = F.slice(items, where.cast("int") + 1, F.greatest(F.size(items) - where.cast("int"), F.lit(0)))
    state = lambda joined, added, done: F.struct(joined.alias("joined"), added.alias("added"), done.alias("done"))

    def step(s: Column, b: Column) -> Column:
        text = F.coalesce(b["text"], F.lit(""))
        ends = s["done"] | (s["added"] >= MOST_BLOCKS)
        skipped = ~b["kind"].isin("txt", "cap") | (F.length(text) < LEAST_BLOCK)
        stops = ~skipped & (text.rlike(NEXT_CAPTION) | text.rlike(NEXT_SECTION))
        joined = F.concat(s["joined"], F.lit(" "), F.trim(text))
        takes = ~ends & ~skipped & ~stops & ~F.contains(s["joined"], text)
        return F.when(takes, state(joined, s["added"] + 1, joined.rlike(FINISHED))).otherwise(state(s["joined"], s["added"], ends | stops))

    long = F.aggregate(rest, state(own, F.lit(0), F.lit(False)), step, lambda s: s["joined"])
    return F.when(caption.isNull() | (caption == "") | own.rlike(FINISHED) | (where == 0), caption).otherwise(long)
