"""Which notes mention which terms: one pass of an automaton over all forms.

A term's forms are looked for as whole words.  A gene's forms match as they are written; of other terms, forms of up to three capitals and digits too, and all
others in either case and with a plural's ending.  As a term's notes come only those in question that hold the longest token of one of its forms; a term with more
than ``most`` notes in question is left out, whatever its tokens have in common with other terms.

Two passes: the first counts each term's notes in question by their tokens, the second looks for the terms that are left. The automaton is built in each worker from the forms, which every task gets.  Forms beyond FORM_CHARS characters are dealt out over several automata by hash, each of which
passes over the texts; texts are never shuffled, and only (slug, note) leaves a task, with counts summed for each task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.lineage import cut

#: Tokens, forms that match as they are written, and the endings of plurals.
TOKEN = re.compile(r"[A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*")
SHORT_UPPER = re.compile("[A-Z0-9]{1,3}")
ENDINGS = ("", "s", "es")
#: Characters of forms in one automaton.
FORM_CHARS = 4_000_000
WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def lowered(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Forms:
    """The forms of terms, to be found in texts; ``rows`` are (slug, form, exact)."""

    def __init__(self, rows: list[tuple]) -> None:
        self.keys: dict[str, set] = {}
        by_form: dict[str, list[tuple]] = {}
        for slug, form, exact in rows:
            if not form:
                continue
            if tokens := TOKEN.findall(form):
                self.keys.setdefault(max(tokens, key=len).lower(), set()).add(slug)
            by_form.setdefault(lowered(form), []).append((slug, form, exact or SHORT_UPPER.fullmatch(form) is not None))
        self.automaton = ahocorasick.Automaton()
        for low, own in by_form.items():
            self.automaton.add_word(low, (len(low), own))
        if by_form:
            self.automaton.make_automaton()

    def posted(self, text: str) -> set:
        """The terms in question for a text."""
        out: set = set()
        for t in {t.lower() for t in TOKEN.findall(text)} & self.keys.keys():
            out |= self.keys[t]
        return out

    def found(self, text: str, posted: set) -> set:
        """The terms among ``posted`` that the text mentions."""
        out: set = set()
        low, n = lowered(text), len(text)
        ends = lambda at: at >= n or text[at] not in WORD
        for last, (size, own) in self.automaton.iter(low):
            start, stop = last + 1 - size, last + 1
            if start and text[start - 1] in WORD:
                continue
            plain = ends(stop)
            plural = plain or any(low.startswith(e, stop) and ends(stop + len(e)) for e in ENDINGS[1:])
            if plural:
                for slug, form, exact in own:
                    if slug in posted and slug not in out and (plain and text[start:stop] == form if exact else True):
                        out.add(slug)
        return out


def mentions(notes: DataFrame, forms: DataFrame, most: int) -> DataFrame:
    """slug, doc_id: the notes (doc_id, text) that mention a term; ``forms``: slug, form, kind (``gene`` or another).

    Null texts and forms and empty forms match nothing; a term whose forms have no token is never in question; repeated rows of ``forms`` count once, repeated notes are one each.
    """
    spark = notes.sparkSession
    rows = cut(forms.where("form is not null and form <> ''").select("slug", "form", F.coalesce(F.col("kind") == "gene", F.lit(False)).alias("exact")).distinct())
    size = rows.agg(F.sum(F.length("form"))).first()[0] or 0
    parts = max(1, -(-size // FORM_CHARS))
    texts = notes.select("doc_id", "text")

    def passes(rows: DataFrame, run, schema: str) -> DataFrame:
        """One pass over the texts for each share of the terms; a term's forms stay together, and a share has some FORM_CHARS."""
        share = lambda k: [tuple(r) for r in rows.where(F.pmod(F.xxhash64("slug"), F.lit(parts)) == k).collect()]
        out = [texts.mapInArrow(run(spark.sparkContext.broadcast(share(k))), schema) for k in range(parts)]
        return reduce(DataFrame.unionByName, out)

    def counting(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forms_, counts = Forms(sent.value), Counter()
            for batch in batches:
                for text in batch.column(1):
                    counts.update(forms_.posted(text.as_py() or ""))
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["slug", "n"])

        return run

    def searching(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forms_ = Forms(sent.value)
            for batch in batches:
                ids, slugs = [], []
                for i, text in enumerate(batch.column(1)):
                    t = text.as_py() or ""
                    if posted := forms_.posted(t):
                        own = forms_.found(t, posted)
                        slugs.extend(own)
                        ids.extend([i] * len(own))
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(slugs), batch.column(0).take(pa.array(ids))], names=["slug", "doc_id"])

        return run

    slug = f"slug {rows.schema['slug'].dataType.simpleString()}"
    asked = passes(rows, counting, f"{slug}, n long").groupBy("slug").agg(F.sum("n").alias("n")).where(F.col("n") <= most)
    # Terms that are left out are not looked for: they would be most of the automaton's hits.
    left = cut(rows.join(asked.select("slug"), "slug", "left_semi"))
    return passes(left, searching, f"{slug}, doc_id {notes.schema['doc_id'].dataType.simpleString()}").distinct()


def held(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """item_id, doc_id: which texts (doc_id, text) hold which needles (item_id, needle) anywhere; null and empty needles are in none.

    One pass over the texts for each FORM_CHARS characters of needles; no pair of a text and a needle is compared.
    """
    spark = texts.sparkSession
    rows = cut(needles.where("needle is not null and needle <> ''").select("item_id", "needle").distinct())
    parts = max(1, -(-(rows.agg(F.sum(F.length("needle"))).first()[0] or 0) // FORM_CHARS))
    schema = f"item_id {rows.schema['item_id'].dataType.simpleString()}, doc_id {texts.schema['doc_id'].dataType.simpleString()}"

    def searching(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_needle: dict[str, list] = {}
            for item, needle in sent.value:
                by_needle.setdefault(needle, []).append(item)
            automaton = ahocorasick.Automaton()
            for needle, items in by_needle.items():
                automaton.add_word(needle, items)
            if by_needle:
                automaton.make_automaton()
            for batch in batches:
                found, at = [], []
                for i, text in enumerate(batch.column(1)):
                    own = {item for _, items in automaton.iter(text.as_py() or "") for item in items} if by_needle else set()
                    found.extend(own)
                    at.extend([i] * len(own))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found), batch.column(0).take(pa.array(at))], names=["item_id", "doc_id"])

        return run

    every = [spark.sparkContext.broadcast([tuple(r) for r in rows.where(F.pmod(F.xxhash64("needle"), F.lit(parts)) == k).collect()]) for k in range(parts)]  # some FORM_CHARS each
    passes = [texts.select("doc_id", "text").mapInArrow(searching(sent), schema) for sent in every]
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return out.distinct()
