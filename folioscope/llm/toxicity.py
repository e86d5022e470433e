"""Toxicity: Levenshtein automata intersected with a lexicon trie, and windows of context.

The lexicon is learned from labelled texts: words and word beginnings (stems) that are far commoner
in toxic texts.  Its trie and the Levenshtein automata of all its terms run as one automaton over a
word's characters: a state is the set of (trie node, edits so far), made when first met and then
kept, so a clean word usually ends after a few table lookups.  Terms of four letters and more may have
one edit, of nine and more two, at any letter, the first too.  Words masked by symbols (id*ot) are
joined and each symbol counts as a letter.  Edited forms that are no commoner in the sample's toxic
texts than in its clean ones are clean words, not hits; what the other edited forms weigh is counted
on the half of the sample that did not choose them.

Each hit weighs the log odds of its term (for edited forms those of the edited form, so that forms
that clean texts use too weigh nothing).  A window of words around it tells quotation (inside quotation
marks, or a verb of saying near it) from abuse (a second person near it), which lowers or raises the
weight.  A logistic curve over the summed weights gives the score.

Training uses a bounded sample: about ``toxic`` and ``clean`` labelled texts, chosen by a hash of the id; an id counts once,
one with both labels not at all.  Scoring reads whole texts, of any length in one pass, and nothing else.

Defined results: null and empty texts score as texts without hits; without toxic training texts the
lexicon is empty and all scores are equal; ties between terms go to fewer edits, then to the
first term; repeated rows repeat; an empty table gives an empty result; clashing names: see ``common.beside``.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import beside, cut

WORD = re.compile(r"[^\W_]+")
#: Words with one to three symbols at a time between letters.
MASKED = re.compile(r"[^\W_]++(?:(?:[^\w\s]|_){1,3}+[^\W_]++)+")
#: Shortest and longest stem (words of any length are terms); words kept, and letters of the longest of them.
LEAST, STEM, WORDS, KEPT = 4, 7, 900_000, 64
#: Words of saying, and of the second person, in the languages at hand.
SAYING = frozenset("said says say wrote writes called calls quoted quote quotes claimed dit disait écrit appelé sagte sagt schrieb nannte dijo dice escribió llamó".split())
SECOND = frozenset("you your yours youre u du dich dir dein deine tu te toi ton vous usted ustedes ti".split())
QUOTES = re.compile("[\"“”„«»]")
BREAK = re.compile("\n")
#: Words looked at on either side of a hit, and what a quotation and an address make of its weight: defaults of ``train``.
WINDOW, QUOTED, DIRECTED = 6, 0.35, 1.15


def edits_for(length: int) -> int:
    return 0 if length < 4 else 1 if length < 9 else 2


class Lexicon:
    """A trie of terms (text, is a stem) and the automaton over it; with ``first``, edits may be at the first letter too."""

    def __init__(self, terms: list[tuple[str, bool]], first: bool = False):
        self.terms = terms
        self.first = first
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.most: list[int] = [0]  # edits that some term below may have
        for k, (term, _) in enumerate(terms):
            node = 0
            allowed = edits_for(len(term))
            self.most[0] = max(self.most[0], allowed)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed)
            self.ends[node] = k
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.number: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.final: list[tuple[int, int] | None] = []  # best (edits, term) if the word ends here
        self.stem: list[tuple[int, int] | None] = []  # best (edits, term) of the stems complete here
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, of: dict[int, int]) -> int:
        # A term's letters may be left out: reach the nodes below with one edit more.
        stack = list(of.items())
        while stack:
            node, e = stack.pop()
            if (node or self.first) and e < self.most[node]:
                for child in self.children[node].values():
                    if e + 1 <= self.most[child] and of.get(child, 99) > e + 1:
                        of[child] = e + 1
                        stack.append((child, e + 1))
        key = tuple(sorted(of.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            done = sorted((e, self.ends[n]) for n, e in key if self.ends[n] >= 0 and e <= edits_for(len(self.terms[self.ends[n]][0])))
            self.final.append(done[0] if done else None)
            stems = [x for x in done if self.terms[x[1]][1]]
            self.stem.append(stems[0] if stems else None)
        return self.number[key]

    def _move(self, state: int, c: str) -> int:
        of: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.most[node] and of.get(node, 99) > e:
                of[node] = e

        for node, e in self.states[state]:
            if c in self.children[node]:
                reach(self.children[node][c], e)
            if node or self.first:
                reach(node, e + 1)
                for child in self.children[node].values():
                    reach(child, e + 1)
        self.moves[state][c] = out = self._state(of)
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the closest term, or None."""
        state, best = self.start, None
        for c in word:
            state = self.moves[state].get(c, -1) if c in self.moves[state] else self._move(state, c)
            if state == self.dead:
                return best
            if (s := self.stem[state]) is not None and (best is None or s < best):
                best = s
        end = self.final[state]
        return end if end is not None and (best is None or end < best) else best


class Matches(dict):
    """word -> its match (None for clean words, and for edited forms in ``clean``), filled when asked."""

    def __init__(self, lexicon: Lexicon, clean: frozenset[str] = frozenset()):
        self.lexicon = lexicon
        self.clean = clean

    def __missing__(self, word: str) -> tuple[int, int] | None:
        found = self.lexicon.match(word)
        if found is not None and found[0] and word in self.clean:
            found = None
        if len(word) <= KEPT:
            if len(self) >= WORDS:
                self.clear()
            self[word] = found
        return found


@dataclass
class Model:
    terms: list[tuple[str, bool]]
    weights: dict[tuple[int, int], float] = field(default_factory=dict)  # (term, edits)
    slope: float = 1.0
    shift: float = -3.0
    clean: frozenset[str] = frozenset()  # edited forms that are clean words
    window: int = WINDOW
    quoted: float = QUOTED
    directed: float = DIRECTED


def hits(matches: Matches, text: str | None, window: int = WINDOW) -> list[tuple[int, int, bool, bool, str]]:
    """(term, edits, quoted, directed, form) of each hit in a text, in one pass over it."""
    low = (text or "").lower()
    words = WORD.findall(low)
    found = list(map(matches.__getitem__, words))
    masked = [w for c in {*low.split()} if not c.isalnum() for w in MASKED.findall(c) if matches[w]]
    if not masked and not any(found):
        return []
    forms = words.copy()
    marks, breaks = [m.start() for m in QUOTES.finditer(low)], [m.start() for m in BREAK.finditer(low)]
    places = [m.start() for m in WORD.finditer(low)]
    if masked:
        for m in MASKED.finditer(low):
            f, i = matches[m.group()], bisect_left(places, m.start())
            # A masked word stands for its parts if it is closer to a term than each of them.
            if f is not None and all(x is None or f < x for x in found[i : bisect_left(places, m.end())]):
                found[i], forms[i] = f, m.group()
    out = []
    for i, f in enumerate(found):
        if f is None:
            continue
        near = words[max(0, i - window) : i + window + 1]
        line = bisect_left(breaks, places[i])
        # Quotation marks of the line before the word: an odd number leaves one open.
        before = bisect_left(marks, places[i]) - (bisect_left(marks, breaks[line - 1]) if line else 0)
        out.append((f[1], f[0], before % 2 == 1 or not SAYING.isdisjoint(near), not SECOND.isdisjoint(near), forms[i]))
    return out


def total(model: Model, found: list[tuple[int, int, bool, bool, str]]) -> float:
    """Weight of all hits; of repeated ones the one that weighs most, so that length alone makes no text toxic."""
    by_term: dict[tuple[int, int], float] = {}
    for term, edits, quoted, directed, _ in found:
        k = model.quoted if quoted else model.directed if directed else 1.0
        by_term[term, edits] = max(by_term.get((term, edits), 0.0), k)
    return sum(k * model.weights.get(key, 0.0) for key, k in by_term.items())


def squash(weight: float) -> float:
    return math.copysign(math.log1p(abs(weight)), weight)


def choose_terms(counts: list[tuple[str, int, int, int]], toxic: int, clean: int, ratio: float = 20.0) -> list[tuple[str, bool]]:
    """Terms from (beginning or word, 1 if a word, toxic texts with it, clean texts with it)."""
    odds = lambda a, b: (a + 0.5) / (toxic + 1) / ((b + 0.5) / (clean + 1))
    words = {t: (a, b) for t, w, a, b in counts if w}
    stems = {t: (a, b) for t, w, a, b in counts if not w}
    below: dict[str, list[str]] = {}
    for t in stems:
        below.setdefault(t[:-1], []).append(t)
    out: dict[str, bool] = {}
    for t, (a, b) in words.items():
        if odds(a, b) >= ratio:
            out[t] = False
    for t, (a, b) in sorted(stems.items()):
        if odds(a, b) < ratio or any(t.startswith(o) and stem and o != t for o, stem in out.items()):
            continue
        # The longest beginning that nearly all of its texts share.
        while (longer := max(below.get(t, []), key=lambda x: stems[x][0], default=None)) and stems[longer][0] >= 0.95 * stems[t][0]:
            t = longer
        if any(w.startswith(t) and words[w][0] >= 0.8 * stems[t][0] for w in out if w in words and not out[w]):
            continue  # one word has nearly all of it
        out[t] = True
    return sorted((t, stem) for t, stem in out.items() if stem or not any(t.startswith(o) and s for o, s in out.items()))


def clean_forms(used: dict[str, list[int]], clean: int, toxic: int) -> frozenset[str]:
    """Forms that are at least as common in the clean texts as in the toxic ones; ``used``: form -> clean texts, toxic texts with it."""
    return frozenset(form for form, (no, yes) in used.items() if no and no * toxic >= yes * clean)


def _sample(df: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, toxic: int, clean: int) -> DataFrame:
    """(id, text, y): about ``toxic`` and ``clean`` labelled texts, each id once."""
    from folioscope.llm.qualitycrf import sampled, with_texts

    return with_texts(df, sampled(labels, doc_id, label, {1: toxic, 0: clean}), doc_id, text)


def train(df: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, toxic: int = 1500, clean: int = 4500, window: int = WINDOW, quoted: float = QUOTED, directed: float = DIRECTED) -> Model:
    """``labels``: the rows to learn from only.  Every term that the sample supports is in the lexicon."""
    from folioscope.llm.qualitycrf import curve

    # Written once: the sample is read again and again, the documents are not.
    some = cut(_sample(df, labels, doc_id, text, label, toxic, clean))

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, y in zip(batch.column("text"), batch.column("y").to_pylist()):
                words = WORD.findall((t.as_py() or "").lower())
                seen: dict[tuple[str, int], int] = {}
                for i, w in enumerate(words):
                    if (w, 1) not in seen:
                        # Copies of a text share the words around a term: a term is as common as it has different neighbours.
                        near = xxhash.xxh3_64_intdigest(" ".join(words[max(0, i - 1) : i] + words[i + 1 : i + 2])) >> 1 if y else 0
                        seen[w, 1] = near
                        for n in range(LEAST, min(STEM, len(w)) + 1):
                            seen.setdefault((w[:n], 0), near)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array([y] * len(seen), pa.int32()), pa.array(seen.values(), pa.int64())], names=["term", "word", "y", "near"])

    sizes = {r.y: r.n for r in some.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model([], window=window, quoted=quoted, directed=directed)
    a, b = F.sum("y"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0))
    met = some.mapInArrow(terms_of, "term string, word int, y int, near long").groupBy("term", "word", "y", "near").agg(F.count(F.lit(1)).alias("n"))
    counted = met.groupBy("term", "word").agg(a.alias("a"), b.alias("b"))
    often = counted.where(f"a >= {max(5, round(0.01 * sizes[1]))} and (a + 0.5) / {sizes[1] + 1} >= 20 * (b + 0.5) / {sizes[0] + 1}")
    model = Model(choose_terms(sorted((r.term, r.word, r.a, r.b) for r in often.collect()), sizes[1], sizes[0]), window=window, quoted=quoted, directed=directed)

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = Matches(Lexicon(model.terms, first=True))
        for batch in batches:
            own = [hits(matches, t.as_py(), window) for t in batch.column("text")]
            numbers = pa.array([[list(map(int, h[:4])) for h in x] for x in own], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("y"), numbers, pa.array([[h[4] for h in x] for x in own], pa.list_(pa.string()))], names=["id", "y", "hits", "forms"])

    rows = sorted(some.mapInArrow(found_in, "id string, y int, hits array<array<int>>, forms array<string>").collect(), key=lambda r: (r.id or "", r.y))
    found = [(r.y, zlib.crc32((r.id or "").encode()) % 2, [(h[0], h[1], bool(h[2]), bool(h[3]), f) for h, f in zip(r.hits, r.forms)]) for r in rows]
    # Edited forms that are clean words, as each half of the sample and the whole of it have them.
    texts, used = [[0, 0], [0, 0]], [{}, {}]
    for y, half, own in found:
        texts[half][y] += 1
        for form in {h[4] for h in own if h[1]}:
            used[half].setdefault(form, [0, 0])[y] += 1
    halves = [clean_forms(used[half], *texts[half]) for half in (0, 1)]
    both = {form: [sum(u.get(form, [0, 0])[y] for u in used) for y in (0, 1)] for form in {*used[0], *used[1]}}
    model.clean = clean_forms(both, sizes[0], sizes[1])
    # A text's own half has no say in which of its forms count.
    counting = [(y, [h for h in own if not h[1] or h[4] not in halves[1 - half]]) for y, half, own in found]
    count: dict[tuple[int, int], list[int]] = {}
    for y, own in counting:
        for key in {(h[0], h[1]) for h in own}:
            count.setdefault(key, [0, 0])[y] += 1
    for k, (term, _) in enumerate(model.terms):
        exact = count.get((k, 0), [0, 0])
        for e in range(edits_for(len(term)) + 1):
            no, yes = count.get((k, e), [0, 0])
            prior = exact[1] * 0.05**e  # edited forms are rarer, but as toxic until clean texts have them
            model.weights[k, e] = max(0.0, math.log((max(yes, prior) + 0.5) / (sizes[1] + 1)) - math.log((no + 0.5) / (sizes[0] + 1)))
            if e and no > yes:
                model.weights[k, e] = 0.0
    x = np.array([squash(total(model, own)) for _, own in counting])
    model.slope, model.shift = curve(x, np.array([float(y) for y, _ in counting]))
    return model


def scores(model: Model, matches: Matches, texts: list[str | None]) -> list[float]:
    return [1 / (1 + math.exp(-max(-500.0, min(500.0, model.slope * squash(total(model, hits(matches, t, model.window))) + model.shift)))) for t in texts]


def score(df: DataFrame, text: str, model: Model) -> DataFrame:
    """``df`` without ``text``, with score."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def start():
        matches = Matches(Lexicon(sent.value.terms, first=True), sent.value.clean)
        return lambda values: [pa.array(scores(sent.value, matches, values.to_pylist()), pa.float64())]

    return beside(df, text, [pa.field("score", pa.float64())], start)
