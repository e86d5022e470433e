"""Runs of words: every stretch of a text that repeats with some period as long as it can.

A run is a stretch of words with smallest period q, at least ``least`` words and ``times`` periods long, that
no neighbouring word extends with that period.  All of them are found from the longest-previous-factor array:

1. The suffixes of all texts of a batch are sorted by doubling; a text's words have numbers of their own, so that
   suffixes of two texts share no word and each text's suffixes stand together.  Neighbours in that order give the LCP array, and taking
   positions out of it from the last to the first gives LPF: how long the longest factor that begins here and earlier too is.
2. LPF cuts the text into LZ blocks.  A run that reaches over the edge of a block and ends before the next edge has a period of less
   than half of both blocks.  Main's extensions from the edge, to both sides and at each such period, give its ends; periods that don't
   share eight words with the edge can't do it (a run has at least two thirds of ``least`` matching pairs) and aren't extended.
3. A run inside a block stands in the block's earlier occurrence too, and is copied from there, from buckets by start.

A text in which no sixteen words occur twice has no run of 24 words and three periods; after the sorting that has shown it, nothing is left to do
for it.  A text is worked on whole; memory is a few dozen bytes a word.

Defined results: null and empty texts and texts without words have no runs and an empty rest; words are compared byte by byte; of
two periods of a stretch only the smaller one counts; repeated rows are returned as often as they came; an empty table gives an empty
result; other columns pass, and those that have the name of an added column get ``_in`` at their end.
"""

from __future__ import annotations

from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.common import beside, bounded_batches

#: Words that must match at one side of an edge, and those that must occur twice, for a run of LEAST words and TIMES periods.
BESIDE, TWICE = 8, 16
LEAST, TIMES = 24, 3


def sorted_suffixes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of ``keys``, ranks by BESIDE keys, and a mark on positions whose first TWICE keys occur elsewhere too."""
    n = len(keys)
    rank, twice = keys.astype(np.int64), np.zeros(n, bool)
    order = np.argsort(rank, kind="stable")
    at = np.arange(n)
    by_eight, h = rank, 1
    first = rank[order]
    while True:
        # Places ``at`` hold the suffixes ``order``, sorted by ``first``; a rank is the first place of its group.
        new = np.ones(len(at), bool)
        new[1:] = first[1:] != first[:-1]
        head = np.maximum.accumulate(np.where(new, at, 0))
        rank[order] = head
        if h == 1:
            suffixes = order.copy()
        else:
            suffixes[at] = order
        if h == BESIDE:
            by_eight = rank.copy()
        alone = new & np.append(new[1:], True)
        at, order = at[~alone], order[~alone]
        if h == TWICE:
            twice[order] = True
        if not len(at):
            return suffixes, by_eight if h >= BESIDE else rank, twice
        after = order + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[order] * (n + 1) + second
        by = np.argsort(first, kind="stable")
        order, first = order[by], first[by]
        h *= 2


def previous_factors(x: list[int], suffixes: list[int]) -> tuple[list[int], list[int]]:
    """LPF and, for each position, an earlier one from which as many words agree (-1: none)."""
    n = len(x)
    before, after, shared = [-1] * n, [-1] * n, [0] * (n + 1)
    for a, b in zip(suffixes, suffixes[1:]):
        after[a], before[b] = b, a
    same, text = 0, [*x, -1]
    for i in range(n):  # the LCP with the suffix before, one less at most from position to position
        j = before[i]
        if j < 0:
            same = 0
            continue
        end = n - max(i, j)
        while same < end and text[i + same] == text[j + same]:
            same += 1
        shared[i] = same
        same -= same > 0
    length, source = [0] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        p, q = before[i], after[i]
        left, right = shared[i], shared[q] if q >= 0 else 0
        if left >= right:
            length[i], source[i], least = left, p, right
        else:
            length[i], source[i], least = right, q, left
        if p >= 0:
            after[p] = q
        if q >= 0:
            before[q], shared[q] = p, least
    return length, source


def blocks(length: list[int], source: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, earlier start or -1) of each LZ block."""
    out, at = [], 0
    while at < len(length):
        n = length[at]
        out.append((at, at + max(n, 1), source[at] if n else -1))
        at += max(n, 1)
    return out


def same_ahead(x: np.ndarray, i: int, j: int, most: int) -> int:
    """How many words from i and from j on agree, ``most`` at most."""
    k, step = 0, 32
    while k < most:
        m = min(step, most - k)
        other = x[i + k : i + k + m] != x[j + k : j + k + m]
        at = int(other.argmax())
        if other[at]:
            return k + at
        k, step = k + m, step * 4
    return k


def same_behind(x: np.ndarray, i: int, j: int) -> int:
    """How many words before i and before j agree; i < j."""
    k, step = 0, 32
    while k < i:
        m = min(step, i - k)
        other = (x[i - k - m : i - k] != x[j - k - m : j - k])[::-1]
        at = int(other.argmax())
        if other[at]:
            return k + at
        k, step = k + m, step * 4
    return k


def at_edge(x: np.ndarray, eights: np.ndarray, start: int, edge: int, end: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """(first, end, period) of the runs that touch ``edge`` between the blocks from ``start`` and to ``end``, and end by ``end``."""
    n, found = len(x), []
    most = (end - start - 1) // 2
    if end - start <= TWICE or most < 1:
        return found
    periods = np.arange(1, most + 1)
    here = eights[edge] if edge < n else -1
    back = eights[edge - BESIDE] if edge >= BESIDE else -1

    def alike(places: np.ndarray, rank: int) -> np.ndarray:
        inside = (places >= 0) & (places < n)
        return inside & (eights[np.where(inside, places, 0)] == rank) if rank >= 0 else np.zeros(len(places), bool)

    right = periods[(periods <= end - edge) & (alike(edge + periods, here) | alike(edge + periods - BESIDE, back))]
    left = periods[(periods <= edge) & (alike(edge - periods, here) | alike(edge - periods - BESIDE, back))]
    for roots, shift in ((right, 0), (left, 1)):
        while len(roots):
            q = int(roots[0])
            root = edge - shift * q
            # One word past the block tells whether the run goes on there; then a later edge finds it.
            ahead = same_ahead(x, root, root + q, min(end + 1, n) - root - q)
            first, stop = root - same_behind(x, root, root + q), root + q + ahead
            if stop <= end and stop - first >= max(least, times * q):
                found.append((first, stop, q))
            # A root inside this stretch whose length is a multiple of q repeats what is found.
            again = (roots % q == 0) & ((edge + roots <= stop) if shift == 0 else (edge - roots >= first)) & (first <= edge <= stop) & (stop - first >= 2 * q)
            again[0] = True
            roots = roots[~again]
    return found


def runs_of(x: np.ndarray, suffixes: np.ndarray, eights: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    cuts = blocks(*previous_factors(x.tolist(), suffixes.tolist()))
    by_start: dict[int, list[tuple[int, int]]] = {}

    def add(first: int, stop: int, q: int) -> None:
        own = by_start.setdefault(first, [])
        other = next((o for o in own if o[0] == stop), None)
        if other is None:
            insort(own, (stop, q))
        elif q < other[1]:
            own[own.index(other)] = (stop, q)

    for i, (start, end, source) in enumerate(cuts):
        if i:
            for r in at_edge(x, eights, cuts[i - 1][0], start, end, least, times):
                add(*r)
        if end - start >= least + 2:
            shift = start - source
            for at in range(start + 1, end - least):
                for stop, q in by_start.get(at - shift, ())[:]:
                    if stop + shift >= end:
                        break
                    add(at, stop + shift, q)
    if cuts:
        for r in at_edge(x, eights, cuts[-1][0], len(x), len(x), least, times):
            add(*r)
    return sorted((first, stop - first, q) for first, own in by_start.items() for stop, q in own)


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    sizes = [len(t) for t in texts]
    if not sum(sizes):
        return [[] for _ in texts]
    starts = np.cumsum([0, *sizes])
    keys = np.empty(starts[-1], np.int64)
    for t, at in zip(texts, starts):
        first: dict[bytes, int] = {}
        keys[at : at + len(t)] = np.fromiter(map(first.setdefault, t, range(int(at), int(at) + len(t))), np.int64, len(t))
    suffixes, eights, twice = sorted_suffixes(keys)
    out = []
    for n, at in zip(sizes, starts):
        own = slice(at, at + n)
        out.append(runs_of(keys[own], suffixes[own] - at, eights[own], least, times) if twice[own].any() else [])
    return out


def rest(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, one space between them, without those that a run holds after its first period."""
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        for start, length, q in runs:
            depth[start + q] += 1
            depth[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]
    return b" ".join(words)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FIELDS = [pa.field("n_words", pa.int64()), pa.field("runs", pa.list_(_RUN)), pa.field("collapsed", pa.string())]


def collapsed(df: DataFrame, text: str, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``df`` without ``text``, with n_words, runs (by start, then period), and the text's words without repeated periods.

    ``least`` is at least 24 and ``times`` at least 3: what the search leaves out is only sure to be no run from there on.
    """
    if least < LEAST or times < TIMES:
        raise ValueError(f"runs are found from {LEAST} words and {TIMES} periods on")
    bounded_batches(df.sparkSession)

    def start():
        def make(values: pa.Array) -> list[pa.Array]:
            words = [(v.as_py() or "").encode("utf-8").split() for v in values]
            runs = runs_of_texts(words, least, times)
            return [
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], pa.list_(_RUN)),
                pa.array([rest(w, r).decode("utf-8") for w, r in zip(words, runs)], pa.string()),
            ]

        return make

    return beside(df, text, _FIELDS, start)
