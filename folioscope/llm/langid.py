"""Language identification: the family first, then one-versus-one linear SVMs inside it.

Features are hashed byte trigrams of the lower-cased text whose non-letters are spaces, as shares of
the text's trigrams.  Every classifier is a linear SVM (hinge loss, dual coordinate descent): between two families, or
with more of them between each and the rest, and then between two languages of a family, where each pair votes
and the summed margins break ties.  Weights are one table of WIDTH rows and a column for each classifier, so a text costs
a gather and a sum, whatever its length, and whole texts are read.

Training uses a bounded sample: at most about ``per_language`` labelled texts of each language (the
share that brings its expected number there, chosen by a hash of id and text), and every labelled language
is learned.  Weights take 256 KB for each classifier, so they grow with the number of families and with the
square of the languages inside one.  Only text and language of the rows given are seen.

Defined results: text that is null or has no letter (Unicode category L) is ``und`` with score 0; ties go to the first
name; languages outside FAMILIES are families of their own; with a single language it is always
predicted; without any, ``und``; a repeated row is learned from once; repeated rows repeat; an empty table gives
an empty result; clashing names: see ``common.beside``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import beside

#: Language codes of some families.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "pt", "it", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
BITS = 16
WIDTH = 1 << BITS
#: Bytes of weights that may go to every executor: some 4,000 classifiers; more is an error, never a language left out.
MOST_SENT = 1 << 30
#: Bytes as letters: ASCII letters and all bytes of longer characters stay, the rest are spaces.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LETTER = regex.compile(r"\p{L}")


def grams(text: str | None) -> np.ndarray | None:
    """Hashes of the trigrams of a text; None if it has no letter."""
    if not text or not LETTER.search(text):
        return None
    b = np.frombuffer(b" " + text.lower().encode("utf-8").translate(LETTERS) + b" ", np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = code[(b[:-2] != 32) | (b[1:-1] != 32)]  # runs of spaces say nothing
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


@dataclass
class Model:
    families: list[str]
    languages: dict[str, list[str]]
    pairs: list[tuple[str, str, str | None]]  # level ("" or a family), first, second (None: all others)
    weights: np.ndarray  # WIDTH x pairs
    bias: np.ndarray


def svm(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 10.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM by dual coordinate descent; rows are (indices, values)."""
    w, bias = np.zeros(WIDTH + 1), 1.0
    alpha = np.zeros(len(x))
    norm = np.array([float(v @ v) + bias * bias for _, v in x])
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            at, v = x[i]
            gradient = y[i] * (w[at] @ v + w[WIDTH] * bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), c * weight[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * v
                w[WIDTH] += step * bias
                alpha[i] = new
    return w[:WIDTH], float(w[WIDTH] * bias)


#: Shares of trigrams are small; this brings a text's norm near 1.
SCALE = 10.0


def sample(labelled: DataFrame, doc_id: str, text: str, lang: str, per_language: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    usable = labelled.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    u = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text"), F.lit(1 << 30)) / float(1 << 30)
    # A repeated row teaches once; only texts of the sample are compared.
    chosen = usable.where(u < F.try_element_at(share, F.col("lang"))).dropDuplicates(["id", "text", "lang"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t, lang_ in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                g = grams(t.as_py())
                if g is not None and len(g):
                    at, n = np.unique(g, return_counts=True)
                    rows.append((str(i), lang_, at.astype(np.int32).tobytes(), (n * (SCALE / len(g))).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary(), pa.binary()))], names=["id", "lang", "at", "v"])

    found = chosen.mapInArrow(features, "id string, lang string, at binary, v binary").collect()
    return sorted(((r.lang, np.frombuffer(r.at, np.int32), np.frombuffer(r.v, np.float32).astype(np.float64), r.id) for r in found), key=lambda r: (r[0], r[3], len(r[1])))


def train(labelled: DataFrame, doc_id: str, text: str, lang: str, per_language: int = 500) -> Model:
    rows = sample(labelled, doc_id, text, lang, per_language)
    names = sorted({r[0] for r in rows})
    of: dict[str, list[str]] = {}
    for n in names:
        of.setdefault(FAMILY_OF.get(n, n), []).append(n)
    families = sorted(of)
    # Two families: one against the other.  More: each against the rest, so that weights grow with the families, not with their pairs.
    top = [("", families[0], families[1])] if len(families) == 2 else [("", f, None) for f in families if len(families) > 2]
    pairs = top + [(f, a, b) for f in families for a, b in combinations(of[f], 2)]
    weights, bias = np.zeros((WIDTH, max(1, len(pairs))), np.float32), np.zeros(max(1, len(pairs)))
    for k, (level, a, b) in enumerate(pairs):
        label = (lambda n: FAMILY_OF.get(n, n)) if not level else (lambda n: n)
        own = [(r, 1.0 if label(r[0]) == a else -1.0) for r in rows if (label(r[0]) in (a, b) if b else True)]
        w, bias[k] = svm([(r[1], r[2]) for r, _ in own], np.array([y for _, y in own]))
        weights[:, k] = w
    return Model(families, of, pairs, weights, bias)


def choose(names: list[str], margins: dict[tuple[str, str | None], float]) -> tuple[str, float]:
    """The name with most votes of its pairs (summed margins, then order, break ties) or, against the rest, the largest margin, and a score from 0 to 1."""
    if len(names) == 1:
        return names[0], 1.0
    if all(b is None for _, b in margins):
        best = max(names, key=lambda n: (margins[n, None], -names.index(n)))
        return best, 1 / (1 + math.exp(-3 * max(-50.0, min(50.0, margins[best, None]))))
    votes = dict.fromkeys(names, 0)
    sums = dict.fromkeys(names, 0.0)
    for (a, b), m in margins.items():
        votes[a if m >= 0 else b] += 1
        sums[a] += m
        sums[b] -= m
    best = max(names, key=lambda n: (votes[n], sums[n], -names.index(n)))
    least = min(m if a == best else -m for (a, b), m in margins.items() if best in (a, b))
    return best, 1 / (1 + math.exp(-3 * max(-50.0, min(50.0, least))))


def predict(model: Model, text: str | None) -> tuple[str, float]:
    g = grams(text)
    if g is None or not len(g) or not model.families:
        return "und", 0.0
    margins = model.weights[g].sum(axis=0, dtype=np.float64) * (SCALE / len(g)) + model.bias
    by_level: dict[str, dict[tuple[str, str], float]] = {}
    for (level, a, b), m in zip(model.pairs, margins.tolist()):
        by_level.setdefault(level, {})[a, b] = m
    family, p = choose(model.families, by_level.get("", {}))
    lang, q = choose(model.languages[family], by_level.get(family, {}))
    return lang, p * q


def identify(df: DataFrame, text: str, model: Model) -> DataFrame:
    """``df`` without ``text``, with lang_pred and score."""
    if model.weights.nbytes > MOST_SENT:
        raise ValueError(f"{len(model.pairs)} classifiers take {model.weights.nbytes} bytes, more than MOST_SENT")
    sent = df.sparkSession.sparkContext.broadcast(model)  # WIDTH floats for each classifier

    def start():
        m = sent.value

        def make(values: pa.Array) -> list[pa.Array]:
            found = [predict(m, t.as_py()) for t in values]
            return [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]

        return make

    return beside(df, text, [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())], start)
