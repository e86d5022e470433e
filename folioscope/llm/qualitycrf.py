"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad.  Its features are shares of kinds of characters, repeated words, lengths,
and the same of the lines beside it; a chain of two states joins neighbouring lines.  Labels are given
for documents only, so in training all lines of a document carry its label.  Forward-backward gives
each line's probability of being good; a document's quality is their mean weighted by line length,
brought to the labels' scale by a logistic curve fitted on the same training documents.

Training uses a bounded sample: about ``per_label`` labelled documents of either label, chosen by a hash
of the id, of at most ``most_lines`` lines each.  Scoring reads whole texts of any length and sees nothing but them.

Defined results: null text is one empty line; any text has a score from 0 to 1; if the sample lacks a
label, every score is the share of label 1 in it (0.5 if it is empty); repeated label rows count once, ids with both
labels not at all; repeated rows repeat; an empty table gives an empty result; clashing names: see ``common.beside``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from folioscope.llm.common import beside, slices
from folioscope.llm.wordhash import words

LOWER, UPPER, DIGIT, WHITE, SYMBOL, SHOUT, BAR, STOP, WIDE = range(9)
KIND = np.full(256, SYMBOL, np.uint8)
for _chars, _kind in ((range(97, 123), LOWER), (range(65, 91), UPPER), (range(48, 58), DIGIT), ([32, *range(9, 14)], WHITE), (b"!?", SHOUT), (b"|", BAR), (b".,;:'\"()-", STOP), (range(128, 256), WIDE)):
    KIND[list(_chars)] = _kind
#: Features of a line itself, and which of them are also taken from the lines beside it.
OWN, BESIDE = 14, [1, 3, 4, 5, 7, 8, 9]
N = OWN + 2 * len(BESIDE)
#: Labels are of documents, so training sees no change inside one and would let neighbours outweigh a line's own features.
MOST_STAY = 1.0
#: In training, lines of a chain, and lines with padding of the chains that are worked on at once.
CHAIN, CELLS = 512, 32_768


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, each line's length in bytes, and where each text's lines begin (one more for the end)."""
    data = np.frombuffer("\n".join(texts).encode("utf-8"), np.uint8)
    breaks = np.flatnonzero(data == 10)
    starts, ends = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(data)]))
    first = np.concatenate(([0], np.cumsum([t.count("\n") + 1 for t in texts])))
    length = (ends - starts).astype(np.float64)
    kind = KIND[data]
    share = np.zeros((len(starts), 9))
    for k in range(9):
        sums = np.concatenate(([0], np.cumsum(kind == k, dtype=np.int64)))
        share[:, k] = sums[ends] - sums[starts]
    ws, we, h = words(data)
    line = np.searchsorted(starts, ws, side="right") - 1
    n_words = np.bincount(line, minlength=len(starts)).astype(np.float64)
    same = np.zeros(len(ws), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    again = np.bincount(line[same], minlength=len(starts))
    keyed = np.unique((line.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    distinct = np.bincount((keyed >> np.uint64(40)).astype(np.int64), minlength=len(starts))
    long_words = np.bincount(line, weights=(we - ws > 18), minlength=len(starts))
    solid, per = np.maximum(length - share[:, WHITE], 1), np.maximum(n_words, 1)
    letters = np.maximum(share[:, LOWER] + share[:, UPPER] + share[:, WIDE], 1)
    own = np.stack([
        np.ones(len(starts)), np.sqrt(share[:, SYMBOL] / solid), share[:, DIGIT] / solid, np.sqrt(share[:, SHOUT] / solid), np.sqrt(share[:, BAR] / solid), share[:, UPPER] / letters, share[:, STOP] / solid,
        again / per, 1 - distinct / per, (n_words > 0) & (share[:, UPPER] > share[:, LOWER]), np.log1p(n_words) / 4, np.minimum(solid / per, 30) / 8, long_words / per, (n_words == 0),
    ], axis=1).astype(np.float64)
    before, after = np.vstack((np.zeros((1, OWN)), own[:-1])), np.vstack((own[1:], np.zeros((1, OWN))))
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.hstack((own, before[:, BESIDE], after[:, BESIDE])), length, first


@dataclass
class Model:
    weights: np.ndarray  # of the features, for good over bad
    stay: float  # of two neighbours with the same label over two with different ones
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None


def marginals(scores: list[float], stay: float) -> list[float]:
    """Probability of good for each line of a chain, from its score (good over bad) and the gain of equal neighbours."""
    # Messages are log odds: m(x) = log((e^(x + stay) + 1) / (e^x + e^stay)).
    def passed(x: float) -> float:
        return _soft(x + stay, 0.0) - _soft(x, stay)

    n = len(scores)
    ahead = [0.0] * n
    for i in range(1, n):
        ahead[i] = passed(ahead[i - 1] + scores[i - 1])
    out, back = [0.0] * n, 0.0
    for i in range(n - 1, -1, -1):
        out[i] = 1 / (1 + math.exp(-max(-500.0, min(500.0, ahead[i] + scores[i] + back))))
        back = passed(back + scores[i])
    return out


def _soft(a: float, b: float) -> float:
    """log(e^a + e^b)"""
    return (a if a > b else b) + math.log1p(math.exp(-abs(a - b)))


def chains(docs: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of chains of like length as (features, mask, label, lines of the document each is from).

    A document longer than CHAIN lines is several chains; a group has at most CELLS lines with its padding.
    """
    parts = sorted(((x[at : at + CHAIN], float(y), len(x)) for x, y in docs for at in range(0, len(x), CHAIN)), key=lambda p: len(p[0]))
    out, at = [], 0
    while at < len(parts):
        stop = at + 1
        while stop < len(parts) and (stop + 1 - at) * len(parts[stop][0]) <= CELLS:
            stop += 1
        own, m = parts[at:stop], len(parts[stop - 1][0])
        x, mask = np.zeros((len(own), m, N), np.float32), np.zeros((len(own), m), bool)
        for i, (f, _, _) in enumerate(own):
            x[i, : len(f)], mask[i, : len(f)] = f, True
        out.append((x, mask, np.array([y for _, y, _ in own]), np.array([float(n) for _, _, n in own])))
        at = stop
    return out


def gradient(w: np.ndarray, stay: float, x: np.ndarray, mask: np.ndarray, y: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Of the log likelihood of a group's chains, each weighed by ``each``, for the weights and ``stay``."""
    soft = np.logaddexp
    s = x @ w
    length = s.shape[1]
    ahead, back = np.zeros_like(s), np.zeros_like(s)
    for t in range(1, length):
        z = ahead[:, t - 1] + s[:, t - 1]
        ahead[:, t] = np.where(mask[:, t], soft(z + stay, 0) - soft(z, stay), 0)
    for t in range(length - 2, -1, -1):
        z = back[:, t + 1] + s[:, t + 1]
        back[:, t] = np.where(mask[:, t + 1], soft(z + stay, 0) - soft(z, stay), 0)
    p = 1 / (1 + np.exp(-np.clip(ahead + s + back, -500, 500)))
    out = np.zeros(N + 1)
    out[:N] = np.einsum("dl,dln->n", np.where(mask, y[:, None] - p, 0) * each[:, None], x)
    # Expected number of equal neighbours against all of them.
    a, b = ahead[:, :-1] + s[:, :-1], back[:, 1:] + s[:, 1:]
    both, none, one = a + b + stay, np.full_like(a, stay), soft(a, b)
    equal = np.exp(soft(both, none) - soft(soft(both, none), one))
    out[N] = (np.where(mask[:, 1:], 1 - equal, 0).sum(1) * each).sum()
    return out


def fit(docs: list[tuple[np.ndarray, int]], rounds: int = 150, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Maximum likelihood of the chains, each with one label for all of its lines; each document counts once."""
    groups = chains(docs)
    w, stay, share = np.zeros(N), 0.0, np.mean([y for _, y in docs])
    balance = lambda y: np.where(y > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    m1, m2, lr = np.zeros(N + 1), np.zeros(N + 1), 0.15
    for step in range(1, rounds + 1):
        # A long document doesn't outweigh a short one.
        grad = sum(gradient(w, stay, x, mask, y, balance(y) / n) for x, mask, y, n in groups) / len(docs)
        grad -= decay * np.append(w, 4 * stay)
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        move = lr * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, stay = w + move[:N], min(MOST_STAY, max(0.0, stay + move[N]))
    return w, stay


def mean_good(model: Model, features: np.ndarray, length: np.ndarray) -> float:
    weight = length + 1
    return float(np.dot(marginals((features @ model.weights).tolist(), model.stay), weight) / weight.sum())


def logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method with a little decay."""
    theta, design = np.array([1.0, 0.0]), np.stack((x, np.ones_like(x)), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -50, 50)))
        hess = design.T @ (design * (p * (1 - p))[:, None]) + 0.05 * np.eye(2)
        move = np.linalg.solve(hess, design.T @ (y - p) - 0.05 * (theta - np.array([0.5, 0.0])))
        theta = theta + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return max(0.05, float(theta[0])), float(theta[1])


def sampled(labels: DataFrame, doc_id: str, label: str, wanted: dict[int, int]) -> DataFrame:
    """(id, y): about ``wanted`` ids of either label, chosen by a hash of the id; an id counts once, one with both labels not at all."""
    given = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    usable = given.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("id", "y")
    counts = {r.y: r.n for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    u = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("y") == 1, min(1.0, wanted[1] / counts.get(1, 1))).otherwise(min(1.0, wanted[0] / counts.get(0, 1)))
    return usable.where(u < share)


def with_texts(df: DataFrame, some: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text, y): the least text of each id of ``some``, a sample that is small by construction."""
    met = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(some), "id")
    return met.groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y")


def train(df: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, per_label: int = 1000, most_lines: int = 5000) -> Model:
    """``labels``: the rows to learn from only; texts of more than ``most_lines`` lines teach nothing, so that the sample is bounded in bytes."""
    own = with_texts(df, sampled(labels, doc_id, label, {1: per_label, 0: per_label}), doc_id, text)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, y, t in zip(batch.column("id").cast(pa.string()).to_pylist(), batch.column("y").to_pylist(), batch.column("text")):
                t = t.as_py() or ""
                if t.count("\n") < most_lines:
                    x, length, _ = line_features([t])
                    rows.append((i, y, x.astype(np.float32).tobytes(), length.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.binary(), pa.binary()))], names=["id", "y", "x", "length"])

    rows = sorted(own.mapInArrow(features, "id string, y int, x binary, length binary").collect(), key=lambda r: (r.id, r.y, r.x))
    docs = [(np.frombuffer(r.x, np.float32).reshape(-1, N), r.y, np.frombuffer(r.length)) for r in rows]
    if len({y for _, y, _ in docs}) < 2:
        return Model(np.zeros(N), 0.0, constant=float(np.mean([y for _, y, _ in docs])) if docs else 0.5)
    model = Model(*fit([(x, y) for x, y, _ in docs]))
    model.slope, model.shift = curve(np.array([logit(mean_good(model, x, n)) for x, _, n in docs]), np.array([float(y) for _, y, _ in docs]))
    return model


def scores(model: Model, texts: list[str | None]) -> list[float]:
    if model.constant is not None:
        return [model.constant] * len(texts)
    x, length, first = line_features([t or "" for t in texts])
    s, out = x @ model.weights, []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        weight = length[a:b] + 1
        good = float(np.dot(marginals(s[a:b].tolist(), model.stay), weight) / weight.sum())
        out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, model.slope * logit(good) + model.shift)))))
    return out


def score(df: DataFrame, text: str, model: Model) -> DataFrame:
    """``df`` without ``text``, with score."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    start = lambda: lambda values: [pa.array(scores(sent.value, values.to_pylist()), pa.float64())]
    return beside(df, text, [pa.field("score", pa.float64())], start, 128)


def score_column(text: str, model: Model, spark: SparkSession) -> Column:
    """The score as a column, so that other columns needn't leave the JVM."""
    sent = spark.sparkContext.broadcast(model)

    @arrow_udf(T.DoubleType())
    def scored(t: pa.Array) -> pa.Array:
        out: list[float] = []
        for at, n in slices(t, 128):
            out += scores(sent.value, t.slice(at, n).to_pylist())
        return pa.array(out, pa.float64())

    return scored(F.col(text))
