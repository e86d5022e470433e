"""Secrets in texts: three written rules, and strings that look drawn at random [native].

The rules give base spans: an assignment to a password, token or key, an access key id, and a long run of hexadecimal digits.  In what is left of the
text every run of ``TOKEN`` characters with a letter is weighed by two character Markov models of order one, of random strings and of ordinary identifiers.  The
logarithm of their likelihood ratio is the sum of one weight for each pair of neighbouring characters; runs that reach ``least`` in all and ``mean`` for each character
are added spans.

Both models are counts of pairs over labelled samples with half a count added to each pair.  ``labelled`` makes them from a bounded number of the table's texts: random are
the values that the rules found and the texts' digests, in hexadecimal and base 64 digits; ordinary are the words outside of base spans.  A sample counts once, however often it
occurs, so copies of a text are no evidence.  Any table of (token, random) trains the same models.

Where spans lie is known from the lengths of what stands between matches, summed up in groups of about the root of their number.  All work but training is
on a row of its own; nothing is shuffled.

Defined results: null and empty texts have no spans; offsets are code points, ends are exclusive; spans of one kind never overlap, those of two rules may, added spans
overlap none; a weight of a pair that no sample holds is that of the added counts; without samples all weights are 0 and nothing is added; texts of any length are read whole;
repeated rows are returned as often as they came; an empty table gives an empty result; the whole input row travels in a struct, so other columns' names don't matter.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import ROW, bounded_batches, carried, cut


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN = "(" + "|".join(map(_either, NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Of shorter runs nothing is a match, and no part of a longer run is.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_=-]{16,}"
WORD = "[A-Za-z0-9+/_=-]{4,}"
KINDS = ["assign", "access", "hex", "markov"]
#: Classes of characters: 0 is the start of a token.
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
CLASSES = len(ALPHABET) + 1
SAMPLED, LONGEST = 2_000, 20_000


@dataclass
class Model:
    """For each pair of classes the thousandfold logarithm of the ratio of its probabilities, random over ordinary."""

    weights: list[int]

    def ratio(self, token: Column) -> Column:
        """A token's log-likelihood ratio, in thousandths."""
        classes = F.split(F.lit(",".join(str(ALPHABET.find(chr(c)) + 1) for c in range(128))), ",").cast("array<int>")
        weights = F.split(F.lit(",".join(map(str, self.weights))), ",").cast("array<int>")
        start = F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("sum"))

        def step(s: Column, c: Column) -> Column:
            now = F.get(classes, F.ascii(c))
            return F.struct(now.alias("last"), (s["sum"] + F.get(weights, s["last"] * CLASSES + now)).alias("sum"))

        return F.aggregate(F.filter(F.split(token, ""), lambda c: c != ""), start, step)["sum"]

    def random(self, token: Column, least: int, mean: int) -> Column:
        return self.ratio(token) >= F.greatest(F.lit(least), mean * F.length(token))


def running(values: Column) -> Column:
    """Sums of the values up to each one; sums of groups of about the root of their number stand in between."""
    group = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(values))).cast("int"))
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    wholes = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / group).cast("int")), lambda g: add(F.slice(values, g * group + 1, group)))
    packed = F.struct(values.alias("v"), wholes.alias("w"), group.alias("g"))
    # The groups' sums are made once: an array of one struct is what a lambda's argument can be.
    of = lambda p: F.transform(p["v"], lambda x, i: add(F.slice(p["w"], F.lit(1), F.floor(i / p["g"]).cast("int"))) + add(F.slice(p["v"], F.floor(i / p["g"]).cast("int") * p["g"] + 1, i % p["g"] + 1)))
    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(F.get(F.transform(F.array(packed), of), F.lit(0)))


def _long(x: Column) -> Column:
    return F.length(x).cast("long")


def _none() -> Column:
    return F.array().cast("array<string>")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def between(text: Column, pattern: str, found: Column) -> Column:
    """What stands before each match and after the last one."""
    return F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(_none())


def spans(kind: int, found: Column, pieces: Column) -> Column:
    """(start, kind, end, token) of the matches."""
    n = F.size(found)
    before = F.zip_with(F.slice(pieces, F.lit(1), n), F.concat(F.array(F.lit("")), F.slice(found, F.lit(1), F.greatest(n - 1, F.lit(0)))), lambda p, m: _long(p) + _long(F.coalesce(m, F.lit(""))))
    placed = F.zip_with(running(before), found, lambda s, m: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + _long(m)).alias("end"), m.alias("token")))
    return F.when(n > 0, placed).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint,token:string>>"))


def valued(token: Column) -> Column:
    """Whether an assignment's value has six characters."""
    return F.length(F.regexp_extract(token, ASSIGN, 2)) >= 6


def blanked(text: Column, found: Column, pieces: Column, taken) -> Column:
    """The text with spaces for the matches that are ``taken``."""
    joined = F.array_join(F.zip_with(pieces, found, lambda p, m: F.concat(p, F.when(m.isNull(), F.lit("")).when(taken(m), F.repeat(F.lit(" "), F.length(m))).otherwise(m))), "")
    return F.when(F.size(found) > 0, joined).otherwise(text)


def based(df: DataFrame) -> DataFrame:
    """``df`` (with ``__t``) and ``base``, its base spans by start and kind, and ``__rest``, the text without them."""
    lower = F.lower("__t")
    named = F.greatest(*[lower.contains(n) for n in ("password", "passwd", "secret", "token", "apikey", "api_key")])
    # Each step is a projection of its own and its results are used more than once, so that they are made once.
    out = df.withColumn("__a", F.when(named, matches(F.col("__t"), ASSIGN)).otherwise(_none()))
    out = out.withColumn("__k", F.when(F.col("__t").contains("AKIA"), matches(F.col("__t"), ACCESS)).otherwise(_none())).withColumn("__h", matches(F.col("__t"), HEX))
    cuts = {"__a": ASSIGN, "__k": ACCESS, "__h": HEX}
    out = out.select("*", *[between(F.col("__t"), p, F.col(c)).alias(f"{c}p") for c, p in cuts.items()])
    assigned = F.filter(spans(0, F.col("__a"), F.col("__ap")), lambda s: valued(s["token"]))
    base = F.array_sort(F.concat(assigned, spans(1, F.col("__k"), F.col("__kp")), spans(2, F.col("__h"), F.col("__hp"))))
    out = out.select("*", base.alias("base"), blanked(F.col("__t"), F.col("__a"), F.col("__ap"), valued).alias("__r1"))
    both = f"{ACCESS}|{HEX}"
    out = out.withColumn("__b", F.when(F.size("__k") + F.size("__h") > 0, matches(F.col("__r1"), both)).otherwise(_none())).withColumn("__bp", between(F.col("__r1"), both, F.col("__b")))
    out = out.withColumn("__rest", blanked(F.col("__r1"), F.col("__b"), F.col("__bp"), lambda m: F.lit(True)))
    return out.drop("__a", "__k", "__h", "__ap", "__kp", "__hp", "__r1", "__b", "__bp")


def lettered(token: Column) -> Column:
    return token.rlike("[A-Za-z]")


def labelled(df: DataFrame, text: str, sampled: int = SAMPLED, longest: int = LONGEST) -> DataFrame:
    """(token, random), each once: from the ``sampled`` different texts of at most ``longest`` characters that have the smallest md5."""
    texts = df.select(F.col(text).alias("__t")).where((F.length("__t") > 0) & (F.length("__t") <= longest)).withColumn("m", F.md5("__t"))
    few = cut(texts.select("m").distinct().orderBy("m").limit(sampled))
    chosen = cut(texts.join(F.broadcast(few), "m").groupBy("m").agg(F.any_value("__t").alias("__t")))  # ``sampled`` rows
    parts = based(chosen)
    value = lambda s: F.when(s["kind"] == 0, F.regexp_extract(s["token"], ASSIGN, 2)).otherwise(s["token"])
    digest = F.sha2("__t", 256)
    drawn = parts.select(F.explode(F.concat(F.transform("base", value), F.array(digest, F.regexp_replace(F.base64(F.unhex(digest)), r"[\r\n]", "")))).alias("token")).distinct()
    words = parts.select(F.explode(matches(F.col("__rest"), WORD)).alias("token")).where(lettered(F.col("token"))).distinct()
    return drawn.withColumn("random", F.lit(True)).unionByName(words.withColumn("random", F.lit(False)))


def train(samples: DataFrame, token: str = "token", random: str = "random") -> Model:
    """The model of labelled tokens; null tokens and labels and characters outside of ALPHABET count nothing."""
    own = samples.select(F.col(token).alias("t"), F.col(random).cast("boolean").alias("r")).where("t is not null and r is not null")
    chars = F.filter(F.split("t", ""), lambda c: c != "")
    pairs = own.select("r", chars.alias("c")).select("r", F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), "c").alias("a"), F.col("c").alias("b"))).alias("p"))
    counts = {(r.r, r.a, r.b): r["n"] for r in pairs.where("p.b is not null").groupBy("r", "p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).where(F.col("a").isin(["", *ALPHABET]) & F.col("b").isin([*ALPHABET])).collect()}  # two numbers for each pair of classes
    if not counts:
        return Model([0] * CLASSES**2)
    weights = []
    for a in ["", *ALPHABET]:
        totals = {r: sum(counts.get((r, a, b), 0) for b in ALPHABET) + 0.5 * len(ALPHABET) for r in (True, False)}
        share = lambda r, b: math.log((counts.get((r, a, b), 0) + 0.5) / totals[r])  # noqa: B023, E731
        weights += [0, *[math.floor(1000 * (share(True, b) - share(False, b)) + 0.5) for b in ALPHABET]]
    return Model(weights)


def scan(df: DataFrame, text: str, model: Model, least: int = 10_000, mean: int = 500) -> DataFrame:
    """Rows as (``__row``, ``base``, ``spans``): the input row, its base spans, and all spans, each (start, kind, end, token) by start and kind."""
    bounded_batches(df.sparkSession)
    out = based(carried(df, __t=F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumn("__c", F.filter(matches(F.col("__rest"), TOKEN), lettered))
    # Runs without a letter aren't tokens, but what is cut must be what is kept.
    out = out.withColumn("__hit", F.exists("__c", lambda c: model.random(c, least, mean)))
    out = out.withColumn("__all", F.when(F.col("__hit"), matches(F.col("__rest"), TOKEN)).otherwise(_none())).withColumn("__p", between(F.col("__rest"), TOKEN, F.col("__all")))
    added = F.filter(spans(3, F.col("__all"), F.col("__p")), lambda s: lettered(s["token"]) & model.random(s["token"], least, mean))
    return out.select(ROW, "base", F.array_sort(F.concat("base", added)).alias("spans"))


def written(found: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
