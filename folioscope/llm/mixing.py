"""Mixing sources to target weights by Poisson replication [native].

A source's target weight times the target size, over the source's own size, is the mean repetition
rate of its documents.  Each document inverts a Poisson distribution of that mean at a uniform
number made from a hash of the seed and its doc_id, is exploded by the count, and all copies are
shuffled globally by a hash of (seed, doc_id, copy).  No document is sampled away except by a
count of 0, which the distribution itself gives; the expected size of each source is its target.

Rates above ``MOST_MEAN`` are sums of independent Poisson counts of equal smaller means, one hash
each, so that no probability underflows.  A source's cumulative probabilities are made once.

Sizes are UTF-8 bytes plus 1.  Without weights, a source's weight is its size to the power
``alpha``.  Rates are broadcast while there are at most ``MOST_SOURCES`` sources; beyond that they are
joined on (source, salt) so that a hot source is spread.

Defined results: a null source is a source of its own; a source missing from the weights has weight
0 and no copies; null text has size 1; null doc_id hashes as the empty string; repeated rows of a
doc_id get the same count, and their copies the same key; there are no other ties; texts of any length are only measured; an empty
table gives an empty result; rows travel in a struct, so the names of other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_MEAN, MOST_SOURCES, SALTS = 200.0, 10_000, 64
#: Hash digits that make a uniform number: 52 bits, exact in a double.
DIGITS, SPAN = 13, float(1 << 52)


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    text = F.concat_ws(":", *[F.lit(str(p)) if isinstance(p, int) else p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double") / F.lit(SPAN)


def cumulative(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as far as a 52-bit uniform number can tell them from 1."""
    far = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    first = F.exp(-mean)
    steps = F.aggregate(
        F.sequence(F.lit(1), far),
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all")),
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), (s["c"] + s["p"] * mean / k).alias("c"), F.concat(s["all"], F.array(s["c"] + s["p"] * mean / k)).alias("all")),
    )
    return steps["all"]


def rates(df: DataFrame, source: str, text: str, weights: dict[str | None, float] | None = None, alpha: float = 0.5, target_bytes: int | None = None) -> DataFrame:
    """(source, rate): the mean number of copies that brings each source to its share of the target."""
    size = (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long")
    sizes = df.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(alpha)))
    else:
        given = df.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        weighed = sizes.join(given, sizes["source"].eqNullSafe(given["name"]), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    # One row, as a scalar subquery beside one row for each source.
    whole = weighed.agg(F.struct(F.sum("weight").alias("weights"), F.sum("size").alias("bytes")).alias("whole")).scalar()
    target = whole["bytes"] if target_bytes is None else F.lit(target_bytes)
    return weighed.select("source", F.coalesce(F.try_divide(F.col("weight") * target, whole["weights"] * F.col("size")), F.lit(0.0)).alias("rate"))


def replicate(df: DataFrame, doc_id: str, source: str, text: str, seed: int = 42, **target) -> DataFrame:
    """The rows of ``df`` as ``__row``, with ``rate``, ``copy`` (from 1) and ``shuffle_key``, one for each copy, not yet shuffled."""
    of = rates(df, source, text, **target).select(
        "source", "rate", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_MEAN)).cast("int").alias("parts")
    ).withColumn("cdf", cumulative(F.col("rate") / F.col("parts")))
    rows = df.select(F.struct("*").alias("__row"), F.col(source).alias("__source"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("__id"))
    n = df.select(F.count_distinct(source), F.max(F.col(source).isNull().cast("int"))).first()
    if (n[0] or 0) + (n[1] or 0) <= MOST_SOURCES:
        joined = rows.join(F.broadcast(of), rows["__source"].eqNullSafe(of["source"]))
    else:
        spread = of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, salted["__source"].eqNullSafe(spread["source"]) & (salted["__salt"] == spread["salt"]))
    one = lambda j: F.size(F.filter("cdf", lambda c: c <= uniform(seed, F.col("__id"), j.cast("string"))))
    single = uniform(seed, F.col("__id"), "1")
    with_u = joined.withColumn("__u", single)
    count = F.when(F.col("parts") == 1, F.size(F.filter("cdf", lambda c: c <= F.col("__u")))).otherwise(F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda a, j: a + one(j)))
    counted = with_u.select("__row", "__id", "rate", count.alias("n")).where("n > 0")
    return counted.select("__row", "__id", "rate", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("__row", "rate", "copy", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), "__id", F.col("copy").cast("string"))).alias("shuffle_key")).withColumn("copy", F.col("copy").cast("long"))


def shuffled(copies: DataFrame) -> DataFrame:
    """All copies in the order of their keys inside partitions that the keys choose: a global shuffle without a sampling pass."""
    parts = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")
