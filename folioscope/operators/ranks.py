"""Exact nearest-rank percentiles of groups of any size.

A sketch of bounded size gives, for each group and rank, two values that the wanted one lies between.  A second pass counts what is below and keeps the different values in between with
their counts, a few in ten thousand; the wanted value is found among these by running sums.  A rank that isn't between its bounds (the sketch promises that it is) is looked for among
all values of its group.  No task ever holds a group's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.lineage import cut
from folioscope.sizes import small

#: The sketch's accuracy; its ranks are off by at most one in so many.
ACCURACY = 10_000


def nearest_ranks(df: DataFrame, by: list[str], value: str, percents: dict[str, int]) -> DataFrame:
    """``by`` and, for each name, the smallest value that so many percent of a group's values are at or below; null values don't count, groups without values have no row."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    names, margin = list(percents), 2 / ACCURACY
    ends = [min(max(percents[n] / 100 + d, 0.0), 1.0) for n in names for d in (-margin, margin)]
    bounds = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", ends, ACCURACY).alias("__at"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
    wanted = [F.struct(F.lit(n).alias("name"), F.greatest(F.lit(1), F.expr(f"(__n * {percents[n]} + 99) div 100")).alias("rank"), F.col("__at")[2 * i].alias("low"), F.col("__at")[2 * i + 1].alias("high")) for i, n in enumerate(names)]
    asked = cut(bounds.select(*by, "__min", "__max", F.explode(F.array(*wanted)).alias("w")).select(*by, "__min", "__max", "w.*"))
    found = _among(rows, by, asked)
    left = cut(found.where("value is null").select(*by, "name"))
    if left.limit(1).count():
        open_ = small(left).select(*[F.col(c).alias(f"__{c}") for c in [*by, "name"]])
        again = asked.join(open_, _same([*by, "name"]), "left_semi")
        found = found.where("value is not null").unionByName(_among(rows, by, again.withColumns({"low": F.col("__min"), "high": F.col("__max")})))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def _same(columns: list[str]):
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return out


def _among(rows: DataFrame, by: list[str], asked: DataFrame) -> DataFrame:
    """by, name, value: the value of each rank if it lies between its bounds, else null."""
    a = small(asked).select(*[F.col(c).alias(f"__{c}") for c in by], "name", "rank", "low", "high")
    met = rows.join(a, _same(by))
    # What is below the bounds is only counted: one row for each task and rank.
    held = met.where(F.col("__v") <= F.col("high")).groupBy(*by, "name", "rank", F.when(F.col("__v") >= F.col("low"), F.col("__v")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by, "name").orderBy(F.col("value").asc_nulls_first())
    summed = held.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = summed.where(F.col("upto") >= F.col("rank")).groupBy(*by, "name").agg(F.min_by(F.struct("value"), "upto").alias("x")).select(*by, "name", "x.value")
    every = asked.select(*by, "name")
    f = first.select(*[F.col(c).alias(f"__{c}") for c in [*by, "name"]], "value")
    return cut(every.join(f, _same([*by, "name"]), "left").select(*by, "name", "value"))
