"""Sides of joins that may be broadcast because they were counted, and small tables that are much work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.lineage import cut

#: Rows of a few numbers each that may be broadcast; larger tables are joined in a shuffle.
SENT_ROWS = 200_000


def small(table: DataFrame) -> DataFrame:
    """``table`` (read from disk, a few numbers a row), to be broadcast if it has been counted and is small enough."""
    return F.broadcast(table) if table.limit(SENT_ROWS + 1).count() <= SENT_ROWS else table


def spread(table: DataFrame) -> DataFrame:
    """``table``, whose rows are few bytes but much work, dealt out evenly to as many tasks as a shuffle has: a small file would be read, and all of that work done, by one."""
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))


#: Rows that are as much work as a task of many expressions is before its first row.
TASK_ROWS = 1_000


def shared_out(table: DataFrame) -> DataFrame:
    """As ``spread``, for a table read from disk whose work takes long to set up in each task: to no more tasks than TASK_ROWS rows each need."""
    most = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(max(1, min(most, -(-table.count() // TASK_ROWS))))


def dealt(table: DataFrame, *keys: str) -> DataFrame:
    """``table`` dealt out by keys to as many tasks as a shuffle has, for a join that is much work for few bytes: its tasks would be merged into one."""
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def parted(table: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``table`` whose keys no other row has, and those of shared keys: only keys are shuffled to tell them apart, and what follows need not move the first ones."""
    shared = small(cut(table.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return table.join(shared, same, "left_anti"), table.join(shared, same, "left_semi")
