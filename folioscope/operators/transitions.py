"""Changes of state: messages that are due, and transactions over several items of one batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def due(outbox: DataFrame, most: int, sent_before: Column | None = None) -> DataFrame:
    """The first ``most`` messages of each kind, oldest first: pending ones and, with a moment, those last sent before it.

    ``outbox``: outbox_id, kind, created, status, attempts, sent.
    """
    wanted = F.col("status") == "pending"
    if sent_before is not None:
        wanted = wanted | ((F.col("status") == "sent") & F.coalesce(F.col("sent") < sent_before, F.lit(False)))
    first = Window.partitionBy("kind").orderBy("created", "outbox_id")
    return outbox.where(wanted).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= most)


def relayed(outbox: DataFrame, most: int, now: Column, send: Callable[[DataFrame], None], sent_before: Column | None = None) -> DataFrame:
    """Sends what is due and gives the outbox with it marked as sent.

    Sending comes before marking: if ``send`` fails nothing is marked, and what it had sent by then is sent again, so every message is sent once at least.
    """
    batch = due(outbox, most, sent_before)
    send(batch)
    marked = batch.select("outbox_id", F.lit(True).alias("done"))
    j = outbox.join(marked, "outbox_id", "left")
    done = F.coalesce("done", F.lit(False))
    return j.select("outbox_id", "kind", "created", F.when(done, "sent").otherwise(F.col("status")).alias("status"), (F.col("attempts") + done.cast("int")).alias("attempts"), F.when(done, now).otherwise(F.col("sent")).alias("sent"))


def _held(items: DataFrame, ops: DataFrame) -> DataFrame:
    """Each operation with what stands against it, if anything."""
    o = ops.groupBy("txn", "key").agg(F.min("op").alias("op"), F.min("expected").alias("expected"), F.count(F.lit(1)).alias("n"))
    first = ops.groupBy("key").agg(F.min("txn").alias("first"))
    j = o.join(first, "key").join(items.select("key", "revision", F.lit(True).alias("there")), "key", "left")
    there, create = F.col("there").isNotNull(), F.col("op") == "create"
    problem = (
        F.when(F.col("n") > 1, "repeated key").when(F.col("txn") != F.col("first"), "in progress").when(create & there, "exists").when(~create & ~there, "missing")
        .when(~create & ~F.col("revision").eqNullSafe(F.col("expected")), "revision")
    )
    return j.select("txn", "key", "op", "revision", problem.alias("problem"))


def decided(items: DataFrame, ops: DataFrame) -> DataFrame:
    """txn, items, outcome (committed, retry, failed), problem of the transactions of a batch.

    ``items``: key, revision; ``ops``: txn, key, op (create, update, check, delete), expected.  A transaction commits if all of its operations can be done
    on the items as they are and it is the first of the batch on each of its keys; one that only had to wait may be tried again.
    """
    t = _held(items, ops).groupBy("txn").agg(F.count(F.lit(1)).alias("items"), F.min("problem").alias("problem"))
    return t.select("txn", "items", F.when(F.col("problem").isNull(), "committed").when(F.col("problem") == "in progress", "retry").otherwise("failed").alias("outcome"), "problem")


def applied(items: DataFrame, ops: DataFrame) -> DataFrame:
    """key, revision of the items after the batch: created at 1, updated by one, deleted; every operation of a committed transaction and none of another."""
    held = _held(items, ops)
    won = held.groupBy("txn").agg(F.count("problem").alias("n")).where("n = 0").select("txn")
    # A key has one first transaction, so at most one operation.
    done = held.join(won, "txn").where("op <> 'check'").select("key", "op")
    revision = F.when(F.col("op") == "update", F.col("revision") + 1).when(F.col("op") == "create", 1).otherwise(F.col("revision"))
    return items.join(done, "key", "full_outer").where("op is null or op <> 'delete'").select("key", revision.alias("revision"))
