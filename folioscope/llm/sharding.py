"""Balanced contiguous shards by global prefix sums of bytes [native].

Rows are ordered by doc_id (ties by checksum of the text, then by place in the input), range
partitioned, and each partition's bytes and rows are totalled.  The totals' prefix sums (one small
row for each partition) give each partition its global offset; a running sum inside the partition
does the rest, so no task ever sees more than its own range.  A row belongs to the shard in which
the middle of its bytes falls when the whole is cut at equal targets; shards are contiguous in
doc_id order and differ from the target by about one document.

Defined results: size is the UTF-8 bytes of the text plus 1, so empty and null texts count and no
total is zero; null doc_ids come first; repeated rows get neighbouring slots; an empty table gives
an empty result; texts of any length are only measured; one document larger than a target may leave a shard empty, never a gap in slots;
other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import cut


def byte_shards(df: DataFrame, doc_id: str, text: str, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row; slot counts from 0 in each shard."""
    utf8 = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(utf8) + 1).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"), F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", "text_crc32", "place"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once: the bounds of the ranges are sampled, so a second evaluation could cut elsewhere.
    ranged = cut(slim.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    # One row for each partition, a bounded number whatever the input.
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("size").alias("rows"))
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(whole), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(whole), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order)
    placed = ranged.select("*", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.row_number().over(inside).alias("nth")).join(F.broadcast(offsets), "part")
    middle = F.col("bytes_before") + F.col("run") - F.col("size") / 2
    cutted = placed.select("doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("nth") - 1).alias("at"), F.least(F.lit(shards - 1), F.floor(middle * shards / F.col("total"))).cast("int").alias("shard"))
    starts = cutted.groupBy("shard").agg(F.min("at").alias("start"))
    # At most ``shards`` rows.
    return cutted.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("start")).cast("long").alias("slot"))
