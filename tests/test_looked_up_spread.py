"""Items without an identifier are looked up by all tasks, not by the one of null."""

from pyspark.sql import functions as F

from folioscope.operators import review


def test_items_without_a_pmid_are_spread(spark):
    items = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).alias("pmid"))
    records = spark.range(0, 4000, 20).select(F.col("id").cast("string").alias("pmid"), F.lit("t").alias("title"))
    old = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = review.looked_up(items, records, r="pmid")
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert found.columns == ["id", "pmid", "r"] and found.count() == 4000 and found.where("r is not null").count() == 200
        assert max(sizes) < 2000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[1])
