"""Captions, much work for few bytes, are dealt out to all tasks."""

from folioscope.plans import registry


def test_captions_are_not_one_task(spark, sf):
    assert registry.QUERIES["h15_captions"](spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
