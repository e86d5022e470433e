"""Counters that batches of results are folded into, each batch once.

The state is a version of three tables: counters by (counter, key), the first few samples by (kind, key), and the batches that are in it.  Sums and first samples merge in any order of batches, so a
batch that is folded again, after a crash or by a second worker, finds itself in the state and changes nothing; of two workers at once one commits and the other folds
onto what it finds then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.sources import commits

#: Samples of a kind and key, and characters of a work's name in one.
SAMPLES, NAME = 3, 180


def contributions(rows: DataFrame) -> DataFrame:
    """counter, key, n of result rows: work_id, item_index, pdf (checked, sha256_matches, doi_present, title_present, errors), recheck, original and proposals (maps), supplements, decisions (map)."""
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    one = lambda counter, key, when=F.lit(True): F.when(when, F.struct(F.lit(counter).alias("counter"), key.alias("key")))
    every = lambda counter, keys: F.transform(keys, lambda k: F.struct(F.lit(counter).alias("counter"), k.alias("key")))
    none = F.lit("")
    sound = true("pdf.sha256_matches") & true("pdf.doi_present") & true("pdf.title_present")
    plain = F.array(one("papers", none), one("pdf_checked", none, true("pdf.checked")), one("pdf_hash_verified", none, true("pdf.sha256_matches")), one("pdf_identity_confirmed", none, sound), one("doi_recheck", F.col("recheck"), F.col("recheck").isNotNull()))
    strings = F.array().cast("array<string>")
    lists = [every("pdf_error", F.coalesce("pdf.errors", strings)), every("changed_proposal", changed()), every("supplement", F.coalesce("supplements", strings)), every("decision", decided())]
    return rows.select(F.explode(F.concat(F.filter(plain, lambda x: x.isNotNull()), *lists)).alias("x")).groupBy("x.counter", "x.key").agg(F.count(F.lit(1)).alias("n"))


def changed() -> Column:
    """The proposed fields whose value isn't the original one."""
    fields = F.coalesce(F.map_keys("proposals"), F.array().cast("array<string>"))
    return F.filter(fields, lambda f: ~F.try_element_at(F.coalesce("original", F.create_map().cast("map<string,string>")), f).eqNullSafe(F.try_element_at("proposals", f)))


def decided() -> Column:
    return F.coalesce(F.transform(F.map_entries("decisions"), lambda e: F.concat_ws(":", e["key"], e["value"])), F.array().cast("array<string>"))


def first_samples(rows: DataFrame) -> DataFrame:
    """kind, key, item_index, work_id of the first SAMPLES rows of each changed field and decision."""
    kinds = F.concat(F.transform(changed(), lambda k: F.struct(F.lit("changed_proposal").alias("kind"), k.alias("key"))), F.transform(decided(), lambda k: F.struct(F.lit("decision").alias("kind"), k.alias("key"))))
    x = rows.select("item_index", F.left("work_id", F.lit(NAME)).alias("work_id"), F.explode(kinds).alias("k")).select("k.kind", "k.key", "item_index", "work_id")
    return _first(x)


def _first(samples: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("kind", "key").orderBy("item_index", "work_id"))
    return samples.withColumn("nth", nth).where(F.col("nth") <= SAMPLES).drop("nth")


def fold(rows: DataFrame, root: str, batch_id: str, tries: int = 20) -> bool:
    """Folds a batch into the state under ``root``; whether it changed it."""
    spark = rows.sparkSession
    own = spark.createDataFrame([(batch_id,)], "batch_id string")
    for _ in range(tries):
        known = commits.versions(spark, root)
        last = known[-1] if known else 0
        counters, samples, batches = contributions(rows), first_samples(rows), own
        if last:
            state = commits.snapshot(spark, root, last)
            if state["batches"].where(F.col("batch_id") == batch_id).limit(1).count():
                return False
            counters = counters.unionByName(state["counters"]).groupBy("counter", "key").agg(F.sum("n").alias("n"))
            samples, batches = _first(samples.unionByName(state["samples"])), batches.unionByName(state["batches"])
        try:
            commits.commit({"counters": counters, "samples": samples, "batches": batches}, root, follows=last)
            return True
        except commits.Superseded:
            continue
    raise commits.Superseded(f"{tries} other folds were first")


def state(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return commits.snapshot(spark, root)
