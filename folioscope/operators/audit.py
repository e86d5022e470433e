"""The audit of a catalogue against a second source: nine pairs of fields, what can be compared and what differs, and who is affected.

A field is there if it is neither null nor empty; False is a value. Two values are compared in the form that ``identity.comparable`` gives their field, and a value without such a form
makes the pair incomparable.  A field's counts are one pass over its columns, so what shuffles is a row for each field and task, and a few samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import present
from folioscope.operators import identity

#: The fields and their columns in either source, samples of an issue, and the length of a work's name in one.
FIELDS = {
    "title": ("title", "openalex_title"), "year": ("year", "openalex_year"), "authors": ("authors", "openalex_authors"), "journal": ("journal", "openalex_venue"), "type": ("type", "openalex_type"), "pmid": ("pmid", "pmid_openalex"),
    "pmcid": ("pmcid", "pmcid_openalex"), "references": ("referenced_works", "openalex_referenced_works"), "oa": ("is_open_access", "openalex_is_oa"),
}
SAMPLES, NAME, AUTHORS_CAP = 3, 180, 30


def there(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.simpleString()
    if kind.startswith("array"):
        return F.coalesce(F.size(column) > 0, F.lit(False))
    return F.col(column).isNotNull() if kind == "boolean" else F.coalesce(present(column), F.lit(False))


def form(df: DataFrame, field: str, column: str) -> Column:
    """The comparable form; of a list of authors the first decides, and a list of references has to be one."""
    kind = df.schema[column].dataType.simpleString()
    if field == "authors" and kind.startswith("array"):
        return identity.comparable(field, F.try_element_at(F.col(column), F.lit(1)))
    if field == "references" and not kind.startswith("array"):
        return F.lit(None).cast("string")
    if field == "oa" and kind != "boolean":
        return F.lit(None).cast("string")
    return identity.comparable(field, F.col(column))


def forms(df: DataFrame, key: str, field: str) -> DataFrame:
    """work_id, own, other, gap, and x and y, the comparable forms: a projection of its own, as what is made of a form names it several times."""
    a, b = FIELDS[field]
    year = lambda c: F.try_to_number(F.col(c).cast("string"), F.lit("9999"))
    gap = F.abs(year(a) - year(b)).cast("int") if field == "year" else F.lit(None).cast("int")
    return df.select(F.left(F.col(key).cast("string"), F.lit(NAME)).alias("work_id"), there(df, a).alias("own"), there(df, b).alias("other"), form(df, field, a).alias("x"), form(df, field, b).alias("y"), gap.alias("gap"))


def judged(df: DataFrame, key: str, field: str) -> DataFrame:
    """work_id, field, own, other, compared, differs, gap (of years) for each row."""
    both = F.col("own") & F.col("other")
    known, differs = both & F.col("x").isNotNull() & F.col("y").isNotNull(), F.coalesce(both & (F.col("x") != F.col("y")), F.lit(False))
    return forms(df, key, field).select("work_id", F.lit(field).alias("field"), "own", "other", known.alias("compared"), differs.alias("differs"), "gap")


def coverage(df: DataFrame, key: str = "work_id") -> DataFrame:
    """field, catalogue, openalex, missing_present, both_present, compared, incomparable, differing, one_year, more_years, samples (the first three work ids that differ, comma-joined).

    Each field reads its own columns, so that a task's code stays small enough to be compiled.  Samples are a short list for each field and task; nothing is sorted or exploded.
    """
    both = F.col("own") & F.col("other")
    n = lambda x: F.count_if(x)
    counts, first = None, None
    for field in FIELDS:
        c = judged(df, key, field)
        own = c.groupBy("field").agg(
            n("own").alias("catalogue"), n("other").alias("openalex"), n(F.col("other") & ~F.col("own")).alias("missing_present"), n(both).alias("both_present"), n("compared").alias("compared"), n(both & ~F.col("compared")).alias("incomparable"),
            n("differs").alias("differing"), n(F.col("differs") & (F.col("gap") == 1)).alias("one_year"), n(F.col("differs") & (F.col("gap") > 1)).alias("more_years"),
        )
        least = c.where("differs").select(F.col("field").alias("f"), "work_id").orderBy("work_id").limit(SAMPLES)
        counts, first = (own, least) if counts is None else (counts.unionByName(own), first.unionByName(least))
    samples = first.groupBy("f").agg(F.array_join(F.array_sort(F.collect_list("work_id")), ",").alias("samples"))
    return counts.join(samples, F.col("field") == F.col("f"), "left").drop("f").withColumn("samples", F.coalesce("samples", F.lit("")))


def list_marks(df: DataFrame) -> DataFrame:
    """One row: author lists at the source's cap, reference entries, and how many of them are no work ids."""
    bad = F.filter("openalex_referenced_works", lambda v: ~F.coalesce(F.regexp_replace(F.trim(v), r"^https?://[a-z.]+/", "").rlike("^W[0-9]+$"), F.lit(False)))
    return df.agg(F.count_if(F.size("openalex_authors") == AUTHORS_CAP).alias("authors_at_cap"), F.coalesce(F.sum(F.when(F.col("openalex_referenced_works").isNotNull(), F.size("openalex_referenced_works"))), F.lit(0)).alias("references"), F.coalesce(F.sum(F.when(F.col("openalex_referenced_works").isNotNull(), F.size(bad))), F.lit(0)).alias("invalid_references"))
