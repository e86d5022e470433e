"""Sinks: exports, create-only objects, compare-and-swap publishing, index tables and reports."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.packing import positions


def export_csv(df: DataFrame, path: str, key: str) -> None:
    """A CSV with fixed columns, lists joined by ``; ``, sorted by key; as many part files as the data needs."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).orderBy(key).write.mode("overwrite").option("header", True).csv(path)


#: The columns of the catalogue's export in their order, and those that a row without them takes from its record.
CATALOGUE = (
    "work_id id_kind title authors year journal doi pmid pmcid openalex_id openalex_status openalex_venue openalex_year category document_type source_collection "
    "ingest_status source_note_status source_note_key pdf_key pdf_filename pdf_bytes pdf_sha256 uploaded_at"
).split()
FROM_RECORD = {"authors": "authors", "year": "publication_year", "journal": "source", "document_type": "type"}


def cell(df: DataFrame, name: str) -> Column:
    """A value as one cell: empty for null, lists in their order, whole numbers without a point, true and false."""
    kind = df.schema[name].dataType.simpleString()
    c = F.col(name)
    if kind.startswith("array"):
        return F.coalesce(F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit(""))), "; "), F.lit(""))
    if kind.startswith(("decimal", "double", "float")):
        return F.coalesce(F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("double").cast("string")), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def catalogue_rows(items: DataFrame) -> DataFrame:
    """The CATALOGUE columns as cells of the items that have a PDF; ``items`` may lack columns, and has ``record`` (a struct) for those it takes from there."""
    rows = items.where("pdf_key is not null")
    record = {f.name for f in items.schema["record"].dataType.fields}
    flat = rows.select("*", *[F.col(f"record.{r}").alias(f"__{c}") for c, r in FROM_RECORD.items() if r in record])
    out = []
    for c in CATALOGUE:
        own = cell(flat, c) if c in items.columns else F.lit("")
        if f"__{c}" in flat.columns:
            own = F.when(own == "", cell(flat, f"__{c}")).otherwise(own)
        out.append(own.alias(c))
    return flat.select(*out)


def export_catalogue(items: DataFrame, path: str, force: bool = False) -> dict:
    """Writes the catalogue as CSV parts in the order of work_id and returns a receipt: rows, bytes, columns, items read, and each part's name, bytes and sha256.

    What is at the path stays unless ``force``; a receipt's digests are of the parts as they are read back.
    """
    spark = items.sparkSession
    catalogue_rows(items).orderBy("work_id").write.mode("overwrite" if force else "errorifexists").option("header", True).csv(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    parts = files.select(F.regexp_extract("path", "[^/]*$", 0).alias("part"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("part").collect()  # a row for each part
    rows = spark.read.option("header", True).option("multiLine", True).csv(path).count()
    return {"output": path, "rows": rows, "bytes": sum(p.bytes for p in parts), "columns": CATALOGUE, "scanned": items.count(), "parts": [p.asDict() for p in parts]}


def create_only(df: DataFrame, path: str) -> bool:
    """Writes if nothing is there; False, and nothing changed, if something is."""
    from pyspark.errors import AnalysisException

    try:
        df.write.mode("errorifexists").parquet(path)
    except AnalysisException as e:
        if "ALREADY_EXISTS" in str(e).upper():
            return False
        raise
    return True


def publish(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, text, version, outcome: each page replaced only if it still has the version that the writer read.

    ``stored``: key, text, version; ``wanted``: key, text, expected (null: must not exist).
    """
    w = wanted.select("key", F.col("text").alias("new"), "expected", F.lit(True).alias("asked"))
    j = stored.withColumn("there", F.lit(True)).join(w, "key", "full_outer")
    fits = F.col("asked") & (F.col("version").eqNullSafe(F.col("expected")))
    return j.select("key", F.when(fits, F.col("new")).otherwise(F.col("text")).alias("text"), F.when(fits, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")).alias("version"), F.when(F.col("asked").isNull(), "kept").when(fits, F.when(F.col("there"), "replaced").otherwise("created")).otherwise("conflict").alias("outcome"))


def publish_tables(tables: dict[str, DataFrame], root: str, run: str) -> None:
    """Tables under a directory of this run, then a pointer to it: readers see all of the old or all of the new."""
    spark: SparkSession = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{run}/{name}")
    spark.createDataFrame([(run,)], "run string").coalesce(1).write.mode("overwrite").json(f"{root}/current")


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    run = spark.read.schema("run string").json(f"{root}/current").first().run
    return spark.read.parquet(f"{root}/{run}/{name}")


def html_report(df: DataFrame, title: str, most: int = 10_000, date: str | None = None) -> str:
    """A page with the rows as escaped JSON and the range of a date; refuses more rows than a page should hold."""
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    read = [json.loads(r) for r in rows]
    days = sorted(r[date] for r in read if r.get(date)) if date else []
    data = json.dumps(read).replace("<", "\\u003c")
    shown = f"{days[0]} to {days[-1]}" if days else ""
    return f"<!doctype html><title>{html.escape(title)}</title><p id='range'>{shown}</p><script type='application/json' id='rows'>{data}</script>"


#: Where a page's rows stand, in any dialect's pattern.
ROWS = ("<script type='application/json' id='rows'>", "</script>")


def html_pages(df: DataFrame, title: str, key: str, most: int = 10_000, date: str | None = None) -> DataFrame:
    """page (from 0) and html of a report of any size: pages of ``most`` rows in the order of ``key`` (unique), each with the range of a date over the whole report.

    A page is one group, so no task holds more than its rows; each is as ``html_report`` writes one.
    """
    at = positions(df.withColumn("__all", F.lit(0)), "__all", key).drop("__all")
    row = F.replace(F.to_json(F.struct(*df.columns)), F.lit("<"), F.lit("\\u003c"))
    pages = at.groupBy(F.floor(F.col("at") / most).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", row.alias("row")))), lambda r: r["row"]), ", ").alias("data"))
    shown = F.concat_ws(" to ", F.min(date), F.max(date)) if date else F.max(F.lit(""))
    days = df.agg(shown.alias("days"))  # one row
    head = f"<!doctype html><title>{html.escape(title)}</title><p id='range'>"
    return pages.crossJoin(F.broadcast(days)).select("page", F.concat(F.lit(head), "days", F.lit(f"</p>{ROWS[0]}["), "data", F.lit(f"]{ROWS[1]}")).alias("html"))


def page_parts(pages: DataFrame) -> DataFrame:
    """first and last (dates as text) and row (JSON) for each row of ``html_pages``, with the page's other columns."""
    shown = F.split(F.regexp_extract("html", "id='range'>([^<]*)<", 1), " to ")
    data = F.regexp_extract("html", f"(?s){ROWS[0]}(.*){ROWS[1]}", 1)
    days = [F.nullif(F.try_element_at(shown, F.lit(i)), F.lit("")).alias(n) for i, n in ((1, "first"), (2, "last"))]
    others = [c for c in pages.columns if c != "html"]
    # Dates first, so that no row carries its page along.
    return pages.select(*others, *days, F.from_json(data, "array<string>").alias("data")).select(*others, "first", "last", F.explode("data").alias("row"))


def report_parts(page: str) -> tuple[str | None, str | None, list[str]]:
    """First and last date of a report, and its rows as JSON."""
    shown = re.search("id='range'>([^<]*)<", page)[1]
    first, _, last = shown.partition(" to ")
    return first or None, last or None, [json.dumps(r) for r in json.loads(re.search("id='rows'>(.*)</script>", page, re.S)[1])]


def with_section(text: Column | str, heading: str, body: str) -> Column:
    """``text`` with a section added once."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(F.contains(t, F.lit(f"## {heading}\n")), t).otherwise(F.concat(F.rtrim(t), F.lit(f"\n\n## {heading}\n{body}\n")))
