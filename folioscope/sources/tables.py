"""The driver's tables as the engine's inputs: notes, links, members, jobs and the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, title (first line), category, journal."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", "text", F.substring(F.trim(F.regexp_extract("text", r"^[^\n]*", 0)), 1, 80).alias("title"), F.col("lang").alias("category"), F.col("source").alias("journal"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, target: the distinct links of each page, in lower case."""
    p = load(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("href")).select("page_id", F.lower("href").alias("target")).distinct()


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a log of jobs: job, member, kind, moment, seconds, tokens."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("member_id"), F.col("event_type").alias("kind"), F.col("ts").alias("moment"), F.col("value").alias("seconds"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"))


#: The same inputs in SQL, for the queries' oracles.
SQL_NOTES = r"notes as (select doc_id, text, substr(trim(regexp_extract(text, '^[^\n]*')), 1, 80) as title, lang as category, source as journal from documents)"
SQL_LINKS = r"""links as (select distinct page_id, lower(href) as target from (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href from pages))"""
SQL_JOBS = "jobs as (select event_id as job_id, user_id as member_id, event_type as kind, ts as moment, value as seconds, (props::json->>'$.k')::bigint as tokens from events)"
