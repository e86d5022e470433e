"""Named actions: what a tool, a command line or a service calls, one function for each, with its arguments checked.

``handle`` takes an event like ``{"action": "search", "query": "...", "limit": 5}`` and gives a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import guards
from folioscope.functions import text as T
from folioscope.operators import graph, search
from folioscope.sources.tables import load, notes, page_links


class BadRequest(ValueError):
    """An action that isn't there, or arguments that it doesn't take."""


def search_notes(spark: SparkSession, sf_dir: str, query: str, limit: int = 10, category: str | None = None) -> DataFrame:
    """The documents that answer a question best, each with its best section and a snippet."""
    if not isinstance(query, str) or not query.strip() or not isinstance(limit, int) or not 1 <= limit <= 50:
        raise BadRequest("query must be text and limit 1 to 50")
    n = notes(spark, sf_dir)
    n = n if category is None else n.where(F.col("category") == category)
    asked = spark.createDataFrame([(0, query)], "query_id int, text string").select("query_id", T.query_terms("text").alias("terms"))
    best = search.best_sections(search.bm25(search.tokenised(n), asked), limit)
    return best.join(n, "doc_id").select("rank", "doc_id", "title", "score", T.snippet("text", T.query_terms(F.lit(query))).alias("snippet"))


def read_window(spark: SparkSession, sf_dir: str, doc_id: int, start: int = 0, size: int = 4000) -> DataFrame:
    """A bounded window of a document's text, and where to go on."""
    if not isinstance(start, int) or not isinstance(size, int) or start < 0 or not 1 <= size <= guards.MOST_CHARS:
        raise BadRequest(f"start must not be negative and size must be 1 to {guards.MOST_CHARS}")
    d = load(spark, sf_dir, "documents").where(F.col("doc_id") == doc_id)
    return d.select("doc_id", F.substring("text", start + 1, size).alias("part"), F.length("text").alias("total"), F.when(F.length("text") > start + size, start + size).alias("next"))


def list_backlinks(spark: SparkSession, sf_dir: str, target: str) -> DataFrame:
    """The pages that link to a target."""
    p = load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    links = page_links(spark, sf_dir).select(F.col("page_id").alias("doc_id"), "target").where(F.col("target") == target.lower())
    return graph.backlinks(links, p)


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("notes"))


ACTIONS: dict[str, Callable[..., DataFrame]] = {"search": search_notes, "read": read_window, "backlinks": list_backlinks, "categories": category_counts}


def handle(spark: SparkSession, sf_dir: str, event: dict) -> DataFrame:
    """The result of an event's action; other keys of the event are its arguments."""
    action = ACTIONS.get(event.get("action"))
    if action is None:
        raise BadRequest(f"action must be one of {', '.join(sorted(ACTIONS))}")
    own = {k: v for k, v in event.items() if k != "action"}
    known = action.__code__.co_varnames[2 : action.__code__.co_argcount]
    if {*own} - {*known}:
        raise BadRequest(f"{event['action']} takes {', '.join(known) or 'no arguments'}")
    needed = known[: len(known) - len(action.__defaults__ or ())]
    if {*needed} - {*own}:
        raise BadRequest(f"{event['action']} needs {', '.join(needed)}")
    return action(spark, sf_dir, **own)
