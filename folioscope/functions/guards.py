"""Guards of requests as columns: what is wrong with a key, a window or a range of days; null if nothing is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a key, characters of a window and days of a range, at most.
MOST_KEY, MOST_CHARS, MOST_DAYS = 1024, 20_000, 62


def page_key_problem(c: Column) -> Column:
    """A published page is a Markdown file in a folder of the wiki, without drafts, failures or dots as parts."""
    parts = F.split(c, "/")
    ok = (
        (F.octet_length(c) <= MOST_KEY) & c.rlike(r"^[A-Za-z0-9._/-]+\z") & ~F.exists(parts, lambda p: p.isin("", ".", "..")) & c.startswith("wiki/") & c.endswith(".md") & (F.size(parts) >= 3)
        & ~c.startswith("wiki/drafts/") & ~F.contains(c, F.lit("/failed/"))
    )
    return F.when(~F.coalesce(ok, F.lit(False)), "expected a published Markdown key under wiki/")


def window_problem(start: Column, size: Column) -> Column:
    ok = (start >= 0) & size.between(1, MOST_CHARS)
    return F.when(~F.coalesce(ok, F.lit(False)), f"start must not be negative and size must be 1 to {MOST_CHARS}")


def days(first: Column, last: Column) -> Column:
    """The days of a range, or null if it is empty or longer than may be asked for."""
    n = F.datediff(last, first)
    return F.when((n >= 0) & (n < MOST_DAYS), F.sequence(first, last))


def days_problem(first: Column, last: Column) -> Column:
    n = F.datediff(last, first)
    return F.when(n < 0, "the last day must not precede the first").when(n >= MOST_DAYS, f"a window covers at most {MOST_DAYS} days").when(n.isNull(), "not a day")
