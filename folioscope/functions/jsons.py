"""JSON that models and people wrote: strict, then a fenced block, then the first object in the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def robust(text: Column | str) -> Column:
    """The value as a variant; null if there is none.  Objects with a repeated key are refused, as no reading of them is right."""
    t = F.col(text) if isinstance(text, str) else text
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    first = F.regexp_extract(t, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.coalesce(F.try_parse_json(F.trim(t)), F.try_parse_json(F.nullif(F.trim(fenced), F.lit(""))), F.try_parse_json(F.nullif(first, F.lit(""))))
