"""Noise is looked for once: a text is lowered once, and its words are counted only if it may be scattered letters."""

import re

from folioscope.functions import text as T

WHITE = " \t\n\r\x0b\x0c"
LONG = "Words of a paper go on. " * 100
TEXTS = [
    None, "", "short", LONG, LONG + "Reporting Summary of it", "Reporting Summary first. " + LONG, LONG + "\n \tNATURE PORTFOLIO REPORTING SUMMARY\nField-specific reporting\n" + LONG, LONG + "Life sciences study design" + "reporting for specific materials, systems and methods",
    "é" * 1999 + "reporting summary", "é" * 2000 + "reporting summary", "É" * 2100 + " field-specific Reporting", "x y " * 30 + "end", "x y " * 20 + "x end", "x y " * 20 + "end", "x y " * 20 + "x yy", ("a\n" * 41) + "rest", ("a  " * 41) + "rest",
    "ab c " * 15, "ab c " * 7, "abc d e\t" * 20, "abc d\n" * 20, "abcd e " * 20, "a\x0bb  c\x0c" * 20, "a b " * 20, "é ü ab " * 10, "  " + "ab  c\r\n" * 8, "i " * 14 + "ii", "i " * 13 + "ii",
]


def cut(text):
    at = [p for p in (text.lower().find(m) + 1 for m in T.CHECKLIST) if p > T.LEAST_OFFSET]
    return text[: min(at) - 1].rstrip(WHITE) if at else text


def kept(text):
    left = re.sub(r"(\S\s){41,}", "", text, flags=re.A)
    n = len(re.findall(r"\S+", left, re.A))
    return "" if n >= 15 and len(re.sub(r"\s+", "", left, flags=re.A)) < 2 * n else left


def test_noise_is_what_it_was(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").select("i", "text", T.without_checklist("text").alias("cut"), T.without_blobs("text").alias("kept"))
    for r in d.collect():
        assert (r.cut, r.kept) == ((None, None) if r.text is None else (cut(r.text), kept(r.text))), r.i


def test_texts_are_lowered_once(spark):
    plan = spark.createDataFrame([("x",)], "text string").select(T.without_checklist("text").alias("a"), T.without_blobs("text").alias("b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(text") == 1 and plan.count("regexp_replace(text") == 1
