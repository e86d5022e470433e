"""Quality rules: base counts of each text, and lines that too many documents of a host share [native].

A line is normalised (lower case, digits as 0, white space squeezed and stripped) and hashed.  A hash
held by at least ``min_docs`` documents of a host is boilerplate there, whatever the host's size.  A document whose
words outside boilerplate lines are fewer than ``least_share`` of its words is depleted and rejected, as is one that
fails a base rule.

Lines are split and hashed once and written as one row for each (host, document, line); counting sums these before
it shuffles, and the few frequent lines come back to their documents over (host, line, salt), so that a line in a
third of all documents is spread.  ``verdicts`` counts and never shuffles texts; ``cleaned`` gives the texts without
their boilerplate lines, and its counts and verdicts are those of the texts it gives.

Defined results: null text has no words, so it fails the base rule; a null host is a host of its own;
a document is a row's (doc_id, text, host), so repeated rows count once and are each returned, and the same text in
two hosts is two documents; lines without a word are never boilerplate; there are no ties; texts of any length are read
whole; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import cut

WHITE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
SALTS = 32
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITE + "+", " "))


def repeated_words(words: Column, n: Column) -> Column:
    """A hash of each window of three words."""
    # One function over the windows; the words beside each are looked up, not copied.
    return F.transform(F.slice(words, 1, F.greatest(n - 2, F.lit(0))), lambda a, i: F.xxhash64(a, F.get(words, i + 1), F.get(words, i + 2)))


def covered(hashes: Column) -> Column:
    """How many words the windows cover whose hash another window has too."""
    m = F.size(hashes)
    at = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    beside = F.zip_with(F.concat(none, F.slice(at, 1, m - 1)), F.concat(F.slice(at, 2, m - 1), none), lambda a, b: F.struct(a["h"].alias("a"), b["h"].alias("b")))
    found = F.zip_with(at, beside, lambda x, y: F.when((x["h"] == y["a"]) | (x["h"] == y["b"]), x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(F.sort_array(F.array_compact(found)), start, lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")))["n"]


def base_counts(df: DataFrame, text: str) -> DataFrame:
    """``df`` with COUNTS, from whole texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    # Arrays stand in projections of their own and are used more than once, so that they are made once.
    out = df.select("*", squeezed(t).alias("__s"), F.size(F.regexp_extract_all(t, F.lit(f"({SYMBOLS})"))).cast("long").alias("n_symbols"), lines.alias("__lines"))
    out = out.select("*", F.when(F.col("__s") == "", F.array().cast("array<string>")).otherwise(F.split("__s", " ")).alias("__w"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"))
    out = out.select("*", F.size("__w").cast("long").alias("n_words"), repeated_words(F.col("__w"), F.size("__w")).alias("__h"))
    out = out.withColumn("word_chars", (F.length("__s") - F.greatest(F.col("n_words") - 1, F.lit(0))).cast("long"))
    out = out.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("__h")) == F.size("__h"), F.lit(0)).otherwise(covered(F.col("__h"))).cast("long"))
    return out.drop("__s", "__lines", "__w", "__h")


def normalised(text: Column) -> Column:
    """A text, or a line, whose lines have lower case, 0 for digits and one space for other white space; their ends are not stripped."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " "), "[0-9]", "0")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def held_lines(docs: DataFrame) -> DataFrame:
    """(host, hash, doc_id, content, words, salt): a row for each line of each document of ``docs``, written once."""
    # The whole text is normalised, not line by line.
    line = docs.select("doc_id", "host", "content", F.explode(F.split(normalised(F.coalesce("text", F.lit(""))), "\n")).alias("line"))
    line = line.select("doc_id", "host", "content", F.trim("line").alias("line")).where("line <> ''")
    line = line.select("doc_id", "host", "content", F.xxhash64("line").alias("hash"), (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("words"))
    held = line.groupBy("host", "hash", "doc_id", "content").agg(F.sum("words").alias("words"))
    return cut(held.withColumn("salt", F.pmod(F.xxhash64("doc_id", "content"), F.lit(SALTS)).cast("int")))


def boilerplate(held: DataFrame, min_docs: int) -> DataFrame:
    """The rows of ``held`` whose line ``min_docs`` documents of the host hold, whatever the host's size."""
    # Only salts that a line's documents have come back, so that these rows are never more than those of its documents.
    counted = held.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")).where(F.col("n") >= min_docs)
    own = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("salts", s) == 1)
    often = counted.select(F.col("host").alias("f_host"), F.col("hash").alias("f_hash"), F.explode(own).alias("f_salt"))
    return held.join(often, held["host"].eqNullSafe(often["f_host"]) & (held["hash"] == often["f_hash"]) & (held["salt"] == often["f_salt"]))


def documents(df: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    return df.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("content"))


DOCUMENT = ["doc_id", "content", "host"]


def verdicts(df: DataFrame, doc_id: str, text: str, host: str, min_docs: int = 10, least_share: float = 0.5) -> DataFrame:
    """doc_id, COUNTS, n_boilerplate_words, base_failed and kept for each row."""
    docs = documents(df, doc_id, text, host)
    removed = boilerplate(held_lines(docs), min_docs).groupBy(*DOCUMENT).agg(F.sum("words").alias("removed"))
    counts = base_counts(docs, "text").select(*DOCUMENT, *COUNTS)
    both = counts.withColumn("removed", F.lit(0).cast("long")).withColumn("row", F.lit(1)).unionByName(
        removed.select(*DOCUMENT, *[F.lit(None).cast("long").alias(c) for c in COUNTS], "removed", F.lit(0).alias("row"))
    )
    # Repeated rows of a document meet here, with their lines' words summed over them, and part again.
    met = both.groupBy(*DOCUMENT).agg(*[F.max(c).alias(c) for c in COUNTS], F.sum("removed").alias("removed"), F.sum("row").alias("rows"))
    rows = met.select("*", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("nth"))
    failed = base_failed()
    gone = (F.col("removed") / F.col("rows")).cast("long")
    return rows.select("doc_id", *COUNTS, gone.alias("n_boilerplate_words"), failed.alias("base_failed")).withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_boilerplate_words") >= least_share * F.col("n_words")))


def cleaned(df: DataFrame, doc_id: str, text: str, host: str, min_docs: int = 10, least_share: float = 0.5) -> DataFrame:
    """doc_id, text without its boilerplate lines, n_words (of the whole text), n_boilerplate_words, base_failed and kept for each row."""
    docs = documents(df, doc_id, text, host)
    gone = boilerplate(held_lines(docs), min_docs).groupBy(F.col("doc_id").alias("g_id"), F.col("host").alias("g_host"), F.col("content").alias("g_content")).agg(F.collect_set("hash").alias("gone"))
    both = docs.join(gone, docs["doc_id"].eqNullSafe(gone["g_id"]) & docs["host"].eqNullSafe(gone["g_host"]) & (docs["content"] == gone["g_content"]), "left")
    # Lines without a word never stand in ``gone``: held_lines leaves them out.
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(F.trim(normalised(x))))), "\n")
    rows = base_counts(both.withColumn("left", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)), "text")
    words = squeezed(F.coalesce("left", F.lit("")))
    n_left = F.when(words == "", F.lit(0)).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1)
    out = rows.select("doc_id", F.col("left").alias("text"), "n_words", (F.col("n_words") - n_left).alias("n_boilerplate_words"), base_failed().alias("base_failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_boilerplate_words") >= least_share * F.col("n_words")))
