"""Glossary terms: extraction, aliases, normal forms, symbols, document frequency, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.lineage import cut

#: The heading and the lines of a glossary, the dashes and Greek letters of terms, and what they are written as.
HEADING = r"(?:^|\n)## (?:7\. )?Glossary[ \t]*\n"
LINE = r"(?m)^[ \t]*[-*][ \t]+\*\*(.+?)\*\*[ \t]*[:：][ \t]*(.*)$"
DASHES = "[‐‑–—]"
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r",
    "σ": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "ch", "ψ": "ps", "ω": "w", "µ": "m", "ς": "s", "ϵ": "e",
}
#: What separates aliases, an alias in brackets, and the least length of one; an acronym's plural, and endings of words that aren't plurals.
VERSUS, SLASH, BRACKETED, LEAST_ALIAS = r"\s+versus\s+|\s+vs\.?\s+", r"\s+/\s+", r"^(.*?\S)\s*\(([^()]{1,60})\)\s*$", 2
ACRONYM_PLURAL, SINGULAR, LONGER_THAN = "^[A-Z][A-Za-z0-9-]*[A-Z0-9]s$", "(ss|us|is)$", 4


def glossary(notes: DataFrame, text: str = "text") -> DataFrame:
    """Rows of ``notes`` without the text, with term and definition for each line of the Glossary section."""
    more = [c for c in notes.columns if c != text]
    # What stands between the heading and the next one, found by its ends: a pattern would be tried at each of its characters.
    section = F.substring_index(F.try_element_at(F.split(F.col(text), HEADING, 2), F.lit(2)), "\n## ", 1)
    part = lambda k: F.regexp_extract_all("__section", F.lit(LINE), F.lit(k))
    x = notes.select(*more, section.alias("__section")).select(*more, F.explode(F.arrays_zip(part(1).alias("t"), part(2).alias("d"))).alias("x"))
    return x.select(*more, F.trim("x.t").alias("term"), F.trim("x.d").alias("definition"))


def aliases(term: Column) -> Column:
    """The forms of a term: sides of a spaced slash, a name and its parenthesis, and only the left of a comparison."""
    pieces = F.filter(F.transform(F.split(F.split(term, VERSUS, 2)[0], SLASH), lambda p: F.trim(F.btrim(F.trim(p), F.lit(",;")))), lambda p: p != "")
    forms = lambda p: F.when(p.rlike(BRACKETED), F.array(F.regexp_extract(p, BRACKETED, 1), F.trim(F.regexp_extract(p, BRACKETED, 2)))).otherwise(F.array(p))
    return F.filter(F.array_distinct(F.flatten(F.transform(pieces, forms))), lambda p: F.length(p) >= LEAST_ALIAS)


def normal(term: Column) -> Column:
    """Lower case, Greek and dashes in ASCII, other marks as spaces, and the last word in the singular."""
    one = {k: v for k, v in GREEK.items() if len(v) == 1}
    low = F.translate(F.lower(term), "".join(one), "".join(one.values()))
    for letter, two in GREEK.items():
        if letter not in one:
            low = F.replace(low, F.lit(letter), F.lit(two))
    low = F.regexp_replace(F.regexp_replace(low, DASHES, "-"), r"[^a-z0-9+.\- ]+", " ")
    low = F.btrim(F.regexp_replace(low, " +", " "), F.lit(" .-"))
    last = F.regexp_extract(low, "[^ ]*$", 0)
    acronym = F.regexp_extract(F.trim(term), r"\S*$", 0).rlike(ACRONYM_PLURAL)
    plural = last.endswith("s") & (acronym | ((F.length(last) > LONGER_THAN) & ~last.rlike(SINGULAR)))
    return F.when(plural, F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def resolved_symbols(table: DataFrame) -> DataFrame:
    """key, symbol from (symbol, alias): approved symbols win; an alias counts only if one symbol claims it."""
    own = table.select(F.upper("symbol").alias("key"), "symbol").distinct()
    claims = table.where("alias is not null and alias <> ''").groupBy(F.upper("alias").alias("key")).agg(F.min("symbol").alias("symbol"), F.max("symbol").alias("other")).where("symbol = other").select("key", "symbol")
    return own.unionByName(claims.join(own.select("key"), "key", "left_anti"))


def candidates(terms: DataFrame, threshold: int) -> DataFrame:
    """slug, notes, in_scope, title, definitions of terms that enough notes hold.

    ``terms``: slug, stem, scope (boolean), form, definition.  The title is the commonest form, ties to the
    longer and then to the first; definitions are those of the first two stems.
    """
    # Written once: three sums read them.
    terms = cut(terms.select("slug", "stem", "scope", "form", "definition"))
    n = terms.groupBy("slug").agg(F.count_distinct("stem").alias("notes"), F.count_distinct(F.when(F.col("scope"), F.col("stem"))).alias("in_scope")).where(F.col("in_scope") >= threshold)
    forms = terms.groupBy("slug", "form").agg(F.count(F.lit(1)).alias("n"))
    title = forms.withColumn("nth", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("n"), F.desc(F.length("form")), "form"))).where("nth = 1").select("slug", F.col("form").alias("title"))
    one = terms.groupBy("slug", "stem").agg(F.min("definition").alias("definition"))
    two = one.withColumn("nth", F.row_number().over(Window.partitionBy("slug").orderBy("stem"))).where("nth <= 2").groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stem", "definition"))), lambda x: x["definition"]), " | ").alias("definitions"))
    return n.join(title, "slug").join(two, "slug")


def folded(members: DataFrame, merges: DataFrame) -> DataFrame:
    """Members recounted under the targets of a closed merge map."""
    to = merges.select("slug", "target")
    return members.join(to, "slug", "left").groupBy(F.coalesce("target", "slug").alias("slug")).agg(F.count_distinct("stem").alias("notes"), F.count_distinct("form").alias("forms"))


#: Why a merge is refused.
UNKNOWN, GENE, UNSHARED = "unknown candidate", "gene identity", "no shared expanded synonym"


def expanded_names(forms: Column) -> Column:
    """The normal forms of those that have more than one word; abbreviations and single words are no evidence."""
    return F.array_distinct(F.transform(F.filter(forms, lambda f: F.trim(f).rlike(r"\S\s+\S")), normal))


def safe_merges(candidates: DataFrame, merges: DataFrame) -> DataFrame:
    """source, target, reason of each proposed merge; it is accepted where the reason is null.

    ``candidates``: slug, kind, forms (title and aliases); ``merges``: a closed map of source to target.  Both must be known, neither a gene, and a name of several words must be shared.
    """
    side = lambda c: candidates.select(F.col("slug").alias(c), F.coalesce(F.col("kind") == "gene", F.lit(False)).alias(f"{c}_gene"), expanded_names(F.col("forms")).alias(f"{c}_names"))
    both = merges.select("source", "target").join(side("source"), "source", "left").join(side("target"), "target", "left")
    known = F.col("source_names").isNotNull() & F.col("target_names").isNotNull()
    reason = F.when(~known, UNKNOWN).when(F.col("source_gene") | F.col("target_gene"), GENE).when(~F.arrays_overlap("source_names", "target_names"), UNSHARED)
    return both.select("source", "target", reason.alias("reason"))
