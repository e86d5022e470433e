"""Text functions as columns: folding, tokens, identifiers, names, excerpts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that decompose into nothing plainer, and what they are written as.
LETTERS = {"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ı": "i", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe"}


def _accented() -> dict[str, str]:
    """Small Latin letters with marks, by their decomposition."""
    out = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if ch == ch.lower() and len(plain) == 1 and plain.isascii() and plain.isalpha():
            out[ch] = plain
    return out | {k: v for k, v in LETTERS.items() if len(v) == 1}


#: Accented letters, and the plain letters they fold to, one for one; then those that fold to two.
ACCENTED, PLAIN = ("".join(x) for x in zip(*sorted(_accented().items())))
PAIRS = {k: v for k, v in LETTERS.items() if len(v) == 2}
#: Words of a question that say nothing about its subject.
STOP_WORDS = (
    "a an the of and or to in for with by on from is are was were be been does do did what which how why when where who whom whose "
    "can could would should may might will shall than then that this these those it its as at into onto over under between among "
    "across about versus vs not no any all some more most less much many such same other another each per via"
).split()
#: The expressions of fold() and tokens() in SQL, for oracles.
SQL_FOLD = f"translate({'replace(' * len(PAIRS)}lower({{0}}){''.join(f", '{k}', '{v}')" for k, v in PAIRS.items())}, '{ACCENTED}', '{PLAIN}')"
SQL_TOKENS = f"regexp_extract_all({SQL_FOLD}, '[a-z0-9]+')"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once for the row, however often the body, or a lambda in it, names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def fold(c: Column | str) -> Column:
    """Lower case without marks; what has nothing to fold, as most English texts, is only measured."""
    def folded(low: Column) -> Column:
        two = low
        for letter, plain in PAIRS.items():
            two = F.replace(two, F.lit(letter), F.lit(plain))
        two = F.when(low.rlike(f"[{''.join(PAIRS)}]"), two).otherwise(low)
        return F.when(is_ascii(low), low).otherwise(F.translate(two, ACCENTED, PLAIN))

    return let(F.lower(col(c)), folded)


def tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0))


def squash(c: Column | str) -> Column:
    """Letters and digits only: for comparing titles that differ in marks and spaces."""
    return F.regexp_replace(fold(c), "[^a-z0-9]+", "")


#: Greek letters and the letters that catalogues write for them.
WRITTEN = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "u", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f",
    "χ": "x", "ψ": "ps", "ω": "w", "µ": "u",
}


def content(c: Column | str) -> Column:
    """As ``squash``, with Greek letters as catalogues write them: what of a value is compared."""
    one = {k: v for k, v in WRITTEN.items() if len(v) == 1}

    def kept(low: Column) -> Column:
        latin = F.translate(low, "".join(one), "".join(one.values()))
        for letter, two in WRITTEN.items():
            if letter not in one:
                latin = F.replace(latin, F.lit(letter), F.lit(two))
        return F.when(is_ascii(low), F.regexp_replace(low, "[^a-z0-9]+", "")).otherwise(squash(latin))

    return let(F.lower(col(c)), kept)


def slug(c: Column | str, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def one_line(c: Column | str, most: int) -> Column:
    """White space squeezed; cut with an ellipsis if longer than ``most``."""
    s = F.trim(F.regexp_replace(col(c), r"[ \t\n\r\f]+", " "))
    return F.when(F.length(s) > most, F.concat(F.rtrim(F.substring(s, 1, most - 1)), F.lit("…"))).otherwise(s)


def content_words(c: Column | str) -> Column:
    """The distinct words of three letters and more that aren't stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_except(F.array_distinct(F.filter(tokens(c), lambda w: F.length(w) > 2)), stop)


def query_terms(c: Column | str) -> Column:
    """What a question searches for: its content words, or all of its words if none is one."""
    own = content_words(c)
    return F.when(F.size(own) > 0, own).otherwise(F.array_distinct(F.filter(F.split(F.trim(fold(c)), "[ \\t\\n]+"), lambda w: w != "")))


def doi(c: Column | str, strict: bool = True) -> Column:
    """A DOI without resolver or prefix in lower case; strict: null unless all of the value is one."""
    bare = F.lower(F.regexp_replace(F.trim(col(c)), r"(?i)^(https?://(dx\.)?doi\.org/|doi:\s*)", ""))
    return F.when(bare.rlike(r"^10\.[0-9]{4,9}/[^ ]+$"), bare) if strict else F.nullif(bare, F.lit(""))


def decoded_doi(c: Column | str, most: int = 300) -> Column:
    """As strict, but percent-encoded marks are decoded first, and what is too long is refused."""
    plain = F.try_url_decode(F.replace(F.trim(col(c)), F.lit("+"), F.lit("%2B")))
    return F.when(F.length(plain) <= most, doi(plain))


def demanded_doi(c: Column | str) -> Column:
    """As strict, but a value that is there and isn't a DOI fails the query."""
    return F.when(col(c).isNull() | doi(c).isNotNull(), doi(c)).otherwise(F.raise_error(F.concat(F.lit("not a DOI: "), F.substring(col(c), 1, 80))))


def repaired_doi(c: Column | str) -> Column:
    """Without the paths and closing brackets that running text adds."""
    cut = F.regexp_replace(col(c), r"(/(full|pdf|abstract|epdf))?[.,;]*$", "")
    opened = lambda x, ch: F.length(x) - F.length(F.replace(x, F.lit(ch), F.lit("")))
    return F.when(cut.endswith(")") & (opened(cut, ")") > opened(cut, "(")), F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut)


def years(c: Column | str) -> Column:
    """The different years that stand as words in a text, in order."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"\b[12][0-9]{3}\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


def journal_key(c: Column | str) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", " ")), "^the ", "")


def snippet(text: Column | str, terms: Column, window: int = 320) -> Column:
    """A window that starts a third of its size before the first term, with terms of three letters and more in brackets, longest first, and ellipses where text is left out."""
    t = col(text)
    hits = F.filter(F.transform(terms, lambda w: F.instr(F.lower(t), F.lower(w))), lambda p: p > 0)
    first = F.coalesce(F.array_min(hits), F.lit(0))
    start = F.greatest(F.lit(0), F.when(first > 0, first - 1 - window // 3).otherwise(0))
    long = F.array_sort(F.transform(F.filter(F.array_distinct(terms), lambda w: F.length(w) > 2), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    quoted = lambda w: F.concat(F.lit("(?i)("), F.regexp_replace(w, r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(")"))
    marked = F.aggregate(long, F.substring(t, start + 1, F.lit(window)), lambda s, w: F.regexp_replace(s, quoted(w["w"]), F.lit("[$1]")))
    body = F.trim(F.replace(marked, F.lit("\n"), F.lit(" ")))
    return F.concat(F.when(start > 0, "… ").otherwise(""), body, F.when(start + window < F.length(t), " …").otherwise(""))


#: Markers of a reporting checklist, the least offset of one, and abbreviations that end no sentence.
CHECKLIST = ("nature portfolio reporting summary", "nature research reporting summary", "reporting summary", "field-specific reporting", "life sciences study design", "reporting for specific materials, systems and methods")
LEAST_OFFSET = 2000
ABBREVIATIONS = ("e.g.", "i.e.", "al.", "vs.", "cf.", "Fig.")


def without_checklist(c: Column | str, least: int = LEAST_OFFSET) -> Column:
    """A text without the reporting checklist that it ends with: cut at the first marker whose first place is far enough in."""
    t = col(c)
    # Places are counted only in texts that hold the marker, as most don't.
    place = lambda low, m: F.when(F.contains(low, F.lit(m)), F.instr(low, m))
    first = let(F.lower(t), lambda low: F.array_min(F.filter(F.array(*[place(low, m) for m in CHECKLIST]), lambda p: p > least)))
    return let(first, lambda p: F.when(p.isNotNull(), F.rtrim(F.substring(t, F.lit(1), p - 1), F.lit(" \t\n\r\x0b\x0c"))).otherwise(t))


def without_blobs(c: Column | str) -> Column:
    """A text without runs of more than forty single characters; empty if what is left is scattered letters."""
    def scattered(left: Column, solid: Column) -> Column:
        n = F.size(F.regexp_extract_all(left, F.lit(r"\S+"), F.lit(0)))
        # Between n words are n - 1 blanks or more, so words are counted only where there are blanks enough.
        return (solid < 2 * (F.length(left) - solid + 1)) & (n >= 15) & (solid < 2 * n)

    solid = lambda left: F.length(F.regexp_replace(left, r"\s+", ""))
    return let(F.regexp_replace(col(c), r"\S\s(?:\S\s){40,}", ""), lambda left: F.when(let(solid(left), lambda n: scattered(left, n)), "").otherwise(left))


def first_sentence(c: Column | str) -> Column:
    """Up to the first mark that ends a sentence and is followed by a capital, unless it ends an abbreviation."""
    known = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    whole = F.split(F.btrim(col(c), F.lit(" \t\n\r\x0b\x0c")), rf"(?<=[.!?])(?<!{known})\s+(?=[A-Z])", 2)[0]
    return F.regexp_replace(whole, rf"({known})\s+(?=[A-Z])", "$1 ")


def model_family(c: Column | str, name: str) -> Column:
    """(family, version) of a model id ``name-family-major-minor``; another id is its own family."""
    pattern = f"{name}-([a-z]+)-([0-9]+)(?:-([0-9]+))?"
    part = lambda k: F.regexp_extract(col(c), pattern, k)
    version = F.concat(part(2), F.when(part(3) != "", F.concat(F.lit("."), part(3))).otherwise(""))
    return F.struct(F.when(part(1) != "", part(1)).otherwise(col(c)).alias("family"), version.alias("version"))


def present(c: Column | str) -> Column:
    """Neither null nor empty; a stored False is present."""
    return col(c).isNotNull() & (col(c).cast("string") != "")


def column_letters_to_index(c: Column | str) -> Column:
    """A spreadsheet column's letters as a number: A is 1."""
    return F.aggregate(F.split(F.upper(col(c)), ""), F.lit(0), lambda a, x: F.when(x == "", a).otherwise(a * 26 + F.ascii(x) - 64))


def canonical_digest(*pairs: tuple[str, Column]) -> Column:
    """SHA-256 of key=value lines in key order."""
    return F.sha2(F.concat_ws("\n", *[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in sorted(pairs, key=lambda p: p[0])]), 256)
