"""A stored inverted index, by term and block, and exact top-k search that reads only the blocks that can matter.

Sections are dealt out by their documents into slices, once, and indexed where they are.  A slice's postings of a term lie in the order of their sections in blocks of BLOCK, each with the best
that a section of it can add to a score.  The files are partitioned by a hash of the term and
sorted by term, so a question reads the row groups of its terms.  From the blocks' bests alone follows a score that the k-th best document reaches at least; a block whose best, with the
bests of the question's other terms, stays below it is not opened.  A section in such a block cannot be among the k best, so what is left of its score cannot mislead.

Terms may be stems (Porter's algorithm, as expressions over the different words).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.lineage import cut
from folioscope.operators import search
from folioscope.sizes import dealt, small

BLOCK, BUCKETS = 128, 64
#: Sections of a slice, which one task indexes and searches.
SLICE = 20_000
#: Different terms of all questions that may stand in a plan as a list; more of them are joined.
LISTED = 5_000

# Porter's stemmer.  A word's measure is the number of its changes from vowels to consonants; y is a vowel after a consonant.
_V, _C = "(?:[aeiou]|(?<=[^aeiou])y)", "(?:[^aeiouy]|(?<![^aeiou])y)"


def _measure(least: int) -> str:
    """A pattern of beginnings with at least so many changes from vowels to consonants."""
    return rf"^{_C}*(?:{_V}+{_C}+){{{least}}}"


_VOWEL = rf"^.*{_V}"
_DOUBLE, _SHORT = r"([^aeiouylsz])\1$", rf"^(?:.*[^aeiou])?{_C}{_V}(?:[^aeiouwxy])$"
#: The suffixes of steps 2 to 4 and what they become; longer ones first.
STEP2 = [("ational", "ate"), ("ization", "ize"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("tional", "tion"), ("biliti", "ble"), ("entli", "ent"), ("ousli", "ous"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("iviti", "ive"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("ator", "ate"), ("eli", "e")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"]


def _without(w: Column, suffix: str) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - len(suffix))


def _one_of(w: Column, rules: list[tuple[str, str]], least: int) -> Column:
    """The longest suffix that a word has decides, whether its beginning is long enough or not."""
    out = w
    for suffix, new in reversed(rules):
        beginning = _without(w, suffix)
        out = F.when(w.endswith(suffix), F.when(beginning.rlike(_measure(least)), F.concat(beginning, F.lit(new))).otherwise(w)).otherwise(out)
    return out


def stems(words: DataFrame, word: str = "term") -> DataFrame:
    """``words`` with ``stem``; words with other characters than a to z, and of up to two letters, are their own stems."""
    d = words.withColumn("stem", F.col(word)).withColumn("__plain", ~F.col(word).rlike("^[a-z]{3,}$"))
    step = lambda d, make: d.withColumn("stem", F.when(F.col("__plain"), F.col("stem")).otherwise(make(F.col("stem"))))
    d = step(d, lambda w: F.when(w.endswith("sses") | w.endswith("ies"), _without(w, "es")).when(w.endswith("ss"), w).when(w.endswith("s"), _without(w, "s")).otherwise(w))
    cut_ = lambda w: F.when(w.endswith("ed"), _without(w, "ed")).otherwise(_without(w, "ing"))
    # Of a word that loses ed or ing the end is mended.
    d = d.withColumn("__was", ~F.col("stem").endswith("eed") & ((F.col("stem").endswith("ed") & _without(F.col("stem"), "ed").rlike(_VOWEL)) | (F.col("stem").endswith("ing") & _without(F.col("stem"), "ing").rlike(_VOWEL))))
    d = step(d, lambda w: F.when(w.endswith("eed"), F.when(_without(w, "eed").rlike(_measure(1)), _without(w, "d")).otherwise(w)).when(F.col("__was"), cut_(w)).otherwise(w))
    mend = lambda w: F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike(_DOUBLE), _without(w, "x")).when(w.rlike(_measure(1)) & ~w.rlike(_measure(2)) & ~w.rlike(rf"^{_C}*{_V}+{_C}+{_V}") & w.rlike(_SHORT), F.concat(w, F.lit("e"))).otherwise(w)
    d = step(d, lambda w: F.when(F.col("__was"), mend(w)).otherwise(w))
    d = step(d, lambda w: F.when(w.endswith("y") & _without(w, "y").rlike(_VOWEL), F.concat(_without(w, "y"), F.lit("i"))).otherwise(w))
    d = step(d, lambda w: _one_of(w, STEP2, 1))
    d = step(d, lambda w: _one_of(w, STEP3, 1))

    def fourth(w: Column) -> Column:
        out = w
        for suffix in sorted(STEP4, key=len):
            ok = _without(w, suffix).rlike(_measure(2)) & (_without(w, suffix).rlike("[st]$") if suffix == "ion" else F.lit(True))
            out = F.when(w.endswith(suffix), F.when(ok, _without(w, suffix)).otherwise(w)).otherwise(out)
        return out

    d = step(d, fourth)
    d = step(d, lambda w: F.when(w.endswith("e") & (_without(w, "e").rlike(_measure(2)) | (_without(w, "e").rlike(_measure(1)) & ~_without(w, "e").rlike(_SHORT))), _without(w, "e")).otherwise(w))
    return step(d, lambda w: F.when(w.endswith("ll") & _without(w, "l").rlike(_measure(2)), _without(w, "l")).otherwise(w)).drop("__plain", "__was")


def stemmed(sections: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``queries`` (query_id, terms) by the stems of their terms, and (word, term) of the words of ``sections`` (``search.indexed``) that have one of these stems: each different word is stemmed once."""
    q = cut(stems(queries.select("query_id", F.explode("terms").alias("term"))).select("query_id", F.col("stem").alias("term")).distinct())
    words = cut(sections.select(F.explode(F.array_distinct(F.concat("t0", "t1", "t2"))).alias("word")).distinct())
    # A table: a filter of stems would be worked into each step that makes them.
    forms = cut(stems(words, "word").select("word", F.col("stem").alias("term"))).join(small(cut(q.select("term").distinct())), "term", "left_semi")
    return q.groupBy("query_id").agg(F.collect_list("term").alias("terms")), cut(forms.select("word", "term"))


@dataclass
class Index:
    """Where an index lies, and its totals; ``stemmed`` says whether its terms are stems."""

    path: str
    total: int
    average: float
    stemmed: bool


def gain(tf: Column, length: Column, average: Column | float) -> Column:
    """What a posting adds to a score, for an idf of 1."""
    return tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * length / average))


def build(sections: DataFrame, path: str, stemmed: bool = False) -> Index:
    """Writes the index of ``sections`` (``search.indexed``: doc_id, ord, len, t0, t1, t2) under ``path``."""
    row = sections.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).first()
    total, average = row.n, row.avg or 1.0
    slices = max(1, -(-total // SLICE))
    of = F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int")
    own = dealt(sections.select(of.alias("slice"), "doc_id", "ord", "len", "t0", "t1", "t2"), "slice")
    tf = search.postings(own, "slice").groupBy("slice", "term", "doc_id", "ord", "len").agg(F.sum("w").alias("tf"))
    if stemmed:
        # A slice's words are stemmed once each, where their postings are.
        held = tf.groupBy("slice", "term").agg(F.collect_list(F.struct("doc_id", "ord", "len", "tf")).alias("p"))
        each = stems(held).select("slice", F.col("stem").alias("term"), F.explode("p").alias("p")).select("slice", "term", "p.*")
        tf = each.groupBy("slice", "term", "doc_id", "ord", "len").agg(F.sum("tf").alias("tf"))
    posting = F.struct("doc_id", "ord", gain(F.col("tf"), F.col("len"), average).alias("gain"))
    lists = tf.groupBy("slice", "term").agg(F.array_sort(F.collect_list(posting)).alias("all"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / BLOCK).cast("int")), lambda i: F.slice("all", i * BLOCK + 1, F.lit(BLOCK)))
    blocks = lists.select("slice", "term", F.posexplode(parts).alias("at", "held"))
    best = F.array_max(F.transform("held", lambda h: F.struct(h["gain"].alias("gain"), h["doc_id"].alias("doc_id"))))
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    blocks = blocks.select("term", (F.col("slice").cast("long") * (1 << 32) + F.col("at")).alias("block"), "slice", F.size("held").cast("long").alias("n"), best["gain"].alias("best"), best["doc_id"].alias("best_doc"), "held", bucket.alias("bucket"))
    blocks.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").option("parquet.block.size", 8 << 20).partitionBy("bucket").parquet(path)
    return Index(path, total, average, stemmed)


def asked(spark: SparkSession, index: Index, queries: DataFrame) -> DataFrame:
    """The blocks of the index that hold terms of ``queries`` (query_id, term), read by bucket and term."""
    blocks = spark.read.parquet(index.path)
    terms = queries.select("term").distinct()
    few = terms.limit(LISTED + 1).collect()
    if len(few) > LISTED:
        return blocks.join(terms, "term", "left_semi")
    listed = [r.term for r in few]
    buckets = sorted({r.b for r in spark.createDataFrame([(t,) for t in listed], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()}) if listed else [-1]
    return blocks.where(F.col("bucket").isin(buckets) & F.col("term").isin(listed or [""]))


def top(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, doc_id, ord, score) of the best sections of each slice's k best documents, among which are the k best of all, and (query_id, blocks, opened): how many blocks there were and how many were read for it.

    ``queries``: query_id, terms (array, different ones).  ``search.best_sections`` ranks the first frame.
    """
    spark = queries.sparkSession
    q = queries.select("query_id", F.explode("terms").alias("term"))
    if index.stemmed:
        q = stems(q).select("query_id", F.col("stem").alias("term")).distinct()
    q = cut(q)
    blocks = asked(spark, index, q)
    heads = cut(blocks.select("term", "block", "n", "best", "best_doc"))
    raw = F.log((index.total - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = heads.groupBy("term").agg(F.sum("n").alias("df"), F.max("best").alias("top")).withColumn("idf", F.when(raw > 0, raw).otherwise(search.FLOOR))
    weighed = cut(q.join(small(cut(terms)), "term").select("query_id", "term", "idf", (F.col("idf") * F.col("top")).alias("most")))
    every = F.sum("most").over(Window.partitionBy("query_id"))
    own = cut(weighed.withColumn("others", every - F.col("most")))
    met = heads.join(own, "term").select("query_id", "term", "block", "idf", (F.col("idf") * F.col("best")).alias("bound"), "others", "best_doc")
    # The k-th best of different documents' single bests: the k-th best document scores at least that.
    docs = met.groupBy("query_id", "best_doc").agg(F.max("bound").alias("reached"))
    kth = docs.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("reached")))).where(F.col("nth") == k).select(F.col("query_id").alias("q"), "reached")
    judged = met.join(small(cut(kth)), F.col("query_id") == F.col("q"), "left")
    opens = F.col("bound") + F.col("others") >= F.coalesce(F.col("reached"), F.lit(0.0)) - 1e-6
    judged = cut(judged.select("query_id", "term", "block", "idf", opens.alias("opens")))
    # Of a block once what its questions ask of it; a slice's blocks are scored in one task, and only its best documents leave it.
    wanted = judged.where("opens").groupBy("term", "block").agg(F.collect_list(F.struct("query_id", "idf")).alias("by"))
    hits = dealt(blocks.select("slice", "term", "block", "held").join(small(cut(wanted)), ["term", "block"]), "slice")
    hits = hits.select("slice", F.explode("by").alias("q"), "held").select("slice", "q.query_id", "q.idf", F.explode("held").alias("h"))
    scored = hits.groupBy("slice", "query_id", "h.doc_id", "h.ord").agg(F.sum(F.col("idf") * F.col("h.gain")).alias("score"))
    exact = scored.withColumn("s", F.round("score", 9))
    one = exact.withColumn("nth", F.row_number().over(Window.partitionBy("slice", "query_id", "doc_id").orderBy(F.desc("s"), "ord"))).where("nth = 1")
    best = one.withColumn("nth", F.row_number().over(Window.partitionBy("slice", "query_id").orderBy(F.desc("s"), "doc_id"))).where(F.col("nth") <= k)
    return best.select("query_id", "doc_id", "ord", "score"), judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if("opens").alias("opened"))
