"""A paper's mentions are gathered where its text lies; papers that share an id still make one list."""

import re

from pyspark.sql import functions as F

from folioscope.operators import assets


def plain(papers):
    """(doc_id, key): sentences and related, one by one."""
    named, said = {}, {}
    for doc, text in papers:
        parts = [x.strip() for x in re.split(r"(?<=[.!?])\s+(?=[A-Z(])", text or "")]
        for at, sentence in enumerate(x for x in parts if len(x) >= assets.LEAST_SENTENCE):
            for m in re.finditer(assets.REFERENCE, sentence, re.A):
                pre, noun = (m[1] or "").lower(), m[2].lower()
                head = "extdata" if pre.startswith("extended") else "supp" if pre.startswith("suppl") else ""
                kind = head + ("table" if noun.startswith("table") else "fig" if head else "figure")
                for n in re.findall(r"\d+", re.sub(r"(?<=\d)[A-Za-z]", "", m[3])):
                    named.setdefault((doc, sentence), set()).add((kind, int(n), n))
                    own = said.setdefault((doc, kind + n), {})
                    own[sentence] = min(own.get(sentence, at), at)
    out = {}
    for (doc, key), own in said.items():
        kept = [s for at, s in sorted((at, s) for s, at in own.items())][: assets.MOST_MENTIONS]
        other = sorted(x for x in set().union(*[named[doc, s] for s in kept]) if x[0] + x[2] != key)
        out[doc, key] = (kept, [k + t for k, _, t in other][: assets.MOST_RELATED])
    return out


def got(df):
    return {(r.doc_id, r.key): (list(r.sentences), list(r.related)) for r in df.collect()}


SAME = "See Fig. 1 and Table 2 for the same thing here. "
MANY = " ".join(f"Sentence number {n} says what Figs. {n % 5}, {n % 7} and {n}b show with FIGURE {40 - n} too." for n in range(40))
PAPERS = [
    (1, SAME + "No mention of anything in this one. " + SAME + MANY), (2, None), (3, ""), (4, "Figures and tables without any number are not named."),
    (5, "Supplementary Figs. 1, 3 and S4 and Extended Data Table 02 and Table 2 are here. " + ", ".join(f"Table {n}" for n in range(30, 1, -1)) + " are many tables."), (6, "Fig. 1."),
]


def test_sentences_are_not_shuffled(spark):
    df = assets.mentions(spark.createDataFrame(PAPERS, "doc_id long, text string"))
    assert got(df) == plain(PAPERS) and len(got(df)) > 40
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    own, shared = final.split("ObjectHashAggregate", 1)
    assert "Generate" in own and not re.search(r"hashpartitioning\((?!__)", own)
    assert "EmptyRelation" in shared  # no paper's id is another's, so nothing comes to the shuffle


def test_papers_of_one_id_make_one_list(spark):
    papers = [(9, SAME + MANY), (9, MANY.replace("Sentence", "Saying") + " " + SAME), (9, None), (None, SAME), (None, "Another paper names Fig. 1 and nothing else at all."), (7, SAME)]
    df = assets.mentions(spark.createDataFrame(papers, "doc_id long, text string"))
    assert got(df) == plain(papers) and df.where(F.col("doc_id").isNull()).count() == 2
