"""Which notes mention which terms, and which sentences mention which figures."""

import random
import re

from folioscope.operators import assets
from folioscope.operators import mentions as M


def found(spark, notes, forms, most=400):
    n = spark.createDataFrame(notes, "doc_id string, text string").repartition(2)
    f = spark.createDataFrame(forms, "slug string, form string, kind string")
    return sorted(map(tuple, M.mentions(n, f, most).collect()))


def test_genes_match_as_written_and_terms_in_either_case(spark):
    notes = [("a", "We sequenced SCN2A in trios."), ("b", "Nav1.2 currents fell; scn2a is lowercase here."), ("c", "The SCN2A1 pseudogene and SCN2A-related epilepsy."), ("d", "de novo variants were rare"), ("e", None)]
    forms = [("scn2a", "SCN2A", "gene"), ("scn2a", "Nav1.2", "gene"), ("de-novo-variant", "de novo variant", "term"), ("de-novo-variant", "De novo variants", "term"), ("none", None, "term"), ("none", "", None)]
    assert found(spark, notes, forms) == [("de-novo-variant", "d"), ("scn2a", "a"), ("scn2a", "b"), ("scn2a", "c")]


def test_plurals_and_short_capitals(spark):
    forms = [("prs", "polygenic risk score", "term"), ("nitric-oxide", "nitric oxide", "term"), ("nitric-oxide", "NO", "term")]
    notes = [("a", "polygenic risk scores were computed for each cohort."), ("x", "There was no effect on behaviour."), ("y", "Nitric oxide signalling rose."), ("z", "NO donors were applied."), ("v", "Two NOs.")]
    assert found(spark, notes, forms) == [("nitric-oxide", "y"), ("nitric-oxide", "z"), ("prs", "a")]


def test_a_common_term_is_left_out_and_a_common_token_is_not(spark):
    notes = [(f"n{i}", "alpha wave of rhythm") for i in range(5)] + [("m", "alpha rhythm disorder here")]
    forms = [("alpha", "alpha", "term"), ("disorder", "alpha rhythm disorder", "term")]
    assert found(spark, notes, forms, 5) == [("disorder", "m")]  # alpha is in six notes; the other term is in question for one


def test_marks_in_forms_are_no_pattern(spark):
    notes = [("a", "levels of IL-2 (human rose"), ("b", "a Nav1x2 channel"), ("c", "C++ and İstanbul C++ code")]
    assert found(spark, notes, [("il", "IL-2 (human", "term"), ("nav", "Nav1.2", "term"), ("c", "C++", "term")]) == [("c", "c"), ("il", "a")]


def plain(notes, forms, most):
    """The rules as regular expressions, one text at a time."""
    out = []
    for slug in {s for s, *_ in forms}:
        own = sorted({f for s, f, _ in forms if s == slug}, key=len, reverse=True)
        gene = any(k == "gene" for s, _, k in forms if s == slug)
        keys = {max(t, key=len).lower() for f in own if (t := M.TOKEN.findall(f))}
        short = [f for f in own if M.SHORT_UPPER.fullmatch(f)]
        long = [f for f in own if f not in short]
        any_of = lambda fs: "|".join(map(re.escape, fs))
        body = any_of(own) if gene else "|".join(([f"(?-i:{any_of(short)})"] if short else []) + ([f"(?:{any_of(long)})(?:s|es)?"] if long else []))
        pattern = re.compile(rf"(?<![A-Za-z0-9])(?:{body})(?![A-Za-z0-9])", 0 if gene else re.I)
        posted = [(d, t) for d, t in notes if {x.lower() for x in M.TOKEN.findall(t)} & keys]
        if len(posted) <= most:
            out += [(slug, d) for d, t in posted if pattern.search(t)]
    return sorted(out)


def test_mentions_are_those_of_regular_expressions(spark, monkeypatch):
    rng = random.Random(2)
    words = ["NO", "no", "No", "nos", "SHANK3", "shank", "Nav1.2", "risk", "risks", "score", "scores", "A", "a", "bus", "buses", "-", "(x)", "é", "x.y", "II"]
    text = lambda n: rng.choice([" ", " ", "-", ""]).join(rng.choice(words) for _ in range(n))
    notes = [(f"n{i}", text(rng.randint(1, 9))) for i in range(150)]
    forms = []
    for i in range(60):
        kind = rng.choice(["gene", "term"])
        forms += [(f"s{i}", text(rng.randint(1, 3)), kind) for _ in range(rng.randint(1, 3))]
    for chars in (M.FORM_CHARS, 100):
        monkeypatch.setattr(M, "FORM_CHARS", chars)
        assert found(spark, notes, forms, 60) == plain(notes, forms, 60)


def test_every_reference_of_a_sentence_is_a_mention(spark):
    text = "The response is shown in Fig. 1 and the control again in Fig. 3 of this paper. Group sizes are given in Fig. 1b and in Table 2."
    got = {r.key: (len(r.sentences), list(r.related)) for r in assets.mentions(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got == {"figure1": (2, ["figure3", "table2"]), "figure3": (1, ["figure1"]), "table2": (1, ["figure1"])}
