"""Offers and answers by hand."""

from folioscope.operators.offers import Session, answered

OFFER = ("m", "deep", "a,b", "h1", 100, "p1", "x")


def issued():
    s = Session()
    assert s.issue(0, 1, *OFFER) == ("offered", 1)
    return s


def test_live_and_declined_offers_suppress_and_others_do_not():
    s = issued()
    assert s.issue(5, 2, *OFFER) == ("suppressed", 1)
    assert s.issue(5, 3, "m", "wide", "z", "h1", 100, "p1", "x") == ("suppressed", 1)  # the same input
    assert s.issue(5, 4, "m", "deep", "a", None, 100, "p1", "x") == ("offered", 4)
    assert s.issue(100, 5, *OFFER[:4], 200, "p1", "x") == ("offered", 5)  # the first has run out
    assert s.respond(110, "m", 5, "r", "decline", 1, "x", "p1") == ("declined", 5)
    assert s.issue(900, 6, *OFFER) == ("suppressed", 5)
    t = issued()
    t.respond(1, "m", 1, "r", "accept", 1, "x", "p1")
    assert t.issue(2, 7, *OFFER) == ("offered", 7)


def test_answers_are_checked_in_order():
    s = issued()
    assert s.respond(1, "other", 1, "r0", "accept", 1, "x", "p1")[0] == s.respond(1, "m", 9, "r0", "accept", 1, "x", "p1")[0] == "not_found"
    assert s.respond(1, "m", 1, "r1", "accept", 2, "x", "p1")[0] == s.respond(1, "m", 1, "r1", "accept", 1, "y", "p1")[0] == "revision_conflict"
    assert s.respond(2, "m", 1, "r1", "accept", 1, "x", "p1")[0] == "accepted"
    assert s.respond(3, "m", 1, "r1", "accept", 1, "x", "p1")[0] == "replayed" and s.respond(3, "m", 1, "r1", "decline", 1, "x", "p1")[0] == "idempotency_conflict"
    assert s.respond(4, "m", 1, "r2", "accept", 1, "x", "p1")[0] == "same" and s.respond(4, "m", 1, "r3", "decline", 1, "x", "p1")[0] == "revision_conflict"


def test_late_answers_and_old_policies():
    s = issued()
    assert s.respond(100, "m", 1, "r", "accept", 1, "x", "p1")[0] == s.respond(5, "m", 1, "r", "accept", 1, "x", "p1")[0] == "expired"
    t = issued()
    assert t.respond(5, "m", 1, "r", "accept", 1, "x", "p2")[0] == t.respond(6, "m", 1, "r", "accept", 1, "x", "p1")[0] == "stale"


def test_sessions_are_apart_and_in_order(spark):
    rows = [(s, 10 * i, i, "issue", "m", "deep", "a", None, 10 * i + 15, "p1", None, None, None, None, "x") for s in ("s1", "s2") for i in range(4)]
    schema = "session string, at long, seq long, op string, member string, kind string, targets string, input_hash string, expires long, policy string, offer long, request string, decision string, revision int, hash string"
    got = sorted((r.session, r.seq, r.outcome, r.about) for r in answered(spark.createDataFrame(rows[::-1], schema).repartition(3)).collect())
    assert got == [(s, *x) for s in ("s1", "s2") for x in ((0, "offered", 0), (1, "suppressed", 0), (2, "offered", 2), (3, "suppressed", 2))]
