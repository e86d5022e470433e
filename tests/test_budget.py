"""The ledger under caps, by hand and against one fold over everything."""

import random

from folioscope.operators import budget

SCHEMA = "period string, member_id string, at int, seq long, op string, rid string, micros long, member_cap long, lab_cap long"


def entries(spark, rows):
    """Rows are (member, op, rid, micros, member_cap, lab_cap) in order, of one period."""
    log = [("2026-09", m, i, i, op, rid, n, cap, lab) for i, (m, op, rid, n, cap, lab) in enumerate(rows)]
    return [(r.outcome, r.refused_by, r.available, r.reserved, r.settled) for r in sorted(budget.ledger(spark.createDataFrame(log, SCHEMA)).collect(), key=lambda r: r.seq)]


def test_a_period_cap_refuses_what_goes_over_it_and_allows_what_reaches_it(spark):
    rows = [("m1", "reserve", "j1", 500, None, 600), ("m2", "reserve", "j2", 500, None, 600), ("m3", "reserve", "j3", 100, None, 600), ("m2", "settle", "j2", 5, None, 600)]
    assert entries(spark, rows) == [("held", None, None, 500, 0), ("refused", "lab", 100, 0, 0), ("held", None, None, 100, 0), ("missing", None, None, 0, 0)]


def test_a_member_cap_counts_what_is_settled_and_binds_no_one_else(spark):
    rows = [("m1", "reserve", "a", 200, 300, None), ("m1", "settle", "a", 150, 300, None), ("m1", "reserve", "b", 200, 300, None), ("m1", "reserve", "c", 150, 300, None), ("m2", "reserve", "d", 400, None, None)]
    assert entries(spark, rows) == [("held", None, None, 200, 0), ("settled", None, None, 0, 150), ("refused", "member", 150, 0, 150), ("held", None, None, 150, 150), ("held", None, None, 400, 0)]


def test_changes_happen_once_and_unknown_bills_stay_reserved(spark):
    rows = [("m", op, "a", n, None, None) for op, n in (("reserve", 60), ("unknown", None), ("unknown", None), ("settle", 75), ("settle", 99), ("release", None), ("unknown", None))]
    rows += [("m", "reserve", "b", 10, None, None), ("m", "release", "b", None, None, None), ("m", "release", "b", None, None, None), ("m", "settle", "b", 1, None, None), ("m", "settle", "none", 1, None, None)]
    assert [r[0] for r in entries(spark, rows)] == ["held", "unknown", "same", "settled", "same", "invalid", "invalid", "held", "released", "same", "invalid", "missing"]
    assert [r[3:] for r in entries(spark, rows)][:4] == [(60, 0), (60, 0), (60, 0), (0, 75)]


def test_ledger_is_one_fold(spark):
    rng, log = random.Random(7), []
    for i in range(1500):
        period, member = rng.choice(["2026-01", "2026-02", None]), rng.choice(["a", "b", "c", "d"])
        rid = f"{period}{member}{rng.randint(0, 80)}"
        lab = 400 if period == "2026-02" else None if period else 10**6
        log.append((period, member, i // 3, i, rng.choice(["reserve", "reserve", "settle", "release", "unknown"]), rid, rng.randint(0, 90), {"a": 150, "b": 0}.get(member), lab))
    got = {r.seq: (r.outcome, r.refused_by, r.available, r.reserved, r.settled) for r in budget.ledger(spark.createDataFrame(log, SCHEMA).repartition(3)).collect()}
    ledgers = {p: budget.Ledger(True) for p in ("2026-01", "2026-02", None)}
    for period, member, _, seq, *rest in log:
        *found, _ = ledgers[period].enter(member, *rest)
        assert got[seq] == (*found, *ledgers[period].members[member])
    assert {"lab", "member"} <= {g[1] for g in got.values()}
