"""Nearest ranks against sorted lists."""

import random

import pytest

from folioscope.operators import ranks


@pytest.mark.parametrize("accuracy", [10_000, 5])
def test_nearest_ranks_are_those_of_sorted_values(spark, monkeypatch, accuracy):
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    rng, rows = random.Random(3), []
    for g, n in (("a", 1), ("b", 2), ("c", 20), ("d", 3000), (None, 37)):
        rows += [(g, rng.choice([rng.gauss(0, 1), 0.5, 10 ** rng.uniform(-300, 300), -1e300])) for _ in range(n)] + [(g, None)]
    rows += [("none", None), ("same", 2.0), ("same", 2.0)]
    got = {r.g: (r.p1, r.p50, r.p95, r.p100) for r in ranks.nearest_ranks(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", {"p1": 1, "p50": 50, "p95": 95, "p100": 100}).collect()}
    want = {}
    for g in {g for g, v in rows if v is not None}:
        v = sorted(v for x, v in rows if x == g and v is not None)
        want[g] = tuple(v[max(1, -(-len(v) * p // 100)) - 1] for p in (1, 50, 95, 100))
    assert got == want


def test_a_rank_outside_its_bounds_is_found_among_all(spark, monkeypatch):
    """A sketch that promises too much: the second pass finds nothing and looks everywhere."""
    monkeypatch.setattr(ranks, "ACCURACY", 2)
    rows = spark.createDataFrame([("a", float(i)) for i in range(1000)], "g string, v double")
    asked = spark.createDataFrame([("a", "p", 500, 0.0, 3.0, 0.0, 999.0)], "g string, name string, rank long, low double, high double, __min double, __max double")
    assert ranks._among(rows.withColumnRenamed("v", "__v"), ["g"], asked).first().value is None
    assert ranks.nearest_ranks(rows, ["g"], "v", {"p": 50}).first().p == 499.0
