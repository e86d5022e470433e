"""Co-occurrence with heavy members in bitmaps against counting."""

import random
from collections import Counter

import pytest

from folioscope.operators import graph


@pytest.mark.parametrize("heavy,bits", [(64, 1 << 13), (6, 128), (1, 64)])
def test_co_occurrence_is_counting(spark, monkeypatch, heavy, bits):
    monkeypatch.setattr(graph, "HEAVY", heavy)
    monkeypatch.setattr(graph, "BITS", bits)
    rng = random.Random(5)
    rows = [(f"s{s}", m) for m in range(400) for s in {min(int(rng.expovariate(0.15)), 39) for _ in range(rng.choice([1, 2, 3, 25]))}]
    rows += rows[:50]
    sets = {}
    for s, m in rows:
        sets.setdefault(s, set()).add(m)
    want = Counter()
    for s in sets:
        ranked = sorted((-len(sets[s] & sets[o]), o) for o in sets if o != s and sets[s] & sets[o])[:5]
        for k, (n, o) in enumerate(ranked):
            want[s, o, -n, k + 1] += 1
    got = graph.co_occurrence(spark.createDataFrame(rows, "slug string, member long").repartition(3), 5)
    assert Counter((r.slug, r.other, r.shared, r["rank"]) for r in got.collect()) == want
