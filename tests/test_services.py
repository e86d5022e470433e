"""Connectors, the store behind its protocol, guards and actions."""

import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope import api
from folioscope.functions import guards
from folioscope.plans.services import _pdf
from folioscope.sources import connectors as C
from folioscope.sources import store as S


def test_bad_keys_are_found_by_halving():
    calls = []

    def fetch(keys):
        calls.append(len(keys))
        if "bad" in keys:
            raise C.Rejected
        return [(k, {"n": k}) for k in keys if k != "none"] + [(keys[0], {"n": keys[0]}), ("never asked", {})]

    got = C.asked(["a", "b", "bad", "c", "none"], fetch)
    assert got["a"] == [{"n": "a"}] and got["b"] == [{"n": "b"}] and got["bad"] is None and got["c"] == [{"n": "c"}] and "never asked" not in got
    assert max(calls) == 5 and len(calls) <= 7


def test_lookups_of_nulls_repeats_and_nothing(spark):
    keys = spark.createDataFrame([("a",), ("a",), (None,), ("b c",)], "k string")
    found = C.looked_up(keys, "k", lambda ks: [(k, {"k": k}) for k in ks], 2, r"^\S+$")
    assert sorted(map(tuple, found.collect())) == [("a", "matched", '{"k": "a"}'), ("b c", "invalid", None)]
    assert C.looked_up(keys.where("false"), "k", lambda ks: 1 / 0, 2).count() == 0


def test_ranged_views_read_what_files_read():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(10_000))
    asked = []
    view, plain = C.Ranged(lambda a, b: (asked.append((a, b)), data[a:b])[1], len(data), 512, 3), io.BytesIO(data)
    for _ in range(300):
        if rng.random() < 0.5:
            at = (rng.randrange(11_000), 0) if rng.random() < 0.7 else (-rng.randrange(5000), 2)
            assert view.seek(*at) == plain.seek(*at)
        n = rng.randrange(1500)
        assert view.read(n) == plain.read(n) and view.tell() == plain.tell()
    assert all(b - a <= 512 and a % 512 == 0 for a, b in asked) and view.requests == len(asked)
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("x", "text")
    with zipfile.ZipFile(C.Ranged(lambda a, e: b.getvalue()[a:e], len(b.getvalue()), 64)) as z:
        assert z.read("x") == b"text"


def test_first_pages(spark):
    lines = ["A (b) \\ title", "second line"]
    whole = [_pdf([x.replace("\\", "\\\\") for x in lines], flate) for flate in (False, True)]
    assert [C.first_page(w) for w in whole] == ["A (b) \\ title\nsecond line"] * 2
    loop = b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [2 0 R] >> endobj"
    for bad in (b"", b"junk", loop, whole[0].replace(b"/Pages 2 0 R", b"/Pages 9 0 R"), whole[0].replace(b"trailer <<", b"trailer << /Encrypt 7 0 R"), whole[1].replace(b"x\x9c", b"zz")):
        try:
            assert C.first_page(bad) == ""
        except ValueError:
            pass
    rows = [(1, whole[0], hashlib.sha256(whole[0]).hexdigest().upper()), (2, whole[0], None), (3, None, "0" * 64), (4, whole[0], "0" * 64), (5, whole[0], "x")]
    got = {r.k: r.p.error for r in spark.createDataFrame(rows, "k int, c binary, h string").select("k", C.first_pages("c", "h").alias("p")).collect()}
    assert got == {1: None, 2: "invalid_stored_sha256", 3: "missing", 4: "sha256_mismatch", 5: "invalid_stored_sha256"}


def test_table_and_memory_stores_agree(spark):
    rng = random.Random(2)
    stores = S.MemoryStore(), S.TableStore(spark)
    for _ in range(25):
        ops = []
        for _ in range(rng.randint(1, 3)):
            op = rng.choice(["create", "create", "update", "check", "delete"])
            ops.append((op, "p", f"k{rng.randrange(4)}", None if op == "create" else rng.randint(1, 2), {"v": rng.randrange(9)}))
        outcome = []
        for s in stores:
            try:
                s.transact(ops)
                outcome.append("done")
            except S.Conflict:
                outcome.append("conflict")
        assert outcome[0] == outcome[1]
        assert stores[0].query("p", "k", 2) == stores[1].query("p", "k", 2) and stores[0].query("p", "k", 9, "k0") == stores[1].query("p", "k", 9, "k0")
    assert [s.get("p", "none") for s in stores] == [None, None]
    S.put(stores[0], "q", "a", {"x": 1})
    S.update(stores[0], "q", "a", 1, {"x": 2})
    assert stores[0].get("q", "a") == (2, {"x": 2})
    S.delete(stores[0], "q", "a", 2)
    assert stores[0].get("q", "a") is None


def test_guards(spark):
    ok = lambda k: spark.range(1).select(guards.page_key_problem(F.lit(k)).alias("p")).first().p is None
    assert ok("wiki/a/b.md") and not any(map(ok, ["wiki/b.md", "wiki/a/b.md\n", "wiki/a/./b.md", "wiki/a//b.md", "x/wiki/a/b.md", "wiki/a/" + "b" * 1020 + ".md", None, ""]))


def test_actions_refuse_what_they_do_not_take(spark, sf):
    for event in ({}, {"action": "drop"}, {"action": "read"}, {"action": "read", "doc_id": 1, "table": "x"}, {"action": "search", "query": " "}, {"action": "search", "query": "a", "limit": 51}, {"action": "read", "doc_id": 1, "start": -1}):
        with pytest.raises(api.BadRequest):
            api.handle(spark, sf, event)
    found = api.handle(spark, sf, {"action": "search", "query": "the and", "limit": 3}).collect()
    assert sorted(r["rank"] for r in found) == [1, 2, 3] and all("[the]" in r.snippet.lower() or "[and]" in r.snippet.lower() for r in found)
    assert api.handle(spark, sf, {"action": "backlinks", "target": "/THE"}).count() > 0


def test_replies_are_checked(spark):
    got = {r.key: (r.reply, r.problem, r.calls) for r in C.called(spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "k int, p string"), "k", "p", lambda p: p * 2, lambda r: None if r else "empty", 3).collect()}
    assert got == {1: ("aa", None, 1), 2: (None, "empty", 3), 3: (None, "empty", 3)}
