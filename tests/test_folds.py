"""Batches folded into counters, each once."""

from folioscope.operators import folds

SCHEMA = "work_id string, item_index long, pdf struct<checked: boolean, sha256_matches: boolean, doi_present: boolean, title_present: boolean, errors: array<string>>, recheck string, original map<string,string>, proposals map<string,string>, supplements array<string>, decisions map<string,string>"


def row(i, **more):
    return {"work_id": f"w{i}" + "x" * 200, "item_index": i, "pdf": None, "recheck": None, "original": None, "proposals": None, "supplements": None, "decisions": {"test": "review_required"}} | more


def test_a_batch_folded_twice_counts_once(spark, tmp_path):
    root = str(tmp_path)
    df = lambda *rows: spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    one = df(row(0, pdf=(True, True, True, True, ["e"])), row(1, proposals={"doi": "a", "year": "1"}, original={"doi": "a"}))
    two = df(row(2, supplements=["pmid"], pdf=(None, True, None, True, None)), *[row(i) for i in range(3, 6)])
    assert folds.fold(two, root, "000002") and folds.fold(one, root, "000000")
    first = sorted(map(tuple, folds.state(spark, root)["counters"].collect()))
    assert not folds.fold(two, root, "000002")
    assert sorted(map(tuple, folds.state(spark, root)["counters"].collect())) == first
    assert first == [("changed_proposal", "year", 1), ("decision", "test:review_required", 6), ("papers", "", 6), ("pdf_checked", "", 1), ("pdf_error", "e", 1), ("pdf_hash_verified", "", 2), ("pdf_identity_confirmed", "", 1), ("supplement", "pmid", 1)]
    samples = sorted((r.kind, r.key, r.item_index, len(r.work_id)) for r in folds.state(spark, root)["samples"].collect())
    assert samples == [("changed_proposal", "year", 1, 180)] + [("decision", "test:review_required", i, 180) for i in (0, 1, 2)]
