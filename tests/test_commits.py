"""Versions of sets of tables: conflicts, snapshots, first writers."""

import threading

import pytest

from folioscope.sources import commits


def test_readers_see_one_version_and_writers_notice_each_other(spark, tmp_path):
    root, df = str(tmp_path), lambda *x: spark.createDataFrame([(i,) for i in x], "i int")
    with pytest.raises(FileNotFoundError):
        commits.snapshot(spark, root)
    assert commits.commit({"docs": df(1), "links": df(2)}, root, follows=0) == 1
    old = commits.snapshot(spark, root)
    assert commits.commit({"docs": df(3, 4)}, root, follows=1) == 2
    with pytest.raises(commits.Superseded):
        commits.commit({"docs": df(9)}, root, follows=1)
    new = commits.snapshot(spark, root)
    rows = lambda t: sorted(r.i for r in t.collect())
    assert (rows(old["docs"]), rows(new["docs"]), rows(new["links"])) == ([1], [3, 4], [2])
    assert rows(commits.snapshot(spark, root, 1)["docs"]) == [1]
    assert len(commits.unnamed(spark, root)) == 1  # the refused write
    assert not commits._take(spark, root, 2, b"{}") and commits.versions(spark, root) == [1, 2]


def test_writers_at_once_get_numbers_of_their_own(spark, tmp_path):
    root, got = str(tmp_path), []
    work = [threading.Thread(target=lambda k=k: got.append(commits.commit({f"t{k}": spark.createDataFrame([(k,)], "i int")}, root))) for k in range(4)]
    [w.start() for w in work]
    [w.join() for w in work]
    assert sorted(got) == [1, 2, 3, 4] and set(commits.snapshot(spark, root)) == {"t0", "t1", "t2", "t3"}


def test_a_writer_that_died_is_named(spark, tmp_path):
    root = str(tmp_path)
    commits.commit({"t": spark.range(1)}, root)
    assert commits._take(spark, root, 2, b"")
    with pytest.raises(commits.Superseded, match="died"):
        commits.commit({"t": spark.range(2)}, root, tries=2)
    assert commits.snapshot(spark, root)["t"].count() == 1


def test_the_first_writer_of_an_id_stays(spark):
    docs = spark.createDataFrame([("note", "a", 2), ("note", "a", 1), ("note", "b", 3), ("concept", "c", 4)], "doc_type string, doc_id string, writer long")
    sections = spark.createDataFrame([("note", "a", 1, "x"), ("note", "a", 2, "y"), ("note", "b", 3, "z")], "doc_type string, doc_id string, writer long, name string")
    links = spark.createDataFrame([("concept", "c", 4, "note", "a"), ("concept", "c", 4, "note", "a"), ("note", "a", 2, "note", "b")], "doc_type string, doc_id string, writer long, to_type string, to_id string")
    t = commits.index_tables(docs, sections, links)
    assert sorted((r.doc_id, r.writer) for r in t["docs"].collect()) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(r.name for r in t["sections"].collect()) == ["x", "z"] and t["links"].count() == 1 and [r.doc_id for r in t["orphans"].collect()] == ["b"]
