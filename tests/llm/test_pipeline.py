"""The stages one by one, each on what the one before kept."""

import pytest

import corpus_pipeline
from folioscope.llm import bpe
from tests.llm.test_operators import empty, folder, rows  # noqa: F401


@pytest.mark.parametrize("where", ["sf", "folder", "empty"])
def test_stages(spark, request, where, tmp_path):
    d = request.getfixturevalue(where)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        assert name == "byte_bpe" or out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "near_dedup":
            # A doc_id may stay with several texts that are in different groups, never twice with one.
            kept = [(r.doc_id, r.text) for r in docs.where(r"text rlike '[^\\x20\\x09-\\x0D]'").collect()]
            assert len(kept) == len({*kept})
        if name == "byte_bpe":
            import public_tokenizers as P

            with open(P.path(corpus_pipeline.RANKS), "rb") as f:
                e = bpe.encoder_of(f.read(), P.PATTERN)
            texts = {(r.doc_id, e.encode(r.text)) for r in before.collect()}
            assert {(r.doc_id, b"".join(i.to_bytes(4, "little") for i in r.ids)) for r in docs.collect()} == texts


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 50
