"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline as P
from pyspark.sql import functions as F
from riskloom.llm import pii, piece_dropout
from riskloom.llm.common import documents, stored


def test_stages_take_effect(spark, sf_dir):
    docs = documents(spark, sf_dir)
    before = docs.count()
    for name, stage in P.STAGES[:-1]:
        after = stored(stage(spark, docs, sf_dir), name)
        assert after.columns == P.COLUMNS
        n = after.count()
        assert 0.5 * before < n <= before
        if name == "personal_data":
            left = pii.find(after, weights={}).where(F.size("base") > 0).count()
            assert n == before and left == 0 and after.where("n_chars <> length(text)").count() == 0
        if name == "near_duplicates":
            assert after.select("text").distinct().count() == n
        docs, before = after, n
    out = P.STAGES[-1][1](spark, docs, sf_dir)
    back = piece_dropout.decode(out, keep=["doc_id"]).join(docs.select("doc_id", "text"), "doc_id")
    assert back.count() == before and back.where("decoded <> text").count() == 0


def test_empty_input(spark, sf_dir):
    docs = documents(spark, sf_dir).limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
