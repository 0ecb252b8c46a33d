"""Each stage of the pipeline on rows that are null, empty, repeated, very long or beside columns of clashing names."""

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from riskloom.llm import piece_dropout
from riskloom.llm.common import documents, stored

#: id, text, source; lang and n_chars follow.
ODD = [
    (-1, None, None), (-2, "", "s0"), (-3, "Mail jo@x.example or call +44 20 7946 0958", "s0"), (-3, "Mail jo@x.example or call +44 20 7946 0958", "s0"), (None, "a text without an id", None), (-4, "long " * 40000, "s1"),
    (-5, "é▁ü 日本 \U0001F389 \x00\x01 z", "s1"), (-6, " \t\n", "s2"),
]


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    rows = spark.createDataFrame([(i, t, None, s, None) for i, t, s in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    both = documents(spark, sf_dir).select(*P.COLUMNS).unionByName(rows)
    clashing = ["score", "fp", "id", "node", "spans", "pieces", "toxic", "quality", "component_id", "_text", "label"]
    return stored(both.select("*", *(F.lit("own").alias(c) for c in clashing)), "odd-documents")


def _odd(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.where("doc_id < 0 or doc_id is null").collect()), key=str)


def test_toxicity_keeps_clean_odd_rows(spark, sf_dir, odd):
    after = P.drop_toxic(spark, odd, sf_dir)
    assert after.columns == P.COLUMNS and _odd(after) == sorted(((i, t) for i, t, _ in ODD), key=str)


def test_near_duplicates_keep_one_of_repeated_and_of_wordless_rows(spark, sf_dir, odd):
    after = P.drop_near_duplicates(spark, odd, sf_dir)
    got = _odd(after)
    assert after.columns == P.COLUMNS
    assert [x for x in got if x[0] == -3] == [(-3, ODD[2][1])] and (None, ODD[4][1]) in got and (-4, ODD[5][1]) in got and (-5, ODD[6][1]) in got
    assert [i for i, t in got if not (t or "").strip()] == [-6]  # null, empty and blank texts are alike; the smallest id stays


def test_redaction_keeps_all_rows_and_null_texts(spark, sf_dir, odd):
    after = P.redact(spark, odd, sf_dir)
    got = _odd(after)
    assert after.columns == P.COLUMNS and after.count() == odd.count() and [i for i, _ in got] == sorted((i for i, _, _ in ODD), key=str)
    texts = {i: t for i, t in got}
    assert "jo@x.example" not in texts[-3] and "7946" not in texts[-3] and texts[-5] == ODD[6][1] and texts[-4] == ODD[5][1]
    assert texts[-1] in (None, "") and texts[-2] == ""
    assert after.where("n_chars <> length(text)").count() == 0


def test_mixing_gives_repeated_rows_one_fate(spark, sf_dir, odd):
    after = P.mix(spark, odd, sf_dir)
    got = _odd(after)
    assert after.columns == P.COLUMNS and set(got) <= {(i, t) for i, t, _ in ODD}
    assert len([x for x in got if x[0] == -3]) in (0, 2)


def test_pieces_of_every_row_decode_to_its_text(spark, sf_dir, odd):
    out = P.encode(spark, odd, sf_dir)
    assert out.count() == odd.count()
    back = {r["doc_id"]: r["decoded"] for r in piece_dropout.decode(out.where("doc_id < 0 or doc_id is null"), keep=["doc_id"]).collect()}
    assert {i: (t or "") for i, t, _ in ODD} == back
