import numpy as np
import pytest

from lexloom.llm import languages as L
from lexloom.llm import sentences as S
from lexloom.llm.base import table

SF = "/root/testdata/sf0.01"
FIELDS = ("theft", "injury", "cheating")


@pytest.fixture(scope="module")
def models(spark):
    rows = table(spark, SF, "multilingual_completion")
    tagger = S.train([(rows, "row_id", f) for f in FIELDS], 480)
    return tagger, L.train(table(spark, SF, "documents"), "doc_id", "text", "lang", rows, "row_id", "language", FIELDS, tagger)


def test_labels(spark):
    labels = ["hi", "HI", "hi-IN", "hin", "Hindi", "ur-IN", "zho", "und", "", None, "xx", " Tamil "]
    want = ["hi"] * 5 + ["ur", "zh", None, None, None, None, "ta"]
    assert [L.named_language(x) for x in labels] == want
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert [r.y for r in df.select(L.language_expr("l").alias("y")).collect()] == want


def test_grams_stay_in_their_text():
    flat, ends = L.grams(["ab", "", "ab"])
    assert flat[: ends[1]].tolist() == flat[ends[2] :].tolist() and len(ends) == 4
    one = L.grams(["x"] * 1100)[1]
    assert len(one) == 1101 and set(np.diff(one)) == {one[1]}


def test_held_out_documents(spark, models):
    tagger, model = models
    docs = table(spark, "/root/testdata/sf0.001", "documents").where("lang is not null and length(text) > 60 and instr(text, '\\n') = 0")
    got = L.document_languages(L.segments(docs, "doc_id", "text", tagger, model), "doc_id").join(docs, "doc_id").collect()
    assert len(got) > 20 and sum(r.language == r.lang for r in got) / len(got) > 0.95


def test_mixed_and_romanised(spark, models):
    rows = [(1, "दुकान से साइकिल बिना पूछे ले जाई गई। The lock at the cold store had been cut and a net was gone."), (2, "us par aarop hai ki usne Oskelu ka ghadi chhipakar rakha hai."), (3, None), (4, ""), (5, "12 34."), (1, "चोरी हुई।")]
    df = spark.createDataFrame(rows, "row_id long, text string").selectExpr("*", "'q' as language", "1 as confidence")
    got = L.segments(df, "row_id", "text", *models).collect()
    assert {(r.row_id, r.language) for r in got if r.language and r.confidence > 0.5} >= {(1, "hi"), (1, "en"), (2, "hi")}
    assert {r.row_id for r in got} == {1, 2}
    assert L.segments(df.limit(0), "row_id", "text", *models).count() == 0


def test_needs_labels(spark, models):
    rows = table(spark, SF, "multilingual_completion")
    with pytest.raises(ValueError):
        L.train(table(spark, SF, "documents").limit(0), "doc_id", "text", "lang", rows, "row_id", "language", FIELDS, models[0])
