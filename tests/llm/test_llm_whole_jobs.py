"""What the queries must not leave out."""

import pytest
from pyspark.sql import functions as F

from lexloom.llm import queries
from lexloom.llm import reading as R
from lexloom.llm.base import table

SF = "/root/testdata/sf0.01"


def test_every_text_is_graded(spark):
    documents = table(spark, SF, "documents").where("text is not null")
    got = {r.doc_id: r for r in queries.p9_grades(spark, SF).collect()}
    assert got.keys() == {r.doc_id for r in documents.select("doc_id").collect()}
    wordless = {r.doc_id for r in documents.where(~F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    assert {k for k, r in got.items() if r.grade is None} == {k for k, r in got.items() if r.flag == "no-words"} == wordless
    assert all((r.band in R.BANDS) == (r.grade is not None) for r in got.values())
    assert {(k, r.band) for k, r in got.items() if r.flag is None} == {tuple(r) for r in queries.p9_found(spark, SF).collect()}


def test_flags_of_grades(spark):
    graders = R.train_both(table(spark, SF, "documents"), "doc_id", "text", "source", table(spark, SF, "reading_labels"), "doc_id", "band")
    easy = "The man ran home. He had a red bag. She saw him go. " * 8
    rows = [(1, easy, "en"), (2, "He ran.", "en"), (3, easy, None), (4, "उसने चोरी की। वह भाग गया।", "hi"), (5, "他偷了东西。他跑了。", "zh"), (6, "", "en"), (7, " 12 !", None), (8, None, "en"), (9, easy, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in R.every_level(df, "doc_id", "text", "lang", graders).collect()}
    assert {k: r.flag for k, r in got.items()} == {1: None, 2: "short", 3: "unknown-language", 4: "other-language", 5: "other-language", 6: "no-words", 7: "no-words", 9: "unknown-language"}
    assert [got[k].grade for k in (6, 7)] == [None, None] and got[1].grade == got[3].grade == got[9].grade
    assert R.every_level(df.limit(0), "doc_id", "text", "lang", graders).count() == 0


@pytest.mark.parametrize("text, sizes", [("उसने चोरी की। वह भाग गया।", [3, 3]), ("اس نے چوری کی۔ وہ بھاگ گیا۔", [4, 3]), ("他偷了东西。他跑了。", [3, 2])])
def test_words_of_other_scripts(text, sizes):
    assert [len(R.ANY_WORD.findall(p)) for p in R.ANY_END.split(text) if R.ANY_WORD.findall(p)] == sizes


def test_uniform_forms_and_classes_of_all_fields(spark):
    got = queries.p5_uniform(spark, SF)
    assert got.columns == ["tbl", "field", "row_id", "uniform_text"]
    forms = {(r.tbl, r.field, r.row_id): r.uniform_text for r in got.collect()}
    classes = {(r.tbl, r.field, r.row_id): r.class_id for r in queries.p5_field_classes(spark, SF).collect()}
    stored = {(name, field, r[0]): r[1] for name, field in queries.ALIKE for r in table(spark, SF, name, "row_id", field).collect()}
    assert forms.keys() == stored.keys() and {k for k, t in stored.items() if t} == classes.keys()
    assert all((forms[k] is None) == (t is None) for k, t in stored.items())
    assert all(forms[k] == forms[k[0], k[1], c] for k, c in classes.items())
    pairs = {tuple(r) for r in queries.p5_found(spark, SF).collect()}
    assert pairs and all(forms[t, f, a] == forms[t, f, b] and classes[t, f, a] == classes[t, f, b] for t, f, a, b in pairs)
