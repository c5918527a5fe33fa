"""What the queries must not leave out."""

from lexloom import queries
from lexloom.functions import text as T
from lexloom.functions import words

PHRASES = {
    "give property": "he gave them false property",
    "delivery of property": "it resulted in delivery of any property",
    "deceived person": "a person was deceived",
    "tricked person": "he tricked a person",
    "deceived into property transfer": "he seduced a person into handing over any property",
    "led to property transfer": "they persuaded her to sell property",
    "without consent": "without the owner's consent",
    "without permission": "without somebody else’s permission",
    "out of possession": "out of another person's possession",
    "from possession": "from ravi's possession",
    "victim property stolen": "the complainant's new red bag was stolen",
    "caused injury": "he caused serious injury",
}


def test_all_phrases_have_labels(spark):
    assert len(words.PHRASES) == 27
    rows = spark.createDataFrame(list(PHRASES.items()), "label string, t string").select("label", T.phrase_labels("t").alias("got")).collect()
    assert [r.label for r in rows if r.label not in r.got] == []


def test_last_delivery_counts(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 4, "x"), ("b", 5, "y"), ("b", 6, "x"), ("c", 7, "x"), ("d", 8, "x"), ("d", 9, "x")]
    spark.createDataFrame(rows, "case_id string, row_id long, facts string").write.parquet(f"{tmp_path}/candidate_cases.parquet")
    got = {r.status: r.n for r in queries.redelivery_diff(spark, str(tmp_path)).collect()}
    assert got == {"changed": 1, "removed": 1}


def test_dates_of_five_languages(spark, tmp_path):
    texts = ["on the 3rd of March 2024", "July 5th, 2024", "3 Aug. 2024", "५ जुलाई 2024 को", "७ जुलै 2024 रोजी", "૫ જુલાઈ 2024", "۵ جولائی 2024", "31 April 2024", "5 Marching 2024", None]
    rows = [(k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "५ जुलाई 2024")], "item_id long, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    spark.createDataFrame([(1, "५ जुलाई 2024, 6 July 2024")], "row_id long, facts string").write.parquet(f"{tmp_path}/candidate_cases.parquet")
    got = sorted((r.tbl, r.row_id, r.value) for r in queries.named_dates(spark, str(tmp_path)).collect())
    want = ["2024-03-03", "2024-07-05", "2024-08-03", "2024-07-05", "2024-07-07", "2024-07-05", "2024-07-05"]
    assert got == [("candidate_cases", 1, "2024-07-05"), ("candidate_cases", 1, "2024-07-06")] + [("documents", k, v) for k, v in enumerate(want)] + [("eval_items", 1, "2024-07-05")]


def test_localized_dates_are_among_them(spark):
    sf = "/root/testdata/sf0.1"
    named = {(r.row_id, r.value) for r in queries.named_dates(spark, sf).where("tbl = 'eval_items'").collect()}
    assert {tuple(r) for r in queries.localized_dates(spark, sf).collect()} <= named
    assert queries.named_dates(spark, sf).where("tbl = 'documents'").count() > 0
