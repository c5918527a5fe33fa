"""Eligibility, alignment and contract checks on small tables."""

import hashlib

from pyspark.sql import functions as F

from lexloom.functions import grammar as G
from lexloom.functions import text as T
from lexloom.operators import validation as V
from lexloom.sources import files


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_eligible_and_unmatched(spark):
    df = spark.createDataFrame([("a", 1), ("b", 9), ("c", 9), (None, 9)], "k string, n int")
    seen = spark.createDataFrame([("c",), (None,), ("c",)], "k string")
    assert rows(V.eligible(df, F.col("n") > 5, (seen, "k")), "k") == [(None, 9), ("b", 9)]
    assert [r.k for r in V.unmatched(df, seen, "k").orderBy("k").collect()] == [None, "a", "b"]


def test_aligned(spark):
    a = spark.createDataFrame([("g", 1, "x"), ("g", 2, "y")], "g string, n int, name string")
    b = spark.createDataFrame([("g", 5, "x"), ("h", 1, None)], "g string, n int, name string")
    got = V.aligned(a, b, "g", "n", "name").orderBy("g", "place").collect()
    assert [(r.g, r.place, r.name_a, r.name_b, r.same) for r in got] == [("g", 1, "x", "x", True), ("g", 2, "y", None, False), ("h", 1, None, None, True)]


def test_bounds_and_reviews(spark):
    df = spark.createDataFrame([("IPC",), ("IPC",), ("BNS",)], "code string")
    assert rows(V.bounds_kept(df, "code", {"IPC": 2, "BNS": 2, "X": 0}), "code") == [("BNS", 1, 2, False), ("IPC", 2, 2, True), ("X", 0, 0, True)]
    r = spark.createDataFrame([("good", 2, 1), ("odd", 3, None)], "level string, a int, b int")
    problems = V.review_problems({"level": ("good", "bad")}, {"a": (0, 2), "b": (0, 2)})
    assert [x.p for x in r.select(problems.alias("p")).collect()] == [[], ["level", "a", "b"]]
    assert r.agg(V.fields_percent(["a", "b"], 2).alias("x")).first().x == 100.0
    assert r.limit(0).agg(V.fields_percent(["a", "b"], 2).alias("x")).first().x is None


def test_cues_and_probes(spark):
    df = spark.createDataFrame([("1 and २", "1 2", "1")], "r string, b string, c string")
    assert df.select(V.lost_cues(F.col("r"), F.col("b"), F.col("c")).alias("x")).first().x == ["2"]
    assert V.probes(df.select("r"), ["p", "q"], 3).count() == 6
    assert df.select(V.damaged(F.lit("a��")).alias("x")).first().x == 2
    assert df.select(V.families(F.lit("The boat sank"), {"w": ("boat", "ship"), "m": ("gold",)}).alias("x")).first().x == 1


def test_text_helpers(spark):
    df = spark.createDataFrame([("Audio/WAV; rate=16", "./a\\b.txt", 0.9)], "h string, p string, v double")
    r = df.select(T.media_type("h").alias("m"), T.relative_path("p").alias("p"), T.detection_status(F.col("v"), F.lit(True)).alias("s"), T.period(F.array().cast("array<string>"), F.lit(None).cast("string")).alias("d")).first()
    assert tuple(r) == ("audio/wav", "a/b.txt", "detected", "an unspecified date")


def test_localized_dates(spark):
    months = G.locale_months(spark, ("hi", "gu", "en"))
    assert G.localized_dates("17 मार्च 2020, १८ अगस्त 2022; 31 फ़रवरी 2020; 2024 June 5", months) == ["2020-03-17", "2022-08-18", "2024-06-05"]


def test_transcripts():
    text, log = G.transcript_repair("section three oh two and grievious hurt")
    assert text == "section 302 and grievous hurt" and [k for k, _, _ in log] == ["section", "lexicon"]


def test_gated_catalog(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('[{"a": "b"}]')
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    assert files.gated(spark, str(path), "a string", digest).count() == 1
    assert files.gated(spark, str(path), "a string", "0" * 64).count() == 0
    want = spark.createDataFrame([("x", "1"), ("y", "2")], "file string, sha256 string")
    have = spark.createDataFrame([("x", "1"), ("z", "2")], "file string, sha256 string")
    assert rows(files.registered_changes(have, want), "file") == [("y",)]
