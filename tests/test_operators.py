"""Operators against small tables worked out by hand, with nulls, ties, repeated rows and empty tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from lexloom.operators import corpus, evaluation, intervals, keyphrases, retrieval, review
from lexloom.plans import analysis


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "Theft", "theft of boats"), (2, "Boats", "boats boats"), (3, None, None), (4, "Theft", "theft of boats")], "row_id long, title string, text string")
    q = spark.createDataFrame([(9, "theft boats"), (8, None), (7, "")], "qid long, t string")
    tokens = retrieval.document_tokens(docs, "row_id", "title", F.col("title"), F.col("text"))
    got = rows(retrieval.top(retrieval.scores(retrieval.query_tokens(q, "qid", "t"), tokens, retrieval.counted(docs)), 2), "qid", "rank")
    assert [(r[0], r[1], r[3]) for r in got] == [(9, 1, 1), (9, 4, 2)]
    assert got[0][2] == pytest.approx(got[1][2])
    assert retrieval.scores(retrieval.query_tokens(q.limit(0), "qid", "t"), tokens, retrieval.counted(docs)).count() == 0


def test_diversified(spark):
    ranked = spark.createDataFrame([(1, 10, "A", 9.0), (1, 11, "A", 8.0), (1, 12, "B", 1.0), (1, 13, "A", 7.0)], "qid long, doc long, code string, score double")
    assert [r.doc for r in retrieval.diversified(ranked, "code").orderBy("rank").collect()] == [10, 12, 11]


def test_references(spark):
    df = spark.createDataFrame([("IPC", "354d", ["bns-78"])], "code string, section string, maps_to array<string>")
    refs = F.array(F.struct(F.lit("BNS").alias("code"), F.lit("78").alias("section")), F.struct(F.lit(None).cast("string").alias("code"), F.lit("354D").alias("section")))
    r = df.select(retrieval.exact_reference(refs, F.col("code"), F.col("section")).alias("e"), retrieval.mapped_reference(refs, F.col("code"), F.col("maps_to")).alias("m")).first()
    assert r.e and r.m


def test_rule_points(spark):
    rules = spark.createDataFrame([("A", 5), ("A", 3)], "code string, points int")
    assert rows(retrieval.rule_points(spark.createDataFrame([("A",), ("B",)], "code string"), rules, ["code"]), "code") == [("A", 8), ("B", 0)]


def test_overlay_and_latest(spark):
    base = spark.createDataFrame([("a", "old", 1), ("b", "keep", 2)], "id string, title string, n int")
    extra = spark.createDataFrame([("a", None), ("c", "new")], "id string, title string")
    assert rows(corpus.overlay(base, extra, "id"), "id") == [("a", None, 1), ("b", "keep", 2)]
    assert rows(corpus.latest(spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, n int"), "k", "n"), "k") == [("a", 3), ("b", 2)]


def test_crosswalk(spark):
    edges = spark.createDataFrame([("i1", "b1"), ("i1", "b2"), ("i1", "b1"), (None, "b3")], "a string, b string")
    assert rows(corpus.adjacency(edges, "a", "b"), "id") == [("b1", ["i1"]), ("b2", ["i1"]), ("i1", ["b1", "b2"])]


def test_pages(spark):
    pages = spark.createDataFrame([("f", 1, "abc"), ("f", 2, None), ("f", 3, "xy")], "book string, page int, text string")
    starts = corpus.page_offsets(pages, "book", ["page"], "text")
    assert [r.page_start for r in starts.orderBy("page").collect()] == [0, 5, 7]
    points = spark.createDataFrame([("f", 0), ("f", 6), ("f", 99), ("g", 1)], "book string, at long")
    got = corpus.as_of(points, starts.select("book", "page_start", "page"), "book", "at", "page_start", "page")
    assert [(r.book, r.at, r.page) for r in got.orderBy("book", "at").collect()] == [("f", 0, 1), ("f", 6, 2), ("f", 99, 3), ("g", 1, None)]
    assert [r.span_end for r in corpus.spans(starts, "book", ["page"], "page_start").orderBy("page").collect()] == [5, 7, None]


def test_keywords(spark):
    df = spark.createDataFrame([(1, "Boat theft", "boat theft boat with shall"), (2, None, None)], "k long, title string, text string")
    assert rows(corpus.keyword_lists(df, "k", "title", "text", 1), "k") == [(1, "boat", 3, 1)]


def test_keyphrases(spark):
    df = spark.createDataFrame([(1, "minimal deep set of natural numbers"), (2, None), (3, "")], "k long, t string")
    got = {r.phrase: r.score for r in keyphrases.keyphrases(df, "k", "t").collect()}
    assert got == {"minimal deep set": 9.0, "natural numbers": 4.0}


def test_rates(spark):
    df = spark.createDataFrame([(True, True), (False, True), (None, True), (True, False)], "hit boolean, ok boolean")
    r = df.agg(evaluation.masked_rate(F.col("hit"), F.col("ok")).alias("r"), evaluation.masked_rate(F.col("hit"), F.lit(False), 0.0).alias("z")).first()
    assert (r.r, r.z) == (33.33, 0.0)
    e = spark.createDataFrame([(1, 2), (2, 2), (5, 0)], "e int, n int").agg(evaluation.micro_rate(F.col("e"), F.col("n")).alias("micro"), evaluation.mean_rate(F.col("e"), F.col("n")).alias("mean")).first()
    assert (e.micro, e.mean) == (2.0, 0.75)


def test_label_rules(spark):
    kind = "route string, first struct<code:string,section:string>, three array<struct<code:string,section:string>>"
    a, b = ("IPC", "1"), ("IPC", "2")
    df = spark.createDataFrame([("IPC_ONLY", a, [a]), ("IPC_ONLY", a, [b]), ("IPC_ONLY", None, []), ("CLARIFY", None, None), (None, a, [a, a])], kind)
    got = [sorted(r.x) for r in df.select(evaluation.label_violations(F.col("route"), F.col("first"), F.col("three")).alias("x")).collect()]
    assert got == [[], ["first"], ["count"], [], ["distinct", "route"]]


def test_pairs_and_gates(spark):
    df = spark.createDataFrame([("x", "b", 2, 10.0), ("x", "c", 1, 5.0), ("y", "b", 1, 10.0), ("y", "c", 1, 9.0), ("z", "b", 1, 1.0)], "k string, arm string, e int, t double")
    wide = evaluation.paired(df, "k", "arm", "b", "c", "e", "t")
    assert [r.complete for r in wide.orderBy("k").collect()] == [True, True, False]
    gate = evaluation.regression_gate(wide, "e", "t").first()
    assert (gate.pairs, gate.regressions, gate.accepted) == (2, 0, True)
    assert evaluation.gain_gate(wide, "e", "t").first().accepted
    assert not evaluation.regression_gate(wide.limit(0), "e", "t").first().accepted


def test_completeness_and_diffs(spark):
    e, r = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b", True), ("c", False)], "k string, bad boolean")
    assert rows(evaluation.completeness(e, r, "k", F.col("bad")), "expected") == [(2, 1, 1, 1, False)]
    was, now = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, d string"), spark.createDataFrame([("b", "3"), ("c", "4")], "k string, d string")
    assert rows(evaluation.snapshot_diff(was, now, "k", "d"), "k") == [("a", "removed"), ("b", "changed"), ("c", "new")]
    assert rows(evaluation.one_to_one(was, now, "k"), "k") == [("a", "left_only"), ("c", "right_only")]


def test_seal_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", None)], "x string, y string").select(evaluation.seal("x", "y").alias("s")).collect()
    assert df[0].s == df[2].s != df[1].s


def test_reserves(spark):
    df = spark.createDataFrame([("s", 1, "a", True), ("s", 2, "a", True), ("s", 3, "b", None), ("s", 4, "c", True), ("s", 5, "d", True)], "g string, n int, id string, ok boolean")
    assert [r.choice for r in evaluation.reserves(df, "g", ["n"], "id", F.col("ok"), 2).orderBy("n").collect()] == ["chosen", "repeated", "ineligible", "chosen", "reserve"]


def test_gaps(spark):
    df = spark.createDataFrame([("a", 2, 4), ("a", 3, 8), ("a", 5, 6), ("b", 0, 10)], "g string, s int, e int")
    assert rows(intervals.gaps(df, "g", "s", "e", F.lit(0), F.lit(10)), "g", "gap_start") == [("a", 0, 2), ("a", 8, 10)]
    assert intervals.gaps(df.limit(0), "g", "s", "e", F.lit(0), F.lit(10)).count() == 0


def test_event_pairs(spark):
    t = [datetime.datetime(2024, 1, 1, 0, m) for m in range(6)]
    df = spark.createDataFrame([(1, t[0], 1, "o"), (1, t[1], 2, "o"), (1, t[2], 3, "c"), (1, t[3], 4, "c"), (2, t[4], 5, "c"), (2, t[5], 6, None)], "u int, at timestamp, id int, kind string")
    assert rows(intervals.pairs(df, "u", "at", "id", "kind", "o", "c"), "u") == [(1, t[1], t[2])]


def test_order_checks(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("b", 0, 5), ("b", 6, 7)], "g string, s int, e int")
    assert [(r.g, r.contiguous) for r in intervals.contiguous(df, "g", "s", "e").orderBy("g").collect()] == [("a", True), ("b", False)]
    assert [r.increasing for r in intervals.increasing(df, "g", ["s"], "e").orderBy("g").collect()] == [True, True]
    assert intervals.fill_up_to(df.where("g = 'a'"), "g", ["s"], "e", 5.0).count() == 1
    faults = spark.createDataFrame([(1.0, False), (9.0, False), (float("nan"), False), (None, False), (-1.0, True)], "t double, e boolean").select(intervals.timing_fault(F.col("t"), F.col("e"), 5.0).alias("f")).collect()
    assert [r.f for r in faults] == [None, "elapsed-budget-exceeded", "invalid-timing", "invalid-timing", "worker-error"]


def test_review(spark):
    df = spark.createDataFrame([(1, "low", 0.2), (1, "LOW", 0.1), (1, "n1", 0.7), (1, "fine", 0.9)], "k int, w string, p double")
    assert rows(review.doubtful_words(df, "k", "w", "p"), "rank") == [(1, "low", 0.1, 1), (1, "n1", 0.7, 2)]
    v = spark.createDataFrame([([1.0, float("nan"), 5.0, 5.0],)], "v array<double>").select(review.top_indices(F.col("v"), 2).alias("t"), review.top_indices(F.col("v"), 2, (2,)).alias("u")).first()
    assert (v.t, v.u) == ([2, 3], [3, 0])
    c = spark.createDataFrame([([("abc", 0.5), ("x", 2.0), (None, 0.1)],)], "v array<struct<w:string,p:double>>").select(review.clean_confidences(F.col("v"), 5, 2).alias("c")).first()
    assert [tuple(x) for x in c.c] == [("ab", 0.5)]


def test_once_per_value(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k int, t string")
    assert rows(analysis.once_per_value(df, "t", "u", F.upper("t")), "k") == [(1, "a", "A"), (2, "a", "A"), (3, None, None)]
