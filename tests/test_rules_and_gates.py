"""Profiles, cues, gates and checks on small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lexloom.functions import checks as C
from lexloom.functions import grammar as G
from lexloom.functions import profiles as P
from lexloom.functions import text as T
from lexloom.operators import evaluation, intervals
from lexloom.plans import ranking


@pytest.mark.parametrize(
    "language, word, stem",
    [("en", "takings", "taking"), ("en", "was", "was"), ("hi", "लड़कियों", "लड़क"), ("hi", "नहीं", "नहीं"), ("mr", "चोरीचा", "चोरीच"), ("mr", "घरांमध्ये", "घर"), ("gu", "દુકાનમાં", "દુકાન"), ("ur", "دکانوں", "دکان"), ("xx", "word", None)],
)
def test_stems(spark, language, word, stem):
    row = spark.createDataFrame([(word, language)], "w string, l string").select(P.stem(F.col("w"), F.col("l")).alias("s"), P.is_stop(F.col("w"), F.col("l")).alias("stop")).first()
    assert row.s == stem and (row.stop is None) == (language == "xx")


def test_guessed_languages(spark):
    rows = [("ચોરી", "gu"), ("मी घरी नाही आहे", "mr"), ("वह घर में नहीं है", "hi"), ("चोरी", None), ("theft", None), (None, None), ("", None)]
    got = spark.createDataFrame(rows, "t string, want string").select(P.guessed_language(F.col("t")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


@pytest.mark.parametrize(
    "text, cues",
    [
        ("He took my mobile phone without his consent.", {"theft"}), ("Stolen.", {"theft"}), ("He kept the phone with him without permission.", {"retained theft", "theft", "retention"}), ("a theft", {"theft"}),
        ("He intentionally caused the death of a man.", {"death"}), ("He did not intentionally cause the death. He did not kill him.", set()), ("He repeatedly followed her despite her refusal.", {"stalking"}),
        ("He tricked her to give property.", {"cheating"}), ("A grievous and serious injury.", {"grievous hurt", "serious hurt", "hurt"}), ("It hurt.", {"hurt"}), ("", set()), (None, set()),
    ],
)
def test_cues(spark, text, cues):
    own = spark.createDataFrame([(text,)], "t string").select("t", T.vocabulary_hits("t").alias("k"), T.phrase_labels("t").alias("p"))
    assert set(own.select(ranking.cues(F.col("t"), F.col("k"), F.col("p"), F.lit("IPC_ONLY")).alias("c")).first().c) == cues


def test_ranked(spark):
    docs = [(1, "IPC", "378", "Theft", "taking", [], ["bns-303"]), (2, "IPC", "379", "Punishment", "fine", [], []), (3, "BNS", "303", "Theft", "taking", [], ["ipc-378"]), (4, "BNS", "9", "Boats", "nothing", None, None), (5, "IPC", None, None, None, None, None)]
    docs = spark.createDataFrame(docs, "row_id long, code string, section string, title string, text string, keywords array<string>, maps_to array<string>")
    asked = [(1, "theft on 5 July 2020"), (2, "theft on 5 July 2025 under IPC 378"), (3, "theft without a date"), (4, None), (5, "theft continued from 5 July 2020 to 5 July 2025")]
    got = ranking.ranked(spark.createDataFrame(asked, "id long, t string"), "id", "t", docs).orderBy("qid", "rank").collect()
    by = {q: [r.doc for r in got if r.qid == q] for q in (1, 2, 3, 4, 5)}
    assert by[1] == [1, 2] and by[2][0] == 3 and by[3] == [] and by[4] == [] and by[5][:2] == [1, 3]
    assert ranking.ranked(spark.createDataFrame([], "id long, t string"), "id", "t", docs).count() == 0


def test_grounding(spark):
    cited = "array(named_struct('code', 'IPC', 'section', '3', 'exception', cast(null as string)))"
    own = spark.sql(f"select 'under IPC 303' as c, {cited} as d, cast(null as string) as r union all select 'under BNS', {cited}, 'CLARIFY' union all select 'x', cast(array() as array<struct<code:string,section:string,exception:string>>), null")
    got = [r.w for r in own.select(C.grounding_warnings(F.col("c"), F.col("d"), F.col("r"), F.lit(None)).alias("w")).collect()]
    assert got == [[], ["no retrieved section is named", "CLARIFY"], ["nothing was retrieved"]]


def test_gates(spark):
    rows = spark.createDataFrame([(1, 10, 7, 100.0, 110.0, True, False), (2, 5, 4, 100.0, 100.0, True, False), (3, 9, 9, 1.0, 1.0, False, True)], "k int, b_e int, c_e int, b_ms double, c_ms double, complete boolean, bad boolean")
    got = evaluation.study_gate(rows, ["e"], "ms", faults="bad").first()
    assert (got.pairs, got.regressions, got.quality, got.latency, got.safety, got.passed) == (2, 0, True, True, True, True)
    assert not evaluation.study_gate(rows, ["e"], "ms", gain=0.5).first().passed and evaluation.study_gate(rows, ["e"], "ms", gain=0).first().passed
    assert not evaluation.study_gate(rows.limit(0), ["e"], "ms").first().passed
    runs = spark.createDataFrame([(5.0, 100.0, 900.0), (6.0, 100.0, None)], "ms double, elapsed double, wall double")
    assert evaluation.usable(runs.where("wall is not null"), ["ms"], ("wall", "elapsed"), 1, 50.0).first().usable
    assert not evaluation.usable(runs, ["ms"], ("wall", "elapsed"), 2, 50.0).first().usable


def test_label_metrics(spark):
    rows = [("A", ["x", "y"], "A", "x", ["x", "z"]), ("B", None, "CLARIFY", None, None), ("A", ["y"], None, "x", ["y"])]
    got = evaluation.label_metrics(spark.createDataFrame(rows, "r string, f array<string>, l string, one string, three array<string>"), "r", "f", "l", "one", "three").first()
    assert (got.law_accuracy, got.first_accuracy, got.named_first_accuracy, got.all_of_three, got.any_of_three, got.recall_of_three) == (50.0, 66.67, 50.0, 66.67, 100.0, 66.67)


def test_event_faults(spark):
    rows = [(1, "2024-01-02 00:00:00", "a"), (1, "2024-01-03 00:00:00", "a"), (2, "2024-01-02 00:00:00", "z"), (3, "2023-01-02 00:00:00", "a"), (4, None, "a"), (5, "2024-01-02 00:00:00", None)] + [(6, "2024-01-02 00:00:00", "a")] * 4
    df = spark.createDataFrame(rows, "u int, at string, kind string")
    got = {r.u: r.fault for r in intervals.event_faults(df, "u", "at", "kind", ("a",), "2024-01-01 00:00:00", "2024-02-01 00:00:00", 3).collect()}
    assert got == {1: "none", 2: "kind", 3: "outside", 4: "outside", 5: "kind", 6: "too-many"}


def test_quiet_cuts():
    signal = [5.0] * 20
    signal[12:14] = [0.0, 0.0]
    assert G.quiet_cuts(signal, 15, 6, 2, 2) == [14] or G.quiet_cuts(signal, 15, 6, 2, 2)[0] in range(9, 15)
    assert G.quiet_cuts(signal[:10], 15, 6, 2, 2) == [] and G.quiet_cuts([], 15, 6, 2, 2) == []
    assert all(b - a <= 15 for a, b in zip([0, *G.quiet_cuts([1.0] * 100, 15, 6, 2, 2)], G.quiet_cuts([1.0] * 100, 15, 6, 2, 2)))


def test_rescored(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, t string"), spark.createDataFrame([(1, "x"), (2, "z"), (3, None), (4, "w")], "k int, t string")
    assert {r.k: r.status for r in evaluation.rescored(a, b, ["k"], "t").collect()} == {1: "same", 2: "changed", 3: "same", 4: "missing"}
