"""Column expressions and grammars on small literal cases."""


import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import checks as C
from lexloom.functions import dates as D
from lexloom.functions import grammar as G
from lexloom.functions import lexicon as X
from lexloom.functions import numbers as N
from lexloom.functions import text as T


def one(spark, expression, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<int>' if isinstance(v, list) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expression.alias("x")).first().x


@pytest.mark.parametrize("text, expected", [("The theft of 379 and 354D", ["theft", "354d"]), ("a I 12345", ["12345"]), ("", []), (None, []), ("Movable-property!", ["movable", "property"])])
def test_retrieval_tokens(spark, text, expected):
    assert one(spark, T.retrieval_tokens("t"), t=text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("on 5 July 2024", ["2024-07-05"]), ("July 5, 2024", ["2024-07-05"]), ("5/7/2024 and 2024-07-05", ["2024-07-05"]), ("31 February 2024", []), ("2024-02-31", []), ("1 May 1999", []), ("2024-03-01 then 2/2/2023", ["2024-03-01", "2023-02-02"]), (None, []), ("", [])],
)
def test_dates(spark, text, expected):
    assert [x.value for x in one(spark, D.dates("t"), t=text)] == expected


@pytest.mark.parametrize(
    "text, route",
    [
        ("The incident happened on 2024-06-30.", "IPC_ONLY"), ("The incident happened on 2024-07-01.", "BNS_PRIMARY"), ("No date.", "CLARIFY"),
        ("It continued from 2024-06-01 until 2024-08-01.", "MULTI_PERIOD_REVIEW"), (None, "CLARIFY"), ("31 Feb 2024", "CLARIFY"),
        ("Filed on 2024-08-02" + " x" * 60 + " the crime was committed on 2024-05-01", "IPC_ONLY"),
    ],
)
def test_routes(spark, text, route):
    found = D.dates("t")
    assert one(spark, D.period_route(found, D.continuing("t"), D.offence_date("t", found)), t=text) == route


def test_references(spark):
    got = one(spark, T.section_references("t"), t="ipc 302, BNS section 103 and Section 354d; section 302")
    assert [(r.code, r.section) for r in got] == [("IPC", "302"), ("BNS", "103"), (None, "354D"), (None, "302")]


@pytest.mark.parametrize("word, expected", [("walking", "walk"), ("allegedly", "alleg"), ("was", "was"), ("cases", "cas"), ("this", "this"), ("Boats", "boat"), ("sing", "sing"), ("without", "without")])
def test_stem(spark, word, expected):
    assert one(spark, T.stem("w"), w=word) == expected


def test_tokens_keep_marks_and_numbers(spark):
    assert one(spark, T.tokens("t"), t="चोरी हुई, 12.5 don't।") == ["चोरी", "हुई", ",", "12.5", "don't", "।"]
    assert one(spark, T.tokens("t"), t=None) == []


def test_small_text_functions(spark):
    assert one(spark, T.ascii_digits("t"), t="१२ ૩ ٤ ۵ ৬") == "12 3 4 5 6"
    assert one(spark, T.tidy("t"), t=" a​  b c , d ") == "a b c, d"
    assert one(spark, T.acronyms("t"), t="आईपीसी 302, B.N.S. 1") == "IPC 302, BNS. 1"
    assert one(spark, T.derived_title("t"), t="Theft of  movables. Whoever takes") == "Theft of movables"
    assert one(spark, T.derived_title("t"), t="") == "Statutory provision"
    assert one(spark, T.section_base("t"), t="354 D(1)") == "354D"
    assert one(spark, T.section_base("t"), t="x") is None
    assert one(spark, T.script("t"), t="abc चोरी") == "devanagari"
    assert one(spark, T.same_numbers("a", "b"), a="1, २ and 1", b="1 1 2") is True
    assert one(spark, T.phrase_similarity("a", "b"), a="Sanhada", b="Sanhita") == pytest.approx(0.75)
    long = "x" * 700 + " needle " + "y" * 700
    assert one(spark, T.excerpt("t", F.array(F.lit("needle"))), t=long).startswith("...") and "needle" in one(spark, T.excerpt("t", F.array(F.lit("needle"))), t=long)


def test_checks(spark):
    assert one(spark, C.english_like(F.col("t")), t="theft of a bag") is True
    assert one(spark, C.expected_script(F.col("t"), F.lit("gu")), t="ચોરી") is True
    assert one(spark, C.invented_numbers(F.col("a"), F.col("b")), a="5 and 6", b="6 and 7") == ["7"]
    assert one(spark, C.role_changed(F.col("a"), F.col("b"), F.lit("hi")), a="आरोपी", b="the accused and the defendant") is True
    assert one(spark, C.bounded_exp(F.col("v")), v=-99.0) == 0.0
    assert one(spark, C.rising(F.col("v")), v=[1, 2, 2]) is False and one(spark, C.rising(F.col("v")), v=[1]) is True
    assert one(spark, C.stripped_markers(F.col("v"), (9, 8)), v=[1, 9, 2, 9, 8]) == [1, 9, 2]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("section three seventy nine", "section 379"), ("IPC four twenty", "IPC 420"), ("section three oh two", "section 302"), ("section number three fifteen", "section number 315"), ("sec three two three", "sec 323"),
        ("BNS three hundred and three", "BNS 303"), ("article twenty-one", "article 21"), ("section zero", "section zero"), ("five lakh twenty thousand rupees", "520,000 rupees"), ("two crore and five rupees", "20,000,005 rupees"),
        ("nine hundred ninety nine rupees", "999 rupees"), ("hundred rupees", "hundred rupees"), ("no one may enter", "no one may enter"), ("twenty first of June two thousand twenty four", "21 June 2024"),
        ("the fifth of July, twenty twenty three", "5 July 2023"), ("on thirty first May", "on thirty first May"), ("on thirty first May nineteen ninety nine", "on 31 May 1999"), ("thirty second of June", "thirty second of June"),
        ("on 5 June 2024", "on 5 June 2024"), ("three hundred and seventy nine boats", "three hundred and seventy nine boats"), ("march two thousand and five", "March 2005"), ("march on", "march on"), ("", ""),
    ],
)
def test_written_numbers(text, expected):
    assert N.written_numbers(text)[0] == expected


def test_number_log():
    assert N.written_numbers("Section four twenty, five hundred rupees")[1] == [("section", "four twenty", "420"), ("amount", "five hundred", "500")]


@pytest.mark.parametrize("text, expected", [("Rs. 5.50 is due. Pay.", ["Rs. 5.50 is due.", "Pay."]), ("हुआ। ठीक", ["हुआ।", "ठीक"]), ("", []), ('He said "no!" Then left', ['He said "no!"', "Then left"])])
def test_sentences(text, expected):
    assert G.sentence_list(text) == expected


def test_entities():
    got = {(k, v) for k, _, v, _, _ in G.entity_list("On 5 July 2024 under IPC section 379, theft of Rs. 5,000; धारा ३०२")}
    assert got == {("DATE", "2024-07-05"), ("SECTION", "IPC 379"), ("OFFENCE", "theft"), ("MONEY", "5000.0"), ("SECTION", "302")}


@pytest.mark.parametrize(
    "heard, expected",
    [
        ("grievious hurt under the Bharatiya Nyay Sanhada", "grievous hurt under the Bharatiya Nyaya Sanhita"), ("a grave hurdle", "a grave hurdle"), ("the Indian Peenal Code", "the Indian Penal Code"), ("extorsion of money", "extortion of money"),
        ("a movable property", "a movable property"), ("mov able property kept", "movable property kept"), ("a moveable, property", "a moveable, property"), ("", ""), ("criminal breech of trust", "criminal breach of trust"), ("without concent", "without consent"),
    ],
)
def test_lexicon(heard, expected):
    assert X.lexicon_repair(heard)[0] == expected


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12))
def test_bit_parallel_edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    assert X.edits(a, b) == row[-1]


def test_word_edits(spark):
    rows = spark.createDataFrame([("one two three", "two"), ("a b c", "a x c d"), ("", "x"), (None, "a"), ("É! a-b", "é a b")], "r string, h string")
    got = rows.select(T.word_edits(T.speech_words("r"), T.speech_words("h")).alias("n")).collect()
    assert [r.n for r in got] == [2, 2, 1, 1, 0]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab c.\n(1)2-5/IPC", max_size=60))
def test_protected_parts_make_up_the_text(text):
    assert "".join(p for p, _ in G.protected_parts(text)) == text
    hidden, spans = G.masked(text)
    assert G.unmasked(hidden, spans) == text


def test_udfs_take_nulls(spark):
    from lexloom.session import ship

    ship(spark)
    rows = spark.createDataFrame([(None,), ("",), ("section three oh two",)], "t string")
    got = rows.select(G.numbers_udf()("t").alias("n"), G.sentences_udf()("t").alias("s"), G.entities_udf()("t").alias("e"), G.normal_udf("NFKC")("t").alias("c")).collect()
    assert [r.n.text for r in got] == [None, "", "section 302"]
    assert [r.s for r in got] == [[], [], ["section three oh two"]]
    assert [r.c for r in got] == [None, "", "section three oh two"]


def test_speech_words(spark):
    words = lambda t, v: one(spark, T.speech_words(F.col("t"), v), t=t)
    assert words("É! a-b", "public") == ["é", "a", "b"] and words("a-b", "study") == ["ab"] and words("a-b_c", "legacy") == ["ab_c"] and words(" ", "report") == []
