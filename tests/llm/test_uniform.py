import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import uniform as U


def slowly(text):
    """The uniform form by string functions, character by character."""
    return unicodedata.normalize("NFC", "".join(U._plain(c) for c in text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FFF, exclude_categories=("Cs", "Cn")), st.sampled_from("aeió̧̈োೋ가각ｶﾞﬁ　")), max_size=24))
def test_fold_equals_normalisation(text):
    assert U.fold_text(text)[0] == slowly(text)


def test_places_point_into_the_text():
    text = "ａ​b ﬁе́"
    out, place = U.fold_text(text)
    assert out == "ab fié"
    assert [text[p] for p in place] == ["ａ", "b", " ", "ﬁ", "ﬁ", "е"]


def test_what_stays_different():
    forms = [U.fold_text(t)[0] for t in ("a b", "a  b", "A b", "a\nb", "1", "১", "a-b", "ab")]
    assert len(set(forms)) == len(forms)


def test_many_marks():
    text = "a" + "̧́" * 3000 + "b" * 50_000
    assert U.fold_text(text)[0] == slowly(text)


def test_columns(spark):
    df = spark.createDataFrame([(1, "Ｔheft", 7), (2, None, 8), (3, "", 9), (4, "x" * 100_000, 1)], "row_id long, text string, uniform_text int")
    got = {r.row_id: r.uniform_text for r in U.uniform(df, "text", "row_id").collect()}
    assert got == {1: "Theft", 2: None, 3: "", 4: "x" * 100_000}
    assert U.uniform(df.limit(0), "text", "row_id").count() == 0


def test_pairs_and_classes(spark):
    rows = [(1, "Theft"), (2, "Тheft"), (3, "Theft"), (4, "theft"), (5, None), (6, ""), (7, "Ｔheft"), (8, "​")]
    df = spark.createDataFrame(rows, "row_id long, form string")
    assert {tuple(r) for r in U.differing_pairs(df, "row_id", "form").collect()} == {(1, 2), (2, 3), (1, 7), (3, 7), (2, 7)}
    assert {(r.row_id, r.class_id) for r in U.classes(df, "row_id", "form").collect()} == {(1, 1), (2, 1), (3, 1), (7, 1), (4, 4), (8, 8)}
    assert U.differing_pairs(df.limit(0), "row_id", "form").count() == 0


def test_letters_of_other_blocks():
    assert [U.fold_text(t)[0] for t in ("𝐭𝐡𝐞𝐟𝐭", "ɑct", "Օne", "ᎪᏟ")] == ["theft", "act", "One", "AC"]
