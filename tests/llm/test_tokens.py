import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import tokens as T

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RANKS = T.read_ranks(PATH)
OURS = T.Encoder(RANKS)
THEIRS = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab'st \n\t<|endoftext|>чोর한", max_size=60)))
def test_equals_the_library(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)


def test_long_runs():
    for text in ("a" * 5000, "चोरी" * 2000, "!" * 3000, " " * 4000, "投诉编号" * 800):
        assert OURS.encode(text) == THEIRS.encode_ordinary(text)


def test_cuts_are_certain():
    for text in ("投诉编号已经登记", "ಕಾವಲುಗಾರನ", "a1-b2/c3"):
        raw = text.encode()
        for at in OURS.cuts(raw):
            assert not any(raw[at - 1 : at + 1] in token for token in RANKS)


def test_store_stays_bounded(monkeypatch):
    monkeypatch.setattr(T, "STORE", 4)
    e = T.Encoder(RANKS)
    for k in range(50):
        e.encode(f"word{k}x")
    assert len(e.store) <= 4


def test_column(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|>", [9]), (1, "a <|endoftext|>", None), (2, None, None), (3, "", None)], "doc_id long, text string, ids array<int>")
    got = sorted((r.doc_id, r.ids) for r in T.encode(df, "doc_id", "text").collect())
    same = THEIRS.encode_ordinary("a <|endoftext|>")
    assert got == [(1, same), (1, same), (2, []), (3, [])]
    assert T.encode(df.limit(0), "doc_id", "text").count() == 0
