import itertools
import random

import numpy as np
import pytest

from lexloom.llm import sentences as S
from lexloom.llm.queries import _sentence_tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tagger(spark):
    return S.train([(df, "row_id", text) for _, df, text in _sentence_tables(spark, SF)])


@pytest.mark.parametrize(
    "parts",
    [
        ["The complaint was received at 9.30 a.m. ", "According to Dr. A. F. Pharanks, Rs. 4,980 was paid. ", "No. 5 was open."],
        ['A witness shouted, "Leave him alone! He is bleeding." and called a passenger. ', "The scheme paid 3.4 per cent for 10 weeks and then stopped.", "The lock was cut ... and a net was gone. ", "Was it returned?"],
        ["लगभग 6.5 कि.मी. दूर मेले के पास सिलाई मशीन मिला। ", "वह 14.2 घंटे तक बेहोश रहा॥ ", 'गवाह ने कहा, "रुको! उसे मत मारो।" और पुलिस को बुलाया।'],
        ["تاجر نے جھوٹ بول کر پیسے ٹھگ لیے۔ ", "علاج پر 8,600 روپے خرچ ہوئے۔"],
        ["彼は偽の領収書53番を見せて6575円を受け取りました。", "目撃者は「やめろ！もう殴るな。」と叫びました。"],
        ["เขาใช้ไม้ตีศีรษะแล้ววิ่งหนีไป ", "ผู้บาดเจ็บหมดสติอยู่ 12.2 ชั่วโมง ", "เขาแสดงใบเสร็จปลอมเลขที่ 396 แล้วรับเงิน 3,500 บาท"],
        ["105. Reckless transport.—(1) Whoever— (a) lends; or (b) keeps it, goes to prison: Provided that it is so. ", "Provided further that it is not. ", "Explanation.—A boat is kept. ", "(2) A person shall pay. ", "[Subs. by G.N. 11-11, w.e.f. 1.7.1953.]"],
    ],
)
def test_sentences(tagger, parts):
    want = [0, *itertools.accumulate(len(p) for p in parts[:-1])]
    assert tagger.starts("".join(parts)) == want


def test_missing_marks_at_line_ends(tagger):
    text = "The scheme paid 3.4 per cent for 10 weeks and then stopped\nStatements of the driver and the clerk differ on\nthe time."
    assert tagger.starts(text) == [0, text.index("Statements")]


def test_viterbi_is_the_best_path():
    scores, pairs = [1.0, -0.5, 0.7, -2.0], [[0.1, -0.4], [0.6, -1.0]]
    value = lambda tags: sum(s for s, t in zip(scores, tags) if t) + sum(pairs[a][b] for a, b in zip((1, *tags), tags))
    best = max(itertools.product((0, 1), repeat=4), key=value)
    assert S.viterbi(scores, pairs) == [bool(t) for t in best]
    assert S.viterbi([], pairs) == []


def test_pruned_lattice_is_the_whole_one():
    """Places left out change no best path, whatever the scores."""
    rng = random.Random(3)
    for _ in range(2000):
        marked, plain = rng.randint(0, 6), rng.randint(0, 8)
        every = rng.sample(range(1, 40), marked + plain)
        at, places = sorted(every[:marked]), sorted(every[marked:])
        scores, own = [rng.uniform(-2, 2) for _ in at], np.array([rng.uniform(-3, 1.5) for _ in places])
        pairs = [[rng.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
        score = dict(zip(at, scores)) | dict(zip(places, own))
        order = sorted(score)
        whole = {p for p, tag in zip(order, S.viterbi([score[p] for p in order], pairs)) if tag}
        some, where, gaps, _ = S.merged(scores, at, own, np.array(places, np.int64), pairs)
        assert {p for p, tag in zip(where, S.viterbi(some, pairs, gaps)) if tag} == whole


def test_every_character_of_a_script_without_spaces_is_in_the_lattice(tagger):
    text = "彼は偽の領収書53番を見せて6575円を受け取りました"
    chain = S.Chain(text)
    assert {k for k in range(1, len(text)) if not text[k].isdigit() and not text[k - 1].isdigit()} <= set(chain.plain)


def test_unmarked_chinese_is_told_apart():
    """Sentences that follow each other without mark or space, after training on marked ones."""
    rng = random.Random(5)
    who, what, end = ["店主", "証人", "警官"], ["鍵を壊して", "棒で殴って", "財布を取って"], ["逃げました", "報告しました", "帰りました"]
    made = lambda: rng.choice(who) + "は" + rng.choice(what) + rng.choice(end)
    texts = ["".join(made() + "。" for _ in range(3)) for _ in range(300)]
    counts = S.Counts([("h", k, 9, 0) for k in {h for t in texts for h in S.head_keys(t)}])
    own = S._learn(texts, counts)
    parts = [made() for _ in range(3)]
    assert own.starts("".join(parts)) == [0, len(parts[0]), len(parts[0] + parts[1])]


def test_labels_come_from_counts_not_from_the_list(spark, monkeypatch):
    monkeypatch.setattr(S, "BEFORE", frozenset())
    monkeypatch.setattr(S, "EITHER", frozenset())
    texts = [f"Paid Qx. {k} to the clerk there. Qx. {k + 1} was left. The clerk saw it. A boat was near." for k in range(40)]
    texts += ["The clerk left it near the boat there by noon. A boat is there now."] * 90
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "row_id long, text string")
    counts = S.counted([(df, "row_id", "text")], texts)
    chain = S.Chain(texts[0])
    where = [at for at, y in zip(chain.at, S.certain(chain, counts)) if y]
    assert [texts[0][a : a + 5] for a in where] == ["Qx. 1", "The c", "A boa"]


def test_quotations_of_any_length_divide_nothing(tagger):
    speech = " ".join(["Leave him alone! He is bleeding."] * 30)
    text = f'A witness shouted, "{speech}" and called a passenger. The ferry left.'
    assert tagger.starts(text) == [0, text.index("The ferry")]


def test_table(spark, tagger):
    rows = [(1, " One is here. Two is there."), (1, " One is here. Two is there."), (2, None), (3, ""), (4, " \n "), (5, "Long. " * 30_000)]
    df = spark.createDataFrame(rows, "row_id long, text string").selectExpr("*", "1 as start_char", "'x' as t")
    got = S.sentences(df, "row_id", "text", tagger).collect()
    assert sorted((r.start_char, r.end_char) for r in got if r.row_id == 1) == [(1, 13), (1, 13), (14, 27), (14, 27)]
    assert {r.row_id for r in got} == {1, 5}
    assert S.sentences(df.limit(0), "row_id", "text", tagger).count() == 0


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "row_id long, text string")
    assert S.train([(empty, "row_id", "text")]).starts("a. B") == [0]
