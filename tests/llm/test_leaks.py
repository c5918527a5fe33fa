import random

from lexloom.llm import leaks as L


def brute(docs, items, least):
    runs = lambda t: {tuple(w[k : k + least]) for w in [L.words(t or "")] for k in range(len(w) - least + 1)}
    return {(d, i) for d, t in docs for i, u in items if runs(t) & runs(u)}


def found(spark, docs, items, least=12):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as tiles", "'x' as item_key")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.tiles, r.coverage) for r in L.leaks(d, "doc_id", "text", i, "item_id", "text", least).collect()}


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(12)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(k, text(rng.randint(0, 60))) for k in range(60)] + [(98, None), (99, "")]
    items = [(k, text(rng.randint(0, 20))) for k in range(20)] + [(77, None), (78, "")]
    assert set(found(spark, docs, items, 3)) == brute(docs, items, 3)


def test_reordered_passage_is_covered(spark):
    words = [f"w{k}" for k in range(30)]
    got = found(spark, [(1, " ".join(words[15:] + ["between"] + words[:15]))], [(5, " ".join(words))])
    assert got == {(1, 5): (2, 1.0)}


def test_separators_and_case(spark):
    words = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mü"
    assert found(spark, [(1, "x " + words.upper().replace(" ", "-\n") + ".")], [(5, words)]) == {(1, 5): (1, 1.0)}
    assert found(spark, [(1, words.replace("eta ", "e​ta "))], [(5, words)]) == {}


def test_repeats_and_empty(spark):
    text = " ".join(f"w{k}" for k in range(12))
    items = [(k, text) for k in range(5)]
    assert set(found(spark, [(1, text), (1, text), (2, "no")], items)) == {(1, k) for k in range(5)}
    assert found(spark, [(1, text)], [(7, None)]) == {}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.leaks(empty, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").count() == 0


def test_both_ways_agree(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    docs = [(k % 45, text(rng.randint(0, 60))) for k in range(50)]
    items = [(k % 28, text(rng.randint(0, 30))) for k in range(30)]
    sent = found(spark, docs, items, 5)
    monkeypatch.setattr(L, "CHUNK", 3)
    assert found(spark, docs, items, 5) == sent
    monkeypatch.setattr(L, "BLOCK_BYTES", 1)
    assert found(spark, docs, items, 5) == sent and set(sent) == brute(docs, items, 5)


def test_coverage_decides():
    item = [f"w{k}" for k in range(48)]
    block = L.Items([(5, " ".join(item))], 12)
    shuffled = " x ".join(" ".join(item[a : a + 12]) for a in (24, 0, 12))
    assert block.leaked(shuffled, 0.75) == [(5, 3, 0.75)] and block.leaked(shuffled, 0.76) == []
    assert block.leaked(" ".join(item[:12]), 0.0) == [(5, 1, 0.25)] and block.leaked(" ".join(item[:11]), 0.0) == []


def test_greedy_tiling_by_definition():
    """Against repeated search for the longest unmarked match."""
    rng = random.Random(6)
    for _ in range(150):
        a, b, least = [rng.choice("abc") for _ in range(rng.randint(3, 25))], [rng.choice("abc") for _ in range(rng.randint(3, 18))], 3
        used_a, used_b, tiles = set(), set(), []
        while True:
            best = (0, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                        n += 1
                    if (-n, i, j) < (-best[0], best[1], best[2]):
                        best = (n, i, j)
            if best[0] < least:
                break
            used_a |= set(range(best[1], best[1] + best[0]))
            used_b |= set(range(best[2], best[2] + best[0]))
            tiles.append(best[0])
        got = L.Items([(1, " ".join(b))], least).tiles(" ".join(a))
        assert got == ([(0, len(tiles), sum(tiles))] if tiles else [])


def test_hot_seed():
    """A preamble that thousands of items share costs no loop over them."""
    import time

    preamble = " ".join(f"p{k}" for k in range(15))
    block = L.Items([(k, f"{preamble} own{k} end") for k in range(8000)], 12)
    began = time.time()
    assert len(block.leaked(preamble, 0.0)) == 8000 and time.time() - began < 2


def test_very_long_text(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    assert set(found(spark, [(1, "z " * 300_000 + passage + " z" * 1000)], [(5, passage)])) == {(1, 5)}
