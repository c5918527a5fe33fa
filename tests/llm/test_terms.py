from collections import defaultdict

from lexloom.llm import terms as T


def brute(rows):
    n, ids = defaultdict(int), defaultdict(set)
    every = {r[0] for r in rows if r[0] is not None}
    for key, values, text in rows:
        if key is not None:
            for term in T._row_terms(values, text):
                n[term] += 1
                ids[term].add(key)
    mark = lambda k: "rare" if k < T.RARE else "common" if k > T.COMMON * len(every) else None
    return {(("k", "t")[f], term, n[f, term], len(ids[f, term]), mark(len(ids[f, term]))) for f, term in n}


def counted(spark, rows):
    df = spark.createDataFrame(rows, "id string, v array<string>, t string").selectExpr("*", "1 as term", "2 as field")
    return {tuple(r) for r in T.term_counts(df, "id", "v", "t", ("k", "t")).collect()}


def test_against_brute_force(spark):
    rows = [(f"r{k % 40}", ["A ", " a", "", None, f"k{k % 9}"], f"the Boat{chr(97 + k % 20)} the छोटा2b İ éa") for k in range(120)]
    rows += [("r1", None, None), (None, ["lost"], "lost"), ("r2", [], ""), ("r3", ["x"], "the " * 20_000)]
    assert counted(spark, rows) == brute(rows)


def test_light_and_heavy_agree(spark, monkeypatch):
    rows = [(f"r{k % 7}", None, f"common w{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10]}") for k in range(90)]
    assert counted(spark, rows) == brute(rows)
    assert counted(spark, [("one", None, "same same")] * 50) == {("t", "same", 100, 1, "rare")}


def test_summary_is_bounded(monkeypatch):
    from collections import Counter

    monkeypatch.setattr(T, "SUMMARY", 3)
    kept = T._lowered(Counter({"a": 9, "b": 5, "c": 4, "d": 2, "e": 1}))
    assert kept == Counter({"a": 7, "b": 3, "c": 2})


def test_empty(spark):
    assert T.term_counts(spark.createDataFrame([], "id string, v array<string>, t string"), "id", "v", "t").count() == 0
