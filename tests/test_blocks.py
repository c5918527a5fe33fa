"""Retrieval in blocks: whole results whatever the blocks are, and no shuffle of pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lexloom.plans import blocks, ranking

DOC = "row_id long, code string, section string, title string, text string, keywords array<string>, maps_to array<string>"
RARE = [f"w{k}x" for k in range(60)]


def _docs(n: int, rng: random.Random):
    words = lambda k: " ".join(rng.choice(RARE) for _ in range(k))
    return [(k, ("IPC", "BNS", "CRPC", None)[min(rng.randrange(9) // 4 + (rng.random() < 0.1), 3)], str(300 + k % 90), words(2), "common usual " + words(5), [words(1)], [f"bns-{k % 70}-r1"] if k % 3 else None) for k in range(n)]


def _queries(n: int, rng: random.Random):
    dates = ("5 July 2019", "5 July 2025", "5 July 2020 to 5 July 2025", "a day")
    return [(k, f"It continued from {rng.choice(dates)} the common usual {rng.choice(RARE)} {rng.choice(RARE)} {rng.choice(('', 'theft of property', 'under section 303 of the BNS', 'under section 378 IPC'))}") for k in range(n)]


@pytest.mark.parametrize("small, large", [(40, 40), (1 << 13, 1 << 15)])
def test_blocks_give_the_whole_sum(spark, monkeypatch, small, large):
    rng = random.Random(5)
    docs, asked = _docs(300, rng), _queries(60, rng)
    monkeypatch.setattr(blocks, "SMALL", small)
    monkeypatch.setattr(blocks, "LARGE", large)
    frame, queries = spark.createDataFrame(docs, DOC), spark.createDataFrame(asked, "id long, t string")
    got = {(r.qid, r["rank"]): (r.doc, r.score) for r in ranking.ranked(queries, "id", "t", frame).collect()}
    rules = [(r.cue, r.family, r.order, r.code, r.section, r.route, r.points, r.cited_off) for r in ranking.rule_table(spark).collect()]
    bag = lambda *texts: {w for t in texts for w in (t or "").lower().split() if not w.isdigit()}
    bodies, heads = [bag(d[3], d[4], *d[5]) for d in docs], [bag(d[3]) for d in docs]
    idf = {w: math.log((len(docs) + 1) / (sum(w in b for b in bodies) + 1)) + 1 for w in set().union(*bodies)}
    want = {}
    for q in ranking.facts(queries, "id", "t").where("route <> 'CLARIFY'").collect():
        own, rows = bag(q.t, *q.keywords, *q.phrases) & set(idf), []
        for d, body, head in zip(docs, bodies, heads):
            if d[1] not in q.allowed:
                continue
            score = sum(idf[w] + 8 * (w in head) for w in own & body)
            score += 50 * any(r.section == d[2] and r.code in (None, d[1]) for r in q.refs)
            score += 30 * any(r.code not in (None, d[1]) and f"{r.code}-{r.section}".lower() in [m.split("-r")[0] for m in d[6] or ()] and (q.route == "MULTI_PERIOD_REVIEW" or d[1] == q.primary) for r in q.refs)
            met = [r for r in rules if r[0] in q.cues and r[5] == q.route and r[3:5] == (d[1], d[2]) and not (r[7] and q.refs)]
            score += sum(min((r for r in met if r[1] == family), key=lambda r: r[2])[6] for family in {r[1] for r in met})
            if score:
                cited = d[1] == q.primary and any((r.code, r.section) == (d[1], d[2]) for r in q.refs)
                rows.append((d, not cited, q.route == "BNS_PRIMARY" and d[1] != "BNS", -round(score + (1 if q.route == "MULTI_PERIOD_REVIEW" else 2 * (d[1] == q.primary)), 3), d[0]))
        rows.sort(key=lambda r: r[1:])
        if q.route == "MULTI_PERIOD_REVIEW":
            leads = [next((r for r in rows if r[0][1] == code), None) for code in q.allowed]
            rows = [r for r in leads if r] + [r for r in rows if r not in leads]
        want |= {(q.qid, k + 1): (r[4], -r[3]) for k, r in enumerate(rows[:3])}
    assert {r.route for r in ranking.facts(queries, "id", "t").collect()} == set(ranking.ALLOWED)
    assert got == want


def test_no_pair_is_shuffled(spark):
    """Every query meets every document: 700,000 pairs, of which only the best may leave a task."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(d[0], "IPC", *d[2:]) for d in _docs(1000, rng)], DOC)
    queries = spark.createDataFrame([(k, f"On 5 July 2019 the common usual {rng.choice(RARE)}") for k in range(700)], "id long, t string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert ranking.ranked(queries, "id", "t", docs).count() == 2100
    assert written() - before < 3 << 20


@pytest.mark.parametrize("n", [4, 70, 192, 193, 1000])
def test_bound_is_at_most_the_third_sum(n):
    rng = random.Random(n)
    for _ in range(50):
        sums = np.array([rng.randrange(6) * rng.random() for _ in range(n)])
        assert 0 <= blocks._bound(sums, 3) <= sorted(sums)[-3]


def test_queries_are_shuffled_once_whatever_the_blocks(spark, monkeypatch):
    """Twenty blocks: neither the queries nor their best documents may be shuffled once a block."""
    monkeypatch.setattr(blocks, "LARGE", 50)
    monkeypatch.setattr(blocks, "FEW", 70, raising=False)  # ten shares, so that a task reads many blocks
    monkeypatch.setattr(blocks, "HELD", 500, raising=False)
    rng = random.Random(7)
    docs = spark.createDataFrame([(d[0], "IPC", *d[2:]) for d in _docs(1000, rng)], DOC)
    queries = spark.createDataFrame([(k, f"On 5 July 2019 the common usual {rng.choice(RARE)} " + " ".join(f"{rng.random()}x" for _ in range(40))) for k in range(700)], "id long, t string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = ranking.ranked(queries, "id", "t", docs).collect()
    spent = written() - before
    monkeypatch.setattr(blocks, "LARGE", 1 << 15)
    assert sorted(got) == sorted(ranking.ranked(queries, "id", "t", docs).collect()) and len(got) == 2100
    assert spent < 3 << 20


def test_routed_facts_are_the_facts_of_cases_with_a_route(spark):
    queries = spark.createDataFrame([(1, "theft on 05.07.2019, 2019-7-5 and July 4, 2019 under section 378 IPC"), (2, "theft"), (3, "12 March 2025 5 July 2025x 31-02-2025"), (4, None)], "id long, t string")
    every = ranking.facts(queries, "id", "t").where("route <> 'CLARIFY'").orderBy("qid").collect()
    assert [r.qid for r in every] == [1, 3] and ranking.facts(queries, "id", "t", routed=True).orderBy("qid").collect() == every
