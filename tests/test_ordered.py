"""Values from other rows of a group: the split way against the window, on a group that holds a third of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import corpus, intervals, ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [("hot" if k % 3 == 0 else None if k % 7 == 0 else f"g{k % 11}", rng.randint(0, 50), k, rng.choice([None, rng.randint(0, 9)])) for k in range(900)]
    return spark.createDataFrame(data, "g string, at int, id int, v int").repartition(4).cache()


@pytest.mark.parametrize(
    "step",
    [
        lambda d: ordered.running(d, ["g"], ["at", "id"], "v", "x"), lambda d: ordered.running(d, ["g"], ["at", "id"], "v", "x", F.max), lambda d: ordered.neighbour(d, ["g"], ["at", "id"], ["v", "id"], "x"),
        lambda d: ordered.neighbour(d, ["g"], ["at", "id"], ["v", "id"], "x", following=True), lambda d: ordered.last_known(d, ["g"], ["at", "id"], "v", "x"),
        lambda d: intervals.pairs(d, "g", "at", "id", "v", 1, 2), lambda d: intervals.gaps(d.withColumn("e", F.col("at") + 1), "g", "at", "e", F.lit(0), F.lit(60)),
        lambda d: corpus.spans(d, "g", ["at", "id"], "id"), lambda d: intervals.fill_up_to(d, "g", ["at", "id"], "at", 300.0),
    ],
)
def test_both_ways_agree(rows, step, monkeypatch):
    want = sorted(map(repr, step(rows).collect()))
    monkeypatch.setattr(ordered, "HOT_ROWS", 10)
    assert sorted(map(repr, step(rows).collect())) == want and want


def test_empty(spark, rows):
    assert ordered.running(rows.limit(0), ["g"], ["at"], "v", "x").count() == 0 and not ordered.hot(rows.limit(0), ["g"])
