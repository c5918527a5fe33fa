import numpy as np
import pytest

from lexloom.llm import reading as R
from lexloom.llm.base import table

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def grader(spark):
    return R.train(table(spark, SF, "documents"), "doc_id", "text", "source", table(spark, SF, "reading_labels"), "doc_id", "band")


def test_trees_fit_steps():
    x = np.random.default_rng(0).random((400, 3))
    y = (x[:, 1] > 0.5) * 2.0 + (x[:, 2] > 0.3)
    model = R.Boosted().fit(x[:300], y[:300])
    assert np.abs(model.predict(x[300:]) - y[300:]).mean() < 0.15


def test_cut_lies_in_the_widest_gap():
    assert R.Grader.best_cut(np.array([0.1, 0.2, 0.9, 1.0]), np.array([0, 0, 1, 1.0]), 0) == pytest.approx(0.55)


def test_cross_validation(grader):
    assert grader.accuracy > 0.93  # a few labels are wrong


def test_levels(spark, grader):
    easy = "The man ran home. He had a red bag. She saw him go. " * 8
    hard = "Notwithstanding the ostensible harmonisation of jurisdictional testimonial assertions, the interlocutory committee may provisionally disregard uncorroborated fiduciary misrepresentation irrespective of terminological inconsistencies. " * 5
    rows = [(1, easy), (2, hard), (3, None), (4, ""), (5, "too short"), (1, easy), (6, easy.replace(" ", " ")), (7, easy * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as grade", "'x' as t", "2 as band")
    got = sorted((r.doc_id, r.band) for r in R.levels(df, "doc_id", "text", grader).collect())
    assert got == [(1, "basic"), (1, "basic"), (2, "advanced"), (6, "basic"), (7, "basic")]
    assert R.levels(df.limit(0), "doc_id", "text", grader).count() == 0


def test_features_of_nothing():
    assert R.features("") == [0.0] * len(R.NAMES) == R.features("123 !!")
    assert all(np.isfinite(R.features("one")))


def test_needs_labels(spark):
    with pytest.raises(ValueError):
        R.train(table(spark, SF, "documents"), "doc_id", "text", "source", table(spark, SF, "reading_labels").limit(0), "doc_id", "band")
