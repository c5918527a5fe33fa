"""Columns of the queries, and their SQL where there is any."""

import duckdb
import pytest

from lexloom.llm import queries, sql

SF = "/root/testdata/sf0.01"
COLUMNS = {
    "p1_found": ["field", "term", "mark"], "p2_found": ["row_id", "start_char"], "p3_found": ["tbl", "row_id", "start_char"], "p4_found": ["row_id", "language"], "p5_found": ["tbl", "field", "id_a", "id_b"],
    "p6_found": ["row_id", "kind", "item"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "band"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.columns == COLUMNS[name]
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert rows and (len(set(rows)) == len(rows) or name == "p7_ids")


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("statute_supplements", "documents", "eval_items", "multilingual_completion"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    result = con.execute(sql.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert {tuple(r[c] for c in columns) for r in df.collect()} == set(result.fetchall())


def test_pieces_keep_their_record(spark):
    got = queries.p2_pieces(spark, SF)
    assert got.columns == ["row_id", "id", "section", "piece_no", "start_char", "end_char", "piece"]
    assert got.where("length(piece) > 1500 or length(piece) <> end_char - start_char").count() == 0


def test_samples_are_bounded(spark):
    from pyspark.sql import functions as F

    from lexloom.llm import base

    rows = [(k, "a" if k % 3 else "b" if k % 5 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string")
    got = {r.g: r.n for r in base.sampled(df, "id", F.when(F.col("g") == "a", 50).otherwise(7), "g").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 50, "b": 7, None: 7}
    assert base.sampled(df, "id", 10_000).count() == 3000
    assert {r.id for r in base.sampled(df, "id", 20).collect()} == {r.id for r in base.sampled(df.repartition(7), "id", 20).collect()}
    assert base.sampled(df.limit(0), "id", 5).count() == 0
