"""The whole analysis of many queries as one plan, and an expensive step made once per distinct value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import dates as D
from lexloom.functions import text as T
from lexloom.operators import retrieval


def once_per_value(df: DataFrame, column: str, result: str, step: Column) -> DataFrame:
    """Adds `result`: an expensive expression of one column, made once per distinct value. Null values get what the step gives null."""
    made = df.select(column).distinct().withColumn(result, step)
    renamed = made.withColumnRenamed(column, "__value")
    return df.join(renamed, df[column].eqNullSafe(renamed["__value"]), "left").drop("__value")


def facts(text: str) -> Column:
    """Dates, references, vocabulary and phrases of a text, as a struct."""
    found = D.dates(text)
    return F.struct(found.alias("dates"), D.offence_date(text, found).alias("offence_date"), T.section_references(text).alias("references"), T.vocabulary_hits(text).alias("keywords"), T.phrase_labels(text).alias("phrases"), D.continuing(text).alias("continuing"))


def analysis(queries: DataFrame, query_id: str, text: str, docs: DataFrame, k: int = 3) -> DataFrame:
    """`query_id`, `json`: facts, period and the k best documents (row_id, code, section, title, rank, score) of each query."""
    own = queries.select(F.col(query_id).alias("qid"), F.col(text).alias("t")).withColumn("facts", facts("t"))
    route = D.period_route(F.col("facts.dates"), F.col("facts.continuing"), F.col("facts.offence_date"))
    own = own.withColumn("route", route).withColumn("more", F.array_join(F.col("facts.keywords"), " "))
    asked = retrieval.query_tokens(own, "qid", "t", "more")
    tokens = retrieval.document_tokens(docs, "row_id", "title", F.col("section"), F.col("title"), F.col("text"), F.array_join("keywords", " "))
    scored = retrieval.scores(asked, tokens, retrieval.counted(docs)).withColumn("score", F.round("score", 6))
    best = retrieval.top(scored, k).join(docs.select(F.col("row_id").alias("doc"), "code", "section", "title"), "doc")
    hits = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "doc", "code", "section", "title", "score"))).alias("hits"))
    whole = own.join(hits, "qid", "left")
    return whole.select(F.col("qid").alias(query_id), F.to_json(F.struct("route", "facts", "hits")).alias("json"))
