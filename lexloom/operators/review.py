"""Confidence of recognised words and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_confidences(values: Column, most: int, longest: int) -> Column:
    """At most `most` entries (w, p) with a text and a probability of 0 to 1; texts are cut to `longest` characters. A feature of the format."""
    kept = F.filter(F.slice(values, 1, most), lambda x: x["w"].isNotNull() & x["p"].isNotNull() & ~F.isnan(x["p"]) & x["p"].between(0, 1))
    return F.transform(kept, lambda x: F.struct(F.substring(x["w"], 1, longest).alias("w"), x["p"].alias("p")))


def doubtful_words(rows: DataFrame, by: str, word: str, p: str, floor: float = 0.5, number_floor: float = 0.75, limit: int = 8) -> DataFrame:
    """`by`, `word`, `p`, `rank`: the least certain distinct words under their floor; ties by the word."""
    low = rows.where(F.col(p) < F.when(F.col(word).rlike("[0-9]"), number_floor).otherwise(floor))
    first = low.groupBy(by, F.lower(word).alias("word")).agg(F.min(p).alias("p"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("p", "word"))).where(F.col("rank") <= limit)


def doubtful_segments(rows: DataFrame, by: str, text: str, p: str, floor: float = 0.6, limit: int = 5, longest: int = 160) -> DataFrame:
    """`by`, `text` (cut to `longest`, a feature of the report), `p`, `rank`: the least certain segments; ties by the text."""
    low = rows.where((F.col(p) < floor) & (F.trim(text) != ""))
    ranked = low.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(p, text))).where(F.col("rank") <= limit)
    return ranked.select(by, F.substring(F.trim(text), 1, longest).alias("text"), F.col(p).alias("p"), "rank")


def weighted_confidence(p: Column, text: Column) -> Column:
    """Mean by length, as an aggregate."""
    return F.round(F.try_divide(F.sum(p * F.length(text)), F.sum(F.length(text))), 3)


def top_indices(vector: Column, k: int, excluded: tuple[int, ...] = ()) -> Column:
    """Places of the k greatest finite values, greatest first, ties by place."""
    pairs = F.transform(vector, lambda v, i: F.struct((-v.cast("double")).alias("v"), i.alias("i"), v.cast("double").alias("raw")))
    good = F.filter(pairs, lambda x: x["raw"].isNotNull() & ~F.isnan(x["raw"]) & (F.abs(x["raw"]) != float("inf")) & ~x["i"].isin(*excluded) if excluded else x["raw"].isNotNull() & ~F.isnan(x["raw"]) & (F.abs(x["raw"]) != float("inf")))
    return F.transform(F.slice(F.array_sort(good), 1, k), lambda x: x["i"])
