"""Keyphrases by the degree and frequency of words in runs of content words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions import words

DELIMITERS = sorted((set(words.ENGLISH_STOP) - set(words.ENGLISH_NEGATIONS)) | set(words.PHRASE_NOISE) | set(words.MONTHS) | set(words.MONTHS_SHORT))


def keyphrases(df: DataFrame, key: str, text: str, limit: int = 8, longest: int = 4) -> DataFrame:
    """`key`, `phrase`, `score`, `words`, `occurrences`, `rank`.

    Runs of words between delimiters (anything but words, stop-words other than negations, and words that are entities) are phrases. A word's
    weight is its degree (lengths of its phrases, summed) by its frequency; a phrase's score is the sum of its words' weights. Phrases over
    `longest` words count for the weights but are not given out. All within a record: runs by gaps and islands over one sort.
    """
    tokens = df.select(key, F.posexplode(T.tokens(text)).alias("pos", "token")).withColumn("word", F.lower("token"))
    cut = (T.token_kind("token") != "word") | F.col("word").isin(*DELIMITERS)
    run = F.sum(F.when(cut, 1).otherwise(0)).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    content = tokens.withColumn("run", run).where(~cut)
    phrases = content.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"), F.min("pos").alias("first"))
    phrases = phrases.select(key, "first", F.transform("w", lambda x: x["word"]).alias("w"), F.size("w").alias("words"))
    each = phrases.select(key, "first", "words", F.explode("w").alias("word"))
    weight = each.groupBy(key, "word").agg((F.sum("words") / F.count("*")).alias("weight"))
    scored = each.where(F.col("words") <= longest).join(weight, [key, "word"]).groupBy(key, "first").agg(F.sum("weight").alias("score"))
    named = phrases.where(F.col("words") <= longest).join(scored, [key, "first"]).select(key, "first", F.array_join("w", " ").alias("phrase"), "words", "score")
    out = named.groupBy(key, "phrase").agg(F.round(F.max("score"), 2).alias("score"), F.max("words").alias("words"), F.count("*").alias("occurrences"), F.min("first").alias("first"))
    window = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("occurrences").desc(), "first")
    return out.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit).drop("first")
