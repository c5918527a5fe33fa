"""Batch lexical retrieval: many queries against a corpus in one plan.

Documents are tokenised once; only tokens that some query has go on; a query meets a document only through a shared token. Scores are
summed before anything is ranked, and ranks are cut per query before the shuffle (WindowGroupLimit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.session import cut

TITLE_BONUS = 8.0


def query_tokens(queries: DataFrame, query_id: str, *texts: str) -> DataFrame:
    """`qid`, `token`: distinct tokens of each query's text and of what expands it."""
    words = T.retrieval_tokens(F.concat_ws(" ", *(F.col(t) for t in texts)))
    return queries.select(F.col(query_id).alias("qid"), F.explode(F.array_distinct(words)).alias("token"))


def document_tokens(docs: DataFrame, doc_id: str, title: str, *fields: Column) -> DataFrame:
    """`doc`, `token`, `in_title`: distinct tokens of each document. Fields are joined; the title is one of them."""
    body = T.retrieval_tokens(F.concat_ws(" ", *fields))
    own = docs.select(F.col(doc_id).alias("doc"), F.array_distinct(body).alias("b"), T.retrieval_tokens(title).alias("t"))
    return own.select("doc", F.explode("b").alias("token"), "t").select("doc", "token", F.array_contains("t", F.col("token")).alias("in_title"))


def document_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column | int) -> Column:
    return F.log((F.lit(n) + 1) / (df + 1)) + 1


def scores(qtokens: DataFrame, dtokens: DataFrame, n_docs: DataFrame, bonus: float = TITLE_BONUS) -> DataFrame:
    """`qid`, `doc`, `score`: summed IDF of shared tokens, with a bonus for each in the title. n_docs: one row, `n`.

    Whether the queries' tokens are broadcast is for Spark to say, which knows their size when the join comes. A token's documents are summed
    within tasks before they meet, so that a token of every document is no hot key of the last shuffle.
    """
    used = cut(dtokens.join(qtokens.select("token").distinct(), "token", "left_semi"))  # read twice below; the corpus is tokenised once
    weight = document_frequency(used).crossJoin(F.broadcast(n_docs)).select("token", idf(F.col("df"), F.col("n")).alias("idf"))
    matched = used.join(qtokens.join(weight, "token"), "token")
    return matched.groupBy("qid", "doc").agg(F.sum(F.col("idf") + F.when(F.col("in_title"), F.lit(bonus)).otherwise(0.0)).alias("score"))


def counted(df: DataFrame) -> DataFrame:
    """One row: how many there are, without a job of its own."""
    return df.agg(F.count("*").alias("n"))


def top(ranked: DataFrame, k: int = 3, by=("qid",), order=("score", "doc"), first=()) -> DataFrame:
    """The k best per group, with `rank`; columns of `first` go before the score, greatest first; ties by the document's id."""
    window = Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in first), F.col(order[0]).desc(), *(F.col(c) for c in order[1:]))
    return ranked.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def diversified(ranked: DataFrame, group: str, k: int = 3) -> DataFrame:
    """Each group's best document first, in the groups' order, then the best of the rest, k in all."""
    inner = Window.partitionBy("qid", group).orderBy(F.col("score").desc(), "doc")
    firsts = ranked.withColumn("__g", F.row_number().over(inner))
    order = Window.partitionBy("qid").orderBy(F.when(F.col("__g") == 1, 0).otherwise(1), F.when(F.col("__g") == 1, F.col(group)), F.col("score").desc(), "doc")
    return firsts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("__g")


def repealed(title: Column, text: Column) -> Column:
    """Whether the title and the first 80 characters say that a record is repealed."""
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, 80)).rlike(r"(?i)\brepealed\b|\[repealed\]|^\s*rep\.\s+by")


def exact_reference(refs: Column, code: Column, section: Column) -> Column:
    return F.exists(refs, lambda r: (r["section"] == F.upper(section)) & (r["code"].isNull() | (r["code"] == code)))


def mapped_reference(refs: Column, code: Column, maps_to: Column) -> Column:
    return F.exists(refs, lambda r: r["code"].isNotNull() & (r["code"] != code) & F.array_contains(maps_to, F.concat_ws("-", F.lower(r["code"]), F.lower(r["section"]))))


def rule_points(rows: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `points`: the sum of the rule table's points for a row's keys. The rule table is a fixed dimension."""
    summed = rules.groupBy(*keys).agg(F.sum("points").alias("points"))
    return rows.join(F.broadcast(summed), keys, "left").fillna({"points": 0})
