"""Eligibility, mandatory joins, alignment and contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T


def eligible(df: DataFrame, condition: Column, *excluded: tuple[DataFrame, str]) -> DataFrame:
    """Rows that meet a condition and whose keys none of the exclusion tables has."""
    out = df.where(condition)
    for table, key in excluded:
        out = out.join(table.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return out


def unmatched(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows that a mandatory join would lose; it may be made only if there are none."""
    return df.join(other.select(key).distinct(), key, "left_anti")


def aligned(a: DataFrame, b: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Two ordered lists side by side by position: `place`, both names, `same`."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    left, right = (df.select(group, place.alias("place"), F.col(name).alias(f"{name}_{side}")) for df, side in ((a, "a"), (b, "b")))
    return left.join(right, [group, "place"], "full").withColumn("same", F.col(f"{name}_a").eqNullSafe(F.col(f"{name}_b")))


def bounds_kept(df: DataFrame, group: str, least: dict[str, int]) -> DataFrame:
    """`group`, `n`, `least`, `kept`: whether each group has as many rows as it must; groups without rows too."""
    want = df.sparkSession.createDataFrame(sorted(least.items()), f"{group} string, least long")
    counted = df.groupBy(group).agg(F.count("*").alias("n"))
    return want.join(counted, group, "left").fillna({"n": 0}).withColumn("kept", F.col("n") >= F.col("least")).select(group, "n", "least", "kept")


def review_problems(levels: dict[str, tuple[str, ...]], scores: dict[str, tuple[int, int]]) -> Column:
    """Array of the fields of a review that lie outside their levels or ranges."""
    bad = [F.when(~F.coalesce(F.col(c).isin(*allowed), F.lit(False)), F.lit(c)) for c, allowed in levels.items()]
    bad += [F.when(~F.coalesce(F.col(c).between(low, high), F.lit(False)), F.lit(c)) for c, (low, high) in scores.items()]
    return F.array_compact(F.array(*bad))


def fields_percent(scores: list[str], best: int) -> Column:
    """Percent of the best possible sum over several score fields, as an aggregate; missing scores don't count."""
    total = sum((F.sum(F.coalesce(F.col(c), F.lit(0))) for c in scores), F.lit(0))
    count = sum((F.count(c) for c in scores), F.lit(0))
    return F.when(count == 0, F.lit(None).cast("double")).otherwise(F.round(total * 100.0 / (count * best), 2))


def lost_cues(reference: Column, baseline: Column, candidate: Column) -> Column:
    """Numbers of a reference that the baseline kept and the candidate lost."""
    kept, now = T.number_literals(baseline), T.number_literals(candidate)
    return F.filter(F.array_distinct(T.number_literals(reference)), lambda c: F.array_contains(kept, c) & ~F.array_contains(now, c))


def probes(texts: DataFrame, kinds: list[str], repeats: int) -> DataFrame:
    """Every text with every kind, so many times each; the kinds and repeats are a small fixed table."""
    spark: SparkSession = texts.sparkSession
    fixed = spark.createDataFrame([(k, r) for k in kinds for r in range(repeats)], "kind string, repeat int")
    return texts.join(F.broadcast(fixed), F.lit(True))


def damaged(text: Column) -> Column:
    """How many replacement characters a text has."""
    return F.regexp_count(text, F.lit("�"))


def families(text: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """How many families of cue words have a word in a text."""
    found = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " "), " ")
    return sum((F.when(F.arrays_overlap(found, T.literals(words)), 1).otherwise(0) for words in groups.values()), F.lit(0))
