"""Corpus building: overlays, crosswalks, keywords, page offsets, spans, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import ordered


def overlay(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Rows of `base`, each replaced by the row of `extra` of the same key (unique there); columns that `extra` lacks stay."""
    new = extra.select(F.col(key), *(F.col(c).alias(f"__n_{c}") for c in extra.columns if c != key), F.lit(True).alias("__hit"))
    joined = base.join(new, key, "left")
    return joined.select(*(F.when(F.col("__hit"), F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c) if c != key and c in extra.columns else F.col(c) for c in base.columns))


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    window = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("__r", F.row_number().over(window)).where("__r = 1").drop("__r")


def marked_latest(df: DataFrame, key: str, mark: str, *order: str) -> DataFrame:
    """All rows, with whether each is the last of its key."""
    return df.withColumn(mark, F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))) == 1)


def adjacency(edges: DataFrame, a: str, b: str) -> DataFrame:
    """`id`, `maps_to`: each end of an edge and its distinct partners, sorted."""
    both = edges.select(F.col(a).alias("id"), F.col(b).alias("to")).unionAll(edges.select(F.col(b).alias("id"), F.col(a).alias("to")))
    return both.where("id is not null and to is not null").groupBy("id").agg(F.array_sort(F.collect_set("to")).alias("maps_to"))


def mapping_only(edge_ends: DataFrame, records: DataFrame, key: str, order: str) -> DataFrame:
    """The first edge end of each key that no record has."""
    missing = edge_ends.join(records.select(key).distinct(), key, "left_anti")
    return missing.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__r = 1").drop("__r")


def keyword_lists(df: DataFrame, key: str, title: str, text: str, k: int = 16) -> DataFrame:
    """`key`, `keyword`, `n`, `rank`: the k commonest keyword words of each record, ties by the word."""
    counted = df.select(key, F.explode(T.keyword_words(title, text)).alias("keyword")).groupBy(key, "keyword").agg(F.count("*").alias("n"))
    window = Window.partitionBy(key).orderBy(F.col("n").desc(), "keyword")
    return counted.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def page_offsets(pages: DataFrame, book: str, order: list[str], text: str, gap: int = 2) -> DataFrame:
    """Adds `page_start`: where a page's text begins in its book, with `gap` characters between pages."""
    size = F.coalesce(F.length(text), F.lit(0)).cast("long") + gap
    return ordered.running(pages, [book], order, size, "page_start").withColumn("page_start", F.coalesce("page_start", F.lit(0).cast("long")))


def as_of(points: DataFrame, starts: DataFrame, by: str, at: str, start: str, value: str) -> DataFrame:
    """Adds to each point the `value` of the last start at or before it in its group: one sort by group and place, no range join."""
    own = points.select("*", F.lit(None).cast(starts.schema[value].dataType).alias(f"__{value}"), F.col(at).alias("__at"), F.lit(1).alias("__point"))
    other = starts.select(by, F.col(value).alias(f"__{value}"), F.col(start).alias("__at"), F.lit(0).alias("__point"))
    both = ordered.last_known(own.unionByName(other, allowMissingColumns=True), [by], ["__at", "__point"], f"__{value}", value)
    return both.where("__point = 1").drop(f"__{value}", "__at", "__point")


def spans(starts: DataFrame, by: str, order: list[str], start: str, end: str = "span_end") -> DataFrame:
    """Adds the next row's start as the end of a span; the last of a group is open."""
    return ordered.neighbour(starts, [by], order, [start], "__next", following=True).withColumn(end, F.col(f"__next.{start}")).drop("__next")


def manifest(records: DataFrame, code: str, kind: str) -> DataFrame:
    """Counts by code and record kind, with totals of either (grouping sets)."""
    return records.cube(code, kind).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
