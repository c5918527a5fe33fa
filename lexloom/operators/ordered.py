"""What a row takes from the rows before or after it in its group, for groups of any size.

A window sorts a group in one task. That is the plan here while every group has at most HOT_ROWS rows, which is counted first. Beyond that
groups are split: rows are partitioned by ranges of (group, order), each task works on its segments, and only one row per segment is
carried from segment to segment. Both ways give the same result; ties in the order are the caller's to break.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import cut

#: The largest group that one task sorts.
HOT_ROWS = 5_000_000


def hot(df: DataFrame, by: list[str]) -> bool:
    largest = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return largest is not None and largest > HOT_ROWS


def _split(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with the number of their range; written once, since ranges come from a sample."""
    return cut(df.repartitionByRange(*by, *order).withColumn("__pid", F.spark_partition_id()))


def _carry(own: DataFrame, parts: DataFrame, by: list[str]) -> DataFrame:
    """Joins a row per segment back; a null group is a group."""
    right = parts.select(F.col("__pid").alias("__p"), *(F.col(b).alias(f"__b_{b}") for b in by), "__carry")
    on = own["__pid"] == right["__p"]
    for b in by:
        on = on & own[b].eqNullSafe(right[f"__b_{b}"])
    return own.join(right, on).drop("__p", *(f"__b_{b}" for b in by))


def _before(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, by: list[str], order: list[str], column: str | Column, out: str, how: Callable[[Column], Column] = F.sum) -> DataFrame:
    """Adds the sum (or, with `F.max`, the greatest) of a column over the rows before each; null for a group's first."""
    value = F.col(column) if isinstance(column, str) else column
    if not hot(df, by):
        return df.withColumn(out, how(value).over(_before(by, order)))
    own = _split(df.withColumn("__v", value), by, order)
    parts = own.groupBy("__pid", *by).agg(how(F.col("__v")).alias("__part")).withColumn("__carry", how(F.col("__part")).over(_before(by, ["__pid"])))
    joined = _carry(own.withColumn("__in", how(F.col("__v")).over(_before(["__pid", *by], order))), parts, by)
    both = F.greatest("__in", "__carry") if how is F.max else F.when(F.col("__in").isNotNull() | F.col("__carry").isNotNull(), F.coalesce("__in", F.lit(0)) + F.coalesce("__carry", F.lit(0)))
    return joined.withColumn(out, both).drop("__pid", "__v", "__in", "__carry")


def neighbour(df: DataFrame, by: list[str], order: list[str], columns: list[str], out: str, following: bool = False) -> DataFrame:
    """Adds a struct of columns of the row before (or after) each; null where there is none."""
    row = F.struct(*columns)
    shift = F.lead if following else F.lag
    if not hot(df, by):
        return df.withColumn("__r", row).withColumn(out, shift("__r").over(Window.partitionBy(*by).orderBy(*order))).drop("__r")
    own = _split(df.withColumn("__r", row), by, order)
    edge = (F.min_by if following else F.max_by)("__r", F.struct(*order))
    parts = own.groupBy("__pid", *by).agg(edge.alias("__part")).withColumn("__carry", shift("__part").over(Window.partitionBy(*by).orderBy("__pid")))
    inner = own.withColumn("__in", shift("__r").over(Window.partitionBy("__pid", *by).orderBy(*order)))
    return _carry(inner, parts, by).withColumn(out, F.coalesce("__in", "__carry")).drop("__pid", "__r", "__in", "__carry")


def last_known(df: DataFrame, by: list[str], order: list[str], column: str, out: str) -> DataFrame:
    """Adds the last value of a column that isn't null, up to each row."""
    here = lambda b, o: Window.partitionBy(*b).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    if not hot(df, by):
        return df.withColumn(out, F.last(column, ignorenulls=True).over(here(by, order)))
    own = _split(df, by, order)
    known = F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order)))
    parts = own.groupBy("__pid", *by).agg(known.alias("__part")).withColumn("__carry", F.last("__part", ignorenulls=True).over(_before(by, ["__pid"])))
    inner = own.withColumn("__in", F.last(column, ignorenulls=True).over(here(["__pid", *by], order)))
    return _carry(inner, parts, by).withColumn(out, F.coalesce("__in", "__carry")).drop("__pid", "__in", "__carry")
