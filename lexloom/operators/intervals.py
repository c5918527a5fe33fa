"""Ordered rows, intervals and paired events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators import ordered


def gaps(intervals: DataFrame, by: str, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """`by`, `gap_start`, `gap_end`: what intervals leave free of [low, high); they may touch, overlap or nest."""
    until = ordered.running(intervals, [by], [start, end], end, "__until", F.max)
    inner = until.select(by, F.coalesce("__until", low).alias("gap_start"), F.col(start).alias("gap_end"))
    last = intervals.groupBy(by).agg(F.greatest(F.max(end), low).alias("gap_start")).select(by, "gap_start", high.alias("gap_end"))
    return inner.unionByName(last).where("gap_start < gap_end")


def retained(intervals: DataFrame, by: str, start: str, end: str, total: Column) -> DataFrame:
    return intervals.groupBy(by).agg(F.try_divide(F.sum(F.col(end) - F.col(start)), F.max(total)).alias("retained"))


def pairs(events: DataFrame, by: str, at: str, tie: str, kind: str, opens: str, closes: str) -> DataFrame:
    """`by`, `opened`, `closed`: each closing event with the last opening one before it, if no closing one lies between; stray closings are left out."""
    own = events.where(F.col(kind).isin(opens, closes)).select(by, at, tie, kind)
    own = ordered.neighbour(own, [by], [at, tie], [kind, at], "__was")
    return own.where((F.col(kind) == closes) & (F.col(f"__was.{kind}") == opens)).select(by, F.col(f"__was.{at}").alias("opened"), F.col(at).alias("closed"))


def contiguous(windows: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """`by`, `contiguous`, `low`, `high`: whether each window ends where the next begins."""
    own = ordered.neighbour(windows.select(by, start, end), [by], [start, end], [start], "__next", following=True)
    meets = F.col(f"__next.{start}").isNull() | (F.col(f"__next.{start}") == F.col(end))
    return own.groupBy(by).agg(F.coalesce(F.bool_and(meets), F.lit(True)).alias("contiguous"), F.min(start).alias("low"), F.max(end).alias("high"))


def increasing(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """`by`, `increasing`: whether a value strictly rises in a given order."""
    own = ordered.neighbour(rows, [by], order, [value], "__was")
    rises = F.col(f"__was.{value}").isNull() | (F.col(value) > F.col(f"__was.{value}"))
    return own.groupBy(by).agg(F.coalesce(F.bool_and(rises), F.lit(True)).alias("increasing"))


def fill_up_to(rows: DataFrame, by: str, order: list[str], size: str, target: float) -> DataFrame:
    """Rows of a group in order until their sizes reach the target, with `filled` (sum before each)."""
    own = ordered.running(rows, [by], order, size, "filled").withColumn("filled", F.coalesce("filled", F.lit(0.0)))
    return own.where(F.col("filled") < target)


def drift(wall: Column, elapsed: Column, allowed: float = 1000.0) -> Column:
    return F.abs(wall - elapsed) <= allowed


def timing_fault(elapsed: Column, error: Column, budget: float) -> Column:
    """worker-error, invalid-timing or elapsed-budget-exceeded; the first that holds."""
    return F.when(error, "worker-error").when(elapsed.isNull() | F.isnan(elapsed) | (elapsed < 0), "invalid-timing").when(elapsed > budget, "elapsed-budget-exceeded")


def event_faults(events: DataFrame, by: str, at: str, kind: str, allowed: tuple[str, ...], low: str, high: str, most: int) -> DataFrame:
    """`by`, `fault` (too-many, kind, outside, none; the first that holds) of each group's events: at most `most`, of allowed kinds, within [low, high]. A null
    kind or time is a fault."""
    inside = F.coalesce(F.col(at).cast("timestamp").between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")), F.lit(False))
    own = events.groupBy(by).agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col(kind).isin(*allowed), F.lit(False))).alias("kinds"), F.bool_and(inside).alias("inside"))
    fault = F.when(F.col("n") > most, "too-many").when(~F.col("kinds"), "kind").when(~F.col("inside"), "outside").otherwise("none")
    return own.select(by, fault.alias("fault"))
