"""Scores, rates, gates and integrity checks over labels and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators import ordered


def percent(hits: Column, total: Column, empty: float | None = None) -> Column:
    """100 * hits / total with two decimals; `empty` where the total is 0."""
    return F.when(total == 0, F.lit(empty).cast("double")).otherwise(F.round(hits * 100.0 / total, 2))


def masked_rate(hit: Column, eligible: Column, empty: float | None = None) -> Column:
    """Rate of hits among eligible rows, as an aggregate."""
    return percent(F.count_if(eligible & F.coalesce(hit, F.lit(False))), F.count_if(eligible), empty)


def micro_rate(edits: Column, size: Column) -> Column:
    return F.try_divide(F.sum(edits), F.sum(size))


def mean_rate(edits: Column, size: Column) -> Column:
    return F.avg(F.try_divide(edits, size))


def ordinal_percent(level: Column, best: int) -> Column:
    """Share of the best possible sum of ordinal levels."""
    return percent(F.sum(level), F.count(level) * best)


def one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that break a one-to-one join: `key`, `problem` (left_only, right_only, repeated)."""
    na = a.groupBy(key).agg(F.count("*").alias("na"))
    nb = b.groupBy(key).agg(F.count("*").alias("nb"))
    both = na.join(nb, key, "full")
    problem = F.when(F.col("nb").isNull(), "left_only").when(F.col("na").isNull(), "right_only").when((F.col("na") > 1) | (F.col("nb") > 1), "repeated")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def label_violations(route: Column, first: Column, three: Column) -> Column:
    """Array of what a gold label breaks: a clarifying one names a provision, another names none or over three, repeats one, or lacks its first."""
    clarify = route == "CLARIFY"
    size = F.coalesce(F.size(three), F.lit(0))
    size = F.when(size < 0, 0).otherwise(size)
    return F.array_compact(F.array(
        F.when(route.isNull() | ~route.isin("IPC_ONLY", "BNS_PRIMARY", "MULTI_PERIOD_REVIEW", "CLARIFY"), "route"),
        F.when(~clarify & ~size.between(1, 3), "count"),
        F.when(size != F.coalesce(F.size(F.array_distinct(three)), F.lit(0)), "distinct"),
        F.when(first.isNotNull() & ~F.coalesce(F.array_contains(three, first), F.lit(False)), "first"),
    ))


def paired(rows: DataFrame, key: str, arm: str, baseline: str, candidate: str, *values: str) -> DataFrame:
    """One row per key with both arms' values side by side; keys with another number of rows in an arm have `complete` false."""
    wide = rows.groupBy(key).agg(
        *(F.max(F.when(F.col(arm) == a, F.col(v))).alias(f"{n}_{v}") for n, a in (("b", baseline), ("c", candidate)) for v in values),
        ((F.count_if(F.col(arm) == baseline) == 1) & (F.count_if(F.col(arm) == candidate) == 1)).alias("complete"),
    )
    return wide


def regression_gate(pairs: DataFrame, errors: str, cost: str, speed: float = 0.9) -> DataFrame:
    """One row: whether no pair has more errors, the median cost ratio, and acceptance if it is at most `speed`."""
    out = pairs.where("complete").agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col(f"c_{errors}") > F.col(f"b_{errors}")).alias("regressions"),
        F.median(f"b_{cost}").alias("baseline_median"),
        F.median(f"c_{cost}").alias("candidate_median"),
    )
    accepted = (F.col("pairs") > 0) & (F.col("regressions") == 0) & (F.col("candidate_median") <= F.col("baseline_median") * speed)
    return out.select("*", F.coalesce(accepted, F.lit(False)).alias("accepted"))


def gain_gate(pairs: DataFrame, errors: str, cost: str, slower: float = 1.25) -> DataFrame:
    """One row: a strict gain in all errors, no pair worse, and at most `slower` times the cost."""
    out = pairs.where("complete").agg(F.sum(f"b_{errors}").alias("baseline_errors"), F.sum(f"c_{errors}").alias("candidate_errors"), F.count_if(F.col(f"c_{errors}") > F.col(f"b_{errors}")).alias("worse"), F.sum(f"b_{cost}").alias("baseline_cost"), F.sum(f"c_{cost}").alias("candidate_cost"))
    return out.select("*", F.coalesce((F.col("candidate_errors") < F.col("baseline_errors")) & (F.col("worse") == 0) & (F.col("candidate_cost") <= F.col("baseline_cost") * slower), F.lit(False)).alias("accepted"))


def completeness(expected: DataFrame, results: DataFrame, key: str, failed: Column) -> DataFrame:
    """One row: expected, missing, unexpected and failed keys, and whether all is there."""
    e, r = expected.select(key).distinct().withColumn("e", F.lit(1)), results.groupBy(key).agg(F.max(failed.cast("int")).alias("bad"))
    out = e.join(r.withColumn("r", F.lit(1)), key, "full").agg(F.count("e").alias("expected"), F.count_if(F.col("r").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"), F.count_if(F.col("bad") == 1).alias("failed"))
    return out.select("*", ((F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("failed") == 0)).alias("complete"))


def seal(*columns: str) -> Column:
    """SHA-256 of a row's columns in order, nulls kept apart from empty texts."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns)), 256)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """`key`, `status` (new, removed, changed) of what differs between two snapshots."""
    b, a = before.select(F.col(key), F.col(digest).alias("b")), after.select(F.col(key), F.col(digest).alias("a"))
    status = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return b.join(a, key, "full").select(key, status.alias("status")).where("status is not null")


def reserves(df: DataFrame, by: str, order: list[str], identity: str, eligible: Column, n: int) -> DataFrame:
    """All rows in a frozen order with `choice`: chosen (the first n eligible of a group), reserve, repeated, or ineligible."""
    same = Window.partitionBy(by, identity).orderBy(*order)
    marked = df.withColumn("__ok", F.coalesce(eligible, F.lit(False))).withColumn("__again", F.row_number().over(same) > 1)
    counts = F.when(F.col("__ok") & ~F.col("__again"), 1).otherwise(0)
    marked = ordered.running(marked, [by], order, counts, "__n").withColumn("__n", F.coalesce("__n", F.lit(0)) + counts)
    choice = F.when(~F.col("__ok"), "ineligible").when(F.col("__again"), "repeated").when(F.col("__n") <= n, "chosen").otherwise("reserve")
    return marked.withColumn("choice", choice).drop("__ok", "__again", "__n")


def label_metrics(rows: DataFrame, route: str, found: str, law: str, first: str, three: str) -> DataFrame:
    """One row of ratios, each over the labels that have what it needs. found and three: arrays of provisions, the best first; null counts as none.

    A label that names no provision agrees with a result that has none."""
    none = F.array().cast("array<string>")
    own = rows.select(F.col(route).alias("route"), F.col(law).alias("law"), F.nullif(F.col(first), F.lit("")).alias("first"), F.slice(F.coalesce(found, none), 1, 3).alias("found"), F.coalesce(three, none).alias("three"))
    own = own.withColumn("hits", F.size(F.array_intersect("three", "found"))).withColumn("wanted", F.size("three"))
    named = F.col("wanted") > 0
    return own.agg(
        F.count("*").alias("cases"),
        masked_rate(F.col("route") == F.col("law"), F.col("law").isNotNull()).alias("law_accuracy"),
        masked_rate(F.get("found", F.lit(0)).eqNullSafe(F.col("first")), F.lit(True)).alias("first_accuracy"),
        masked_rate(F.get("found", F.lit(0)) == F.col("first"), F.col("first").isNotNull()).alias("named_first_accuracy"),
        masked_rate(F.col("hits") == F.col("wanted"), F.lit(True)).alias("all_of_three"),
        masked_rate(F.col("hits") > 0, named).alias("any_of_three"),
        percent(F.sum("hits"), F.sum("wanted")).alias("recall_of_three"),
    )


def rescored(saved: DataFrame, fixtures: DataFrame, keys: list[str], text: str) -> DataFrame:
    """`keys`, `status` (missing, unexpected, changed, same) of saved results against fixtures by all keys; a null text is a text."""
    a, b = saved.select(*keys, F.col(text).alias("a"), F.lit(1).alias("in_a")), fixtures.select(*keys, F.col(text).alias("b"), F.lit(1).alias("in_b"))
    status = F.when(F.col("in_a").isNull(), "missing").when(F.col("in_b").isNull(), "unexpected").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def study_gate(pairs: DataFrame, errors: list[str], cost: str, gain: float = 0.2, slower: float = 1.25, budget: float = 180_000.0, faults: str | None = None) -> DataFrame:
    """One row: quality (each kind of error falls by the share `gain` in all, and for no pair rises), latency (at most `slower` in all, each under the budget),
    safety (no pair has a fault), and whether all hold. With a gain of 0 a strict fall is asked. Without any whole pair nothing holds."""
    total = lambda arm, e: F.sum(f"{arm}_{e}")
    better = [total("c", e) <= (1 - gain) * total("b", e) if gain else total("c", e) < total("b", e) for e in errors]
    worse = F.count_if(F.exists(F.array(*(F.col(f"c_{e}") > F.col(f"b_{e}") for e in errors)), lambda x: x))
    quality = worse == 0
    for b in better:
        quality = quality & b
    latency = (total("c", cost) <= slower * total("b", cost)) & (F.max(f"c_{cost}") < budget)
    safety = F.count_if(F.coalesce(F.col(faults), F.lit(False))) == 0 if faults else F.lit(True)
    out = pairs.where("complete").agg(F.count("*").alias("pairs"), worse.alias("regressions"), F.coalesce(quality, F.lit(False)).alias("quality"), F.coalesce(latency, F.lit(False)).alias("latency"), F.coalesce(safety, F.lit(False)).alias("safety"))
    return out.select("*", ((F.col("pairs") > 0) & F.col("quality") & F.col("latency") & F.col("safety")).alias("passed"))


def usable(rows: DataFrame, numbers: list[str], drift_of: tuple[str, str], expected: int, budget: float, allowed: float = 1000.0, others: bool = True) -> DataFrame:
    """One row: whether measurements may be used: as many as expected, every number finite, positive and within the budget, wall and elapsed time
    within `allowed` of each other, and what else must hold."""
    good = F.lit(True)
    for c in numbers:
        good = good & F.coalesce(F.col(c).between(0, budget) & (F.col(c) > 0) & ~F.isnan(c), F.lit(False))
    wall, elapsed = (F.col(c) for c in drift_of)
    good = good & F.coalesce(F.abs(wall - elapsed) <= allowed, F.lit(False))
    out = rows.agg(F.count("*").alias("n"), F.count_if(good).alias("good"))
    return out.select("n", "good", ((F.col("n") == expected) & (F.col("n") == F.col("good")) & F.lit(others)).alias("usable"))
