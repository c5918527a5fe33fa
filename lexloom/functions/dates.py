"""Dates in text, and what follows from them, as column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import words

_MONTH = "|".join(words.MONTHS)
#: The four written forms; only years 20xx.
PATTERNS = (
    r"\b(20[0-9]{2})[-/.](0?[1-9]|1[0-2])[-/.](0?[1-9]|[12][0-9]|3[01])\b",
    r"\b(0?[1-9]|[12][0-9]|3[01])[-/.](0?[1-9]|1[0-2])[-/.](20[0-9]{2})\b",
    rf"(?i)\b({_MONTH})\s+([0-3]?[0-9]),?\s+(20[0-9]{{2}})\b",
    rf"(?i)\b([0-3]?[0-9])\s+({_MONTH}),?\s+(20[0-9]{{2}})\b",
)
#: Group numbers of year, month and day in each.
GROUPS = ((1, 2, 3), (3, 2, 1), (3, 1, 2), (3, 2, 1))
AROUND = 45


def _iso(year: Column, month: Column, day: Column, named: bool) -> Column:
    """An ISO date, or null if there is no such day."""
    number = F.element_at(F.create_map(*(x for i, m in enumerate(words.MONTHS, 1) for x in (F.lit(m), F.lit(i)))), F.lower(month)) if named else month.cast("int")
    text = F.format_string("%s-%02d-%02d", year, number, day.cast("int"))
    return F.when(F.try_to_date(text, "yyyy-MM-dd").isNotNull(), text)


def _dated(raw: Column, pattern: str, groups: tuple[int, int, int], named: bool) -> Column:
    """A match with its date. The match alone has the groups that it has in its text: it begins and ends at word boundaries."""
    year, month, day = (F.regexp_extract(raw, pattern, g) for g in groups)
    return F.struct(_iso(year, month, day, named).alias("value"), raw.alias("raw"))


def dates(text: str | Column) -> Column:
    """Array of (value, raw) of all dates, by form and then by place; a value once, with the raw text of its last mention."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    text = F.when(F.contains(text, F.lit("20")), text).otherwise("")  # in the year of every form
    parts = []
    for k, (pattern, groups) in enumerate(zip(PATTERNS, GROUPS)):
        own = functools.partial(_dated, pattern=pattern, groups=groups, named=k >= 2)
        parts.append(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda raw: own(raw)))  # each form is searched for once
    every = F.filter(F.concat(*parts), lambda x: x["value"].isNotNull())
    values = F.array_distinct(F.transform(every, lambda x: x["value"]))
    return F.transform(values, lambda v: F.element_at(F.filter(every, lambda x: x["value"] == v), -1))


def hint_score(text: Column, raw: Column) -> Column:
    """How many hints of the offence date stand within AROUND characters of the first occurrence of `raw`."""
    at = F.position(raw, text)
    start = F.greatest(F.lit(1), at - AROUND)
    around = F.lower(F.substring(text, start, at - start + F.length(raw) + AROUND))
    return sum((F.when(F.contains(around, F.lit(h)), 1).otherwise(0) for h in words.OFFENCE_HINTS), F.lit(0))


def continuing(text: str | Column) -> Column:
    return F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))).rlike(words.CONTINUING)


def offence_date(text: str | Column, found: Column) -> Column:
    """The only date; of several the one with most hints near it; of a tie the first, or none if the conduct goes on."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    scored = F.transform(found, lambda x, i: F.struct((-hint_score(text, x["raw"])).alias("s"), i.alias("i"), x["value"].alias("v")))
    ranked = F.array_sort(scored)
    tie = (F.size(found) > 1) & (F.get(ranked, F.lit(0))["s"] == F.get(ranked, F.lit(1))["s"])
    return F.when(F.size(found) == 0, F.lit(None).cast("string")).when(tie & F.lower(text).rlike(words.UNDECIDED), F.lit(None).cast("string")).otherwise(F.get(ranked, F.lit(0))["v"])


def period_route(found: Column, going_on: Column, offence: Column, cutoff: str = words.CUTOFF) -> Column:
    """Which side of a cutoff a text belongs to: MULTI_PERIOD_REVIEW, CLARIFY, IPC_ONLY or BNS_PRIMARY."""
    values = F.transform(found, lambda x: x["value"])
    spans = going_on & (F.size(found) > 1) & (F.array_min(values) < cutoff) & (F.array_max(values) >= cutoff)
    return F.when(spans, "MULTI_PERIOD_REVIEW").when(offence.isNull(), "CLARIFY").when(offence < cutoff, "IPC_ONLY").otherwise("BNS_PRIMARY")
