"""Spoken dates, section numbers and amounts as figures.

A text's words are written as one string of classes, one letter a word and one mark a gap; what may be said is a regular expression over
that string, and what it means is a fold over the words' values. Null gives null. Offsets are in code points.
"""

from __future__ import annotations

import re
from functools import reduce

from lexloom.functions import words

# Number words and the words that make a number a section, an amount or a date.
SMALL = "one two three four five six seven eight nine".split()
TEENS = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"thousand": 1000, "lakh": 100_000, "lakhs": 100_000, "crore": 10_000_000, "crores": 10_000_000}
FIRSTS = "first second third fourth fifth sixth seventh eighth ninth".split()
TENTHS = "tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
SECTION_CUES = ("section", "sections", "sec", "ipc", "bns", "bnss", "crpc", "article")
MONEY_CUES = ("rupees", "rupee", "rs", "inr")


def _vocabulary() -> dict[str, tuple[str, int]]:
    """Class and value of every word that plays a part."""
    out = {"zero": ("z", 0), "oh": ("y", 0), "hundred": ("h", 100), "and": ("&", 0), "of": ("f", 0), "the": ("e", 0), "thirtieth": ("p", 30)}
    for kind, group, first, step in (("u", SMALL, 1, 1), ("t", TEENS, 10, 1), ("d", TENS, 20, 10), ("o", FIRSTS, 1, 1), ("p", TENTHS, 10, 1)):
        out |= {w: (kind, first + step * k) for k, w in enumerate(group)}
    out |= {w: ("s", v) for w, v in SCALES.items()}
    out |= {w: ("#", 0) for w in ("number", "no", "num")} | {w: ("§", 0) for w in SECTION_CUES} | {w: ("$", 0) for w in MONEY_CUES}
    return out | {m: ("M" if m in ("may", "march") else "m", 0) for m in words.MONTHS}


VOCABULARY = _vocabulary()
TOKEN = re.compile(r"[A-Za-z]+|\d+")

# What may be said, over classes; words are joined by a gap of spaces or hyphens (' ') or with a comma (',').
BELOW = "(?:d(?: u)?|[tu])"
HUNDREDS = f"{BELOW}(?: h(?:(?: &)? {BELOW})?)?"
CARDINAL = f"(?:{HUNDREDS}(?: s(?:(?: &)? {HUNDREDS})?)*|z)"
YEAR = f"(?:Y|u s(?:(?: &)? {BELOW})?|[td] (?:[zy] u|d(?: u)?|t))"
DATE = re.compile(f"(?:(?:e )?(?P<day>n|(?:d )?o|p|d(?: u)?|[tu])(?: [ef])? )?(?P<month>[mM])(?:[ ,](?P<year>{YEAR}))?")
AMOUNT = re.compile(f"(?P<n>{CARDINAL}) \\$")


def _sum(values: list[tuple[str, int]]) -> int:
    """A cardinal's value: what is below a hundred adds up, hundreds and scales multiply what stands before them."""

    def step(state, word):
        total, group = state
        kind, value = word
        return (total + max(group, 1) * value, 0) if kind == "s" else (total, group * 100) if kind == "h" else (total, group + value)

    return sum(reduce(step, values, (0, 0)))


def _pair(values: list[tuple[str, int]]) -> int:
    """A leading figure of hundreds, then what is below a hundred: three seventy nine, three oh two, twenty twenty four."""
    return values[0][1] * 100 + sum(v for _, v in values[1:])


def _digits(values: list[tuple[str, int]]) -> int:
    return int("".join(str(v) for _, v in values))


#: Ways to say a section's number, the first that fits: what is said, what it means, and what it may be.
SECTIONS = [
    (re.compile(CARDINAL), _sum, lambda n, said: "h" in said),
    (re.compile("u (?:d(?: u)?|t|[zy] u)"), _pair, lambda n, said: True),
    (re.compile("u u(?: u)?"), _digits, lambda n, said: True),
    (re.compile(CARDINAL), _sum, lambda n, said: 0 < n < 1000),
]
SECTION = re.compile("§ (?:# )?")


class Spoken:
    """A text's words with their places, classes and values."""

    def __init__(self, text: str):
        found = list(TOKEN.finditer(text))
        self.spans = [m.span() for m in found]
        low = [m[0].lower() for m in found]
        self.values = [VOCABULARY.get(w) or (("Y" if re.fullmatch(r"(?:19|20)\d\d", w) else "n" if len(w) < 3 else "N", int(w)) if w.isdigit() else (".", 0)) for w in low]
        gaps = [text[a:b] for (_, a), (b, _) in zip(self.spans, self.spans[1:])]
        marks = [" " if re.fullmatch(r"[\s-]+", g) else "," if re.fullmatch(r"[\s,]+", g) else "|" for g in gaps] + ["|"]
        self.classes = "".join(kind + mark for (kind, _), mark in zip(self.values, marks))

    def of(self, span: tuple[int, int]) -> list[tuple[str, int]]:
        """Classes and values of the words of a span of the class string; a gap has none."""
        a, b = span
        return [v for v in self.values[a // 2 : (b + 1) // 2] if v[0] != "&"]


def _dates(w: Spoken, text: str):
    for m in DATE.finditer(w.classes):
        day = _sum([(k, v) for k, v in w.of(m.span("day"))]) if m["day"] else None
        year = w.of(m.span("year")) if m["year"] else None
        value = None if year is None else _sum(year) if year[0][0] in "Yu" else _pair(year)
        if value is not None and not 1900 <= value < 2100:
            value = year = None
        first = m.start()
        if day is not None and not 1 <= day <= 31:
            day = None
        if day is None:
            first = m.start("month")
        spoken = day is not None and m["day"] != "n" or year is not None and m["year"] != "Y"
        if not spoken or m["month"] == "M" and value is None:
            continue
        month = m.start("month")
        end = m.end("year") if value is not None else month + 1
        a, b = w.spans[month // 2]
        yield first, end, " ".join(str(x) for x in (day, text[a:b].capitalize(), value) if x is not None), "date"


def _sections(w: Spoken):
    for cue in SECTION.finditer(w.classes):
        for pattern, meaning, allowed in SECTIONS:
            m = pattern.match(w.classes, cue.end())
            if m and allowed(n := meaning(w.of(m.span())), m[0]):
                yield m.start(), m.end(), str(n), "section"
                break


def _amounts(w: Spoken):
    for m in AMOUNT.finditer(w.classes):
        yield *m.span("n"), f"{_sum(w.of(m.span('n'))):,}", "amount"


def written_numbers(text: str) -> tuple[str, list[tuple[str, str, str]]]:
    """Spoken dates, section numbers and amounts as figures, and a log of (kind, from, to). Dates claim their words first, then sections. A date
    needs a spoken part, May and March a year; an amount needs a money word."""
    w = Spoken(text)
    taken, edits = bytearray(len(w.classes)), []
    for a, b, to, kind in (*_dates(w, text), *_sections(w), *_amounts(w)):
        if not any(taken[a:b]):
            taken[a:b] = b"1" * (b - a)
            edits.append((w.spans[a // 2][0], w.spans[(b - 1) // 2][1], to, kind))
    out, log, at = [], [], 0
    for a, b, to, kind in sorted(edits):
        out += [text[at:a], to]
        log.append((kind, text[a:b], to))
        at = b
    return "".join([*out, text[at:]]), log
