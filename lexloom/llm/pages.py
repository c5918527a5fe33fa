"""Lines of scanned pages: which of them the printed page added.

Pages are told apart by their numbers; the lines next to a page number and the text's first line are page edges. A running head is an edge
line that repeats, fuzzily: at another page's edge, at the edges of a share of its book's records, or as what the record's pages carry (its
title or heading, its book). A line that repeats such a head where no number stands is a page's edge all the same.

Whatever is decided about a line depends on the lines within REACH characters of it and on the given tables only, so that a range of a text
with a halo of CONTEXT characters decides as the whole text does.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import regex

LINE = re.compile(r"([^\r\n]*)(?:\r\n|\r|\n|$)")
BARE = re.compile(r"^(?:[-–—]\s*(\d{1,5})\s*[-–—]|[\[(]\s*(\d{1,5})\s*[\])]|[Pp](?:age|AGE|g?\.)\s*(\d{1,5})|(\d{1,5}))$")
#: A number indented this far is set off like one between dashes.
CENTRED = 8
#: A short line that introduces a value on a line of its own.
VALUE_LABEL = regex.compile(r"^\p{Lu}[^.;:]{2,28}:$")
#: The section's own heading begins so; it is no running head, though it says the title.
HEADING = regex.compile(r"(?:^|\n)[^\w\n]*(?:\p{L}{3,7}\.?\s+)?\d{1,4}[A-Z]*[.:]\s+(\p{L}[^.—–]{5,140})[.—–]")
NUMBERED = regex.compile(r"^\W*(?:\p{L}{3,7}\.?\s+)?\d{1,4}[A-Z]*[.:]\s")
# What a misread character sequence stands for.
MISREAD = (("c", "e"), ("1", "i"), ("1", "l"), ("f", "t"), ("0", "o"), ("5", "s"), ("9", "g"), ("6", "b"), ("b", "h"), ("m", "in"), ("m", "rn"), ("cl", "d"), ("ii", "u"), ("rn", "m"), ("vv", "w"), ("h", "li"), ("'i'", "t"), ("8", "b"), ("l", "i"), ("i", "l"))
HYPHENS = "-­¬‐‑"
#: Characters over which lines are neighbours; longer lines are never furniture.
REACH, LONGEST = 160, 120
#: Letters that a running head has at least; the share of them that repetitions may differ in; the share of a line that may be something else than the head.
LEAST, DIFFERS, BESIDES = 6, 0.15, 0.4
#: The share of letters in which two edge lines that say the same may differ; less, since neither is known to be a head.
REPEATS = 0.08
#: Letters of either end by which repetitions meet.
HALF = 8


def lines(text: str) -> list[tuple[int, int]]:
    """Start and end of each line, without its break."""
    return [m.span(1) for m in LINE.finditer(text) if m.end() > m.start()]


ALONE, NO_WORD = re.compile(r"(?<!\w)\d[\d\s]*(?!\w)"), re.compile(r"[\W_]+")


def key(line: str) -> str:
    """A line's words in upper case, without numbers that stand alone and punctuation."""
    return NO_WORD.sub(" ", ALONE.sub(" ", line).upper()).strip()


def number(line: str) -> int | None:
    m = BARE.match(line)
    return int(m[1] or m[2] or m[3] or m[4]) if m else None


def _edits(pattern: str, text: str, most: int) -> list[int] | None:
    """Edits of `pattern` against each beginning of `text` whose length is within `most` of its own; None if all are over `most`."""
    far, n = most + 1, len(text)
    band = [abs(k - most) if k >= most else far for k in range(2 * most + 1)]  # band[k]: edits at place i + k - most of the text
    for i, c in enumerate(pattern):
        left, now = far, []
        for k, j in enumerate(range(i - most, i + most + 1)):  # j: the text's character that meets c
            best = left + 1
            if 0 <= j < n and (x := band[k] + (text[j] != c)) < best:
                best = x
            if k < 2 * most and j + 1 <= n and (x := band[k + 1] + 1) < best:
                best = x
            if j + 1 < 0 or j >= n:
                best = far
            now.append(best)
            left = best
        if min(now) > most:
            return None
        band = now
    return band


def begins_like(pattern: str, text: str, most: int) -> bool:
    """Whether some beginning of `text` is within `most` edits of `pattern`; only the diagonals within `most` are computed."""
    if text.startswith(pattern):
        return True
    band = _edits(pattern, text, most)
    return band is not None and min(band) <= most


def alike(a: str, b: str) -> bool:
    """Whether two keys are repetitions of each other: few letters differ."""
    most = int(REPEATS * max(len(a), len(b)))
    if a == b or abs(len(a) - len(b)) > most:
        return a == b
    band = _edits(a, b, most)
    return band is not None and band[len(b) - len(a) + most] <= most


def pairs(k: str) -> set[str]:
    return set(map(str.__add__, k, k[1:]))


class Head:
    """A running head that is known."""

    def __init__(self, text: str):
        self.text, self.pairs = text, pairs(text)

    def repeats(self, line: str, own: set[str]) -> bool:
        """Whether a line (own: its pairs of letters) is this head, whole with a few words beside it, or cut off at its end."""
        head = self.text
        if len(head) < (1 - BESIDES) * len(line) or len(own & self.pairs) < (1 - 2.5 * DIFFERS) * min(len(own), len(self.pairs)):
            return False
        if len(line) < len(head) and len(line) >= 2 * LEAST and begins_like(line, head, int(DIFFERS * len(line))):
            return True
        most = int(DIFFERS * len(head))
        starts = [0, *(m.end() for m in re.finditer(" ", line))]
        return any(begins_like(head, line[at:], most) for at in starts if len(line) - at >= len(head) - most)


def known_heads(title: str | None, document: str | None, opening: str | None) -> list[Head]:
    """What the record's own facts say that its pages carry. opening: the beginning of its text, with the section's heading."""
    heading = HEADING.search(opening or "")
    facts = (title, heading[1] if heading else None, re.sub(r",\s*\d{4}$", "", document) if document else None)
    return [Head(k) for k in dict.fromkeys(key(f) for f in facts if f) if len(k) >= LEAST]


def halves(k: str) -> tuple[str, str]:
    return "<" + k[:HALF], ">" + k[-HALF:]


class Page:
    """The lines of a text, or of a range of it, and their marks."""

    def __init__(self, text: str, page: int | None, end_page: int | None, heads: Iterable[Head] = (), continued: Iterable[int] | None = None, begins: bool = True, ends: bool = True, seen: dict[str, tuple[str, bool]] | None = None):
        """heads: known running heads. continued: numbers on lines of their own that go on elsewhere in the text (None: look in this text).
        begins, ends: whether the text's own beginning and end are here; if not, a line may be cut there and counts for nothing. The text's
        end is where the section ends, which is no page's edge. seen: keys of lines, and whether these are known heads; kept between ranges."""
        self.text, self.spans, self.page, self.end_page, self.begins = text, lines(text), page, end_page, begins
        self.words = [text[a:b].strip() for a, b in self.spans]
        self.full = [i for i, s in enumerate(self.words) if s and (begins or i) and (ends or i + 1 < len(self.spans))]
        self.place = {i: k for k, i in enumerate(self.full)}
        self.marks: list[str | None] = [None] * len(self.spans)
        self.heads = list(heads)
        self.keys: dict[int, str] = {}
        seen = {} if seen is None else seen
        for i in self.full:
            line = self.words[i]
            if line not in seen:
                seen[line] = self._judge(line)
            k, known = seen[line]
            if k:
                self.keys[i] = k
                if known:
                    self.marks[i] = "header"
        self.numbers = {i: n for i in self.full if len(self.words[i]) <= LONGEST and (n := number(self.words[i])) is not None}
        if continued is None:
            bare = {n for i, n in self.numbers.items() if self.bare(i)}
            continued = {n for n in bare if n - 1 in bare or n + 1 in bare}
        self._number_pages(set(continued))

    def _judge(self, line: str) -> tuple[str, bool]:
        """A line's key, empty if it can't be a head; and whether a known head says it."""
        k = key(line) if len(line) <= LONGEST and not NUMBERED.match(line) else ""
        if len(k) < LEAST:
            return "", False
        heads = [h for h in self.heads if len(h.text) >= (1 - BESIDES) * len(k)]
        own = pairs(k) if heads else set()
        return k, any(h.repeats(k, own) for h in heads)

    def _near(self, i: int, step: int) -> Iterator[int]:
        """Lines with text before or after line i, the nearest first, within REACH."""
        k = self.place[i] + step
        while 0 <= k < len(self.full):
            j = self.full[k]
            if (self.spans[i][0] - self.spans[j][1] if step < 0 else self.spans[j][0] - self.spans[i][1]) > REACH:
                return
            yield j
            k += step

    def bare(self, i: int) -> bool:
        a, b = self.spans[i]
        return self.words[i].isdigit() and b - a - len(self.text[a:b].lstrip()) < CENTRED

    def _number_pages(self, continued: set[int]) -> None:
        """A bare number is the page's only if it lies within the record's pages; without known pages it must stand next to a running head or
        go on in another such line. A bare number on the line after a value's label is the value."""
        last = self.end_page if self.end_page is not None else self.page
        found = []
        for i, n in self.numbers.items():
            bare = self.bare(i)
            before = next(self._near(i, -1), None)
            if bare and before is not None and VALUE_LABEL.match(self.words[before]):
                continue
            if self.page is not None:
                right = self.page - (not bare) <= n <= last + (not bare)
            else:
                right = not bare or n in continued or any(self.marks[j] == "header" for way in (-1, 1) for j in list(self._near(i, way))[:1])
            if right:
                found.append(i)
        for i in found:
            self.marks[i] = "pagenum"

    def edges(self) -> dict[int, set[str]]:
        """Lines at page edges that may be running heads and aren't known as such, with the edges ('top', 'foot') that they are next to."""
        at: dict[int, set[str]] = {}
        if self.full and self.begins and self.marks[self.full[0]] is None:
            at[self.full[0]] = {"top"}
        for i in self.full:
            if self.marks[i]:
                for way, side in ((-1, "foot"), (1, "top")):
                    j = next((j for j in self._near(i, way) if self.marks[j] is None), None)
                    if j is not None:
                        at.setdefault(j, set()).add(side)
        return {i: sides for i, sides in sorted(at.items()) if i in self.keys and self.words[i][-1] not in ".,;:"}

    def repeated(self) -> set[str]:
        """Keys that repeat here on at least half of the pages' tops, or feet."""
        out: set[str] = set()
        pages = 1 + sum(m == "pagenum" for m in self.marks)
        edges = self.edges()
        for side in ("top", "foot"):
            met: dict[str, list[str]] = {}
            for i, sides in edges.items():
                if side in sides:
                    for h in halves(self.keys[i]):
                        met.setdefault(h, []).append(self.keys[i])
            for same in met.values():
                alone = [k for k in same if alike(k, same[0])]
                if len(alone) > 1 and 2 * len(alone) >= pages:
                    out |= set(alone)
        return out

    def mark_heads(self, running: Iterable[str]) -> Page:
        """Marks the edge lines that repeat given keys."""
        running = list(running)
        for i in self.edges():
            if any(alike(self.keys[i], r) for r in running):
                self.marks[i] = "header"
        return self
