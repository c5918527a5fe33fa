"""Near spellings of a lexicon's terms as the terms.

The lexicon is a table, by first letter and by how many words a window of the text may have; a text's windows look their terms up there, and
what lengths rule out is never compared. Edits are counted bit-parallel, a whole column of the comparison in one integer.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from lexloom.functions import words

TOKEN = re.compile(r"[A-Za-z]+|\d+")
#: Letters of a one-word term, and of what was heard, at least.
LONG, HEARD = 8, 7


def letters(text: str) -> str:
    return re.sub("[^a-z]", "", text.lower())


def consonants(text: str) -> str:
    return re.sub("[aeiouy]", "", letters(text))


def edits(a: str, b: str) -> int:
    """Least number of insertions, deletions and substitutions (Myers' bit vectors)."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    last, up, down, out = 1 << len(a) - 1, every, 0, len(a)
    for c in b:
        same = where.get(c, 0)
        level = same | down
        across = ((same & up) + up ^ up) | same
        rise, fall = down | every & ~(across | up), up & across
        out += bool(rise & last) - bool(fall & last)
        rise, fall = (rise << 1 | 1) & every, fall << 1 & every
        up, down = fall | every & ~(level | rise), rise & level
    return out


@dataclass(frozen=True)
class Term:
    text: str
    place: int
    letters: str
    consonants: str
    least: float

    def near(self, heard: str) -> bool:
        """Whether letters or consonants are similar enough."""
        return self._similar(self.letters, letters(heard)) or self._similar(self.consonants, consonants(heard))

    def _similar(self, a: str, b: str) -> bool:
        longest = max(len(a), len(b))
        room = longest * (1 - self.least) + 1e-9
        return abs(len(a) - len(b)) <= room and edits(a, b) <= room


@lru_cache(16)
def table(lexicon: tuple[str, ...]) -> dict[tuple[str, int], list[tuple[int, Term]]]:
    """Terms by first letter and window size; with each, which choice that size is for it: its own number of words, one more, one less."""
    out: dict[tuple[str, int], list[tuple[int, Term]]] = {}
    for place, text in enumerate(lexicon):
        n, own = len(text.split()), letters(text)
        if n == 1 and len(own) < LONG:
            continue
        term = Term(text, place, own, consonants(text), 0.86 if n == 1 else 0.72 if len(own) >= 18 else 0.82)
        for choice, size in enumerate((n, n + 1, n - 1)):
            if size:
                out.setdefault((own[0], size), []).append((choice, term))
    return out


def windows(text: str, sizes: set[int]):
    """(start, end, first word, words) of every run of so many words that only spaces or hyphens part."""
    found = list(TOKEN.finditer(text))
    joined = [bool(re.fullmatch(r"[\s-]+", text[a.end() : b.start()])) and not b[0].isdigit() for a, b in zip(found, found[1:])] + [False]
    for i, m in enumerate(found):
        n = 0 if m[0].isdigit() else 1
        while n:
            if n in sizes:
                yield m.start(), found[i + n - 1].end(), i, n
            n = n + 1 if joined[i + n - 1] and n < max(sizes) else 0


def lexicon_repair(text: str, lexicon: tuple[str, ...] = words.LEXICON) -> tuple[str, list[tuple[str, str, str]]]:
    """The text, and a log of (kind, from, to). Each word is used at most once: earlier terms first, then their own number of words, then the place."""
    terms = table(tuple(lexicon))
    sizes = {size for _, size in terms}
    near = []
    for a, b, first, n in windows(text, sizes) if sizes else ():
        heard = text[a:b]
        for choice, term in terms.get((heard[0].lower(), n), ()):
            same = heard.lower() == term.text.lower()
            if same or len(letters(heard)) >= HEARD and term.near(heard):
                near.append((term.place, choice, first, n, a, b, None if same else term.text))
    used: set[int] = set()
    kept = []
    for _, _, first, n, a, b, to in sorted(near, key=lambda x: x[:4]):
        own = set(range(first, first + n))
        if not used & own:
            used |= own
            if to is not None:
                kept.append((a, b, to))
    out, log, at = [], [], 0
    for a, b, to in sorted(kept):
        out += [text[at:a], to]
        log.append(("lexicon", text[a:b], to))
        at = b
    return "".join([*out, text[at:]]), log
