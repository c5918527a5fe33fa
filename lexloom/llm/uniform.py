"""Problem 5: text that looks the same but is stored in different characters.

Arrow text is copied to one array of code points; folding is a gather from lookup tables, with expansion offsets where one character
becomes several; marks are put in canonical order and composed with array operations. No string function is called per row.

Joiners between letters (U+200C, U+200D) are dropped with the other invisible characters, as the cases of this problem have it; in scripts where they
change a letter's shape two such texts become one form.

Defined results: null stays null; an empty text and a text of invisible characters become empty; very long texts are one row like any
other; repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import base

# Letters of other scripts that are drawn like Latin ones, and the Latin letters in the same order.
LIKE = "АВЕЅІЈКМНОРСТУХаеорсухіјѕһԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον" "ɑɡ" "ՕՍօսհո" "ᎪᎠᎡᎢᎬᎫᎳᎷᎻᏀᏃᏚᏞᏟᏢᏦᏴ"
LATIN = "ABESIJKMHOPCTYXaeopcyxijshdqw" "ABEZHIKMNOPTYXov" "ag" "OUouhn" "ADRTEJWMHGZSLCPKB"
# Spaces that differ from U+0020 in width or in breaking only.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Beyond these the formatting characters (category Cf) and variation selectors are dropped as invisible.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
#: Compatibility forms that read as their plain characters: mathematical letters, ligatures, presentation forms, wide and narrow forms, Roman numerals.
PLAIN_BLOCKS = ((0x1D400, 0x1D800), (0xFB00, 0xFB50), (0xFB50, 0xFE00), (0xFE70, 0xFF00), (0xFF00, 0xFFF0), (0x2160, 0x2180), (0x01C4, 0x01CD), (0x01F1, 0x01F4), (0x0E33, 0x0E34), (0x0EB3, 0x0EB4))
TOP = 0x110000


def _plain(ch: str) -> str:
    """What a single character reads as, decomposed."""
    point = ord(ch)
    if ch in SPACES:
        return " "
    if ch in INVISIBLE or 0xFE00 <= point < 0xFE10 or 0xE0100 <= point < 0xE01F0 or unicodedata.category(ch) == "Cf":
        return ""
    if any(a <= point < b for a, b in PLAIN_BLOCKS):
        ch = unicodedata.normalize("NFKD", ch)
        if ch[:1] == " " and len(ch) > 1:  # a spacing form of a mark stays what it is
            return chr(point)
    out = unicodedata.normalize("NFD", ch)
    return out.translate(_letters())


@lru_cache(1)
def _letters() -> dict[int, str]:
    return {ord(a): b for a, b in zip(LIKE, LATIN, strict=True)}


@lru_cache(1)
def tables() -> dict[str, np.ndarray]:
    """Lookup tables by code point, made from the Unicode database once a process.

    start, length: where in `data` the folded characters of a code point lie; order: combining class; pairs, composed: canonical
    compositions, sorted by first << 21 | second.
    """
    start, length, data = np.arange(TOP, dtype=np.int32), np.ones(TOP, np.uint8), [np.arange(TOP, dtype=np.uint32)]
    order = np.zeros(TOP, np.uint8)
    at, pairs = TOP, {}
    for point in range(TOP):
        if 0x3400 <= point < 0xA000 or 0xD800 <= point < 0xF900 or 0x20000 <= point < 0x2F800 or 0x30000 <= point < 0xE0000 or point >= 0xE0200:
            continue
        ch = chr(point)
        order[point] = unicodedata.combining(ch)
        parts = unicodedata.decomposition(ch)
        if 0xAC00 <= point < 0xD7A4 or parts and parts[0] != "<":
            short = [int(x, 16) for x in parts.split()] if parts else [point - (point - 0xAC00) % 28, 0x11A7 + (point - 0xAC00) % 28] if (point - 0xAC00) % 28 else [0x1100 + (point - 0xAC00) // 588, 0x1161 + (point - 0xAC00) % 588 // 28]
            if len(short) == 2 and unicodedata.normalize("NFC", ch) == ch:
                pairs[short[0] << 21 | short[1]] = point
        out = _plain(ch)
        if out != ch:
            codes = np.array([ord(x) for x in out], np.uint32)
            start[point], length[point] = at, len(codes)
            data.append(codes)
            at += len(codes)
    keys = np.array(sorted(pairs), np.int64)
    return {"start": start, "length": length, "data": np.concatenate(data), "order": order, "pairs": keys, "composed": np.array([pairs[k] for k in keys.tolist()], np.uint32)}


def _find(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pair composes, and into what."""
    t = tables()
    key = first.astype(np.int64) << 21 | second.astype(np.int64)
    at = np.minimum(np.searchsorted(t["pairs"], key), len(t["pairs"]) - 1)
    return t["pairs"][at] == key, t["composed"][at]


def compose(points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition over all rows at once. row: each point's row. Returns points, and which of the given places they keep."""
    t, n = tables(), len(points)
    keep = np.arange(n)
    if not n:
        return points, keep
    order = t["order"][points]
    first = np.ones(n, bool)
    first[1:] = row[1:] != row[:-1]
    marks = order > 0
    if (marks[1:] & marks[:-1] & ~first[1:] & (order[1:] < order[:-1])).any():
        by = np.lexsort((np.arange(n), np.where(marks, order.astype(np.int16), -1), np.cumsum(~marks | first)))
        points, keep, order = points[by], keep[by], order[by]
    points = points.copy()
    while True:
        stay = _with_marks(points, order, first)
        points, keep, order, first = points[stay], keep[stay], order[stay], first[stay]
        stay = _with_next(points, order, first)
        if stay.all():
            return points, keep
        points, keep, order, first = points[stay], keep[stay], order[stay], first[stay]


def _with_marks(points: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Composes each letter with its marks, in place: step k takes the k-th mark of every letter at once. False for marks taken in."""
    stay = np.ones(len(points), bool)
    starts = np.flatnonzero((order == 0) | first)
    ends = np.append(starts[1:], len(points))
    last, step = np.zeros(len(starts), np.int16), 1  # last: class of the last mark that stayed
    while True:
        more = starts + step < ends
        starts, ends, last = starts[more], ends[more], last[more]
        if not len(starts):
            return stay
        here = starts + step
        fits, made = _find(points[starts], points[here])
        fits &= last < order[here]
        points[starts[fits]] = made[fits]
        stay[here[fits]] = False
        last = np.where(fits, last, order[here].astype(np.int16))
        step += 1


def _with_next(points: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Composes, in place, each letter with a directly following sign of class 0 that joins it. False for signs taken in."""
    stay = np.ones(len(points), bool)
    if len(points) < 2:
        return stay
    fits, made = _find(points[:-1], points[1:])
    at = np.flatnonzero(fits & ~first[1:] & (order[1:] == 0))
    if len(at):  # of pairs that share a letter, the first, third and so on
        lead = np.append(True, np.diff(at) > 1)
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(lead, np.arange(len(at)), 0))
        at = at[place % 2 == 0]
        points[at] = made[at]
        stay[at + 1] = False
    return stay


def fold(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The uniform form of many rows: points, offsets of the rows, and the place in the input from which each point comes."""
    t = tables()
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    size = t["length"][points].astype(np.int64)
    total = int(size.sum())
    if total == len(points) and (size == 1).all():
        source, out = np.arange(total), t["data"][t["start"][points]]
    else:
        source = np.repeat(np.arange(len(points)), size)
        inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        out = t["data"][t["start"][points[source]] + inside]
    row = row[source]
    out, keep = compose(out, row)
    row, source = row[keep], source[keep]
    ends = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(row, minlength=len(offsets) - 1), out=ends[1:])
    return out, ends, source


def fold_text(text: str) -> tuple[str, np.ndarray]:
    """One text's uniform form and, for each of its characters, the place in `text` from which it comes."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out, _, source = fold(points, np.array([0, len(points)]))
    return out.astype("<u4").tobytes().decode("utf-32-le"), source


def fold_column(column: pa.Array) -> tuple[list[str], list[np.ndarray]]:
    """The uniform forms of a slice of texts, folded at once, and each character's place in the text as stored."""
    points, offsets = base.code_points(column)
    out, ends, source = fold(points, offsets)
    whole = out.astype("<u4").tobytes().decode("utf-32-le")
    ends, offsets = ends.tolist(), offsets.tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:])], [source[a:b] - o for a, b, o in zip(ends, ends[1:], offsets)]


def _uniform(batches):
    for batch in base.slices(batches, 0):
        column = batch.column(0)
        points, offsets = base.code_points(column)
        out, ends, _ = fold(points, offsets)
        mask = np.asarray(column.is_null())
        yield pa.RecordBatch.from_arrays([base.strings(out, ends, mask), *batch.columns[1:]], ["uniform_text", *batch.schema.names[1:]])


def uniform(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """`keep` columns and `uniform_text`, the uniform form of column `text`."""
    own = df.select(F.col(text).cast("string").alias("__text"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keep)))
    schema = ", ".join(["uniform_text string", *(f"`__k{i}` {own.schema[f'__k{i}'].dataType.simpleString()}" for i in range(len(keep)))])
    out = base.map_arrow(base.spread(own), _uniform, schema)
    return out.select(*(F.col(f"__k{i}").alias(k) for i, k in enumerate(keep)), "uniform_text")


def classes(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """One row per non-empty text: `row_id`, `class_id` (the least row id whose text reads the same) and `stored` (a digest of the text as it is).

    Texts of one class meet by a digest of their uniform form, so no text is shuffled; the least id is pre-aggregated.
    """
    own = df.select(F.col(row_id).alias("row_id"), F.col(text).cast("string").alias("t")).where("t is not null and t <> ''")
    own = own.select("row_id", "t", F.md5("t").alias("stored"))
    keyed = uniform(own, "t", "row_id", "stored").select("row_id", "stored", F.md5("uniform_text").alias("form"))
    keyed = base.cut(keyed)
    least = keyed.groupBy("form").agg(F.min("row_id").alias("class_id"))
    return keyed.join(least, "form").select("row_id", "class_id", "stored")


def differing_pairs(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """Pairs `id_a` < `id_b` of rows whose texts read the same but are stored differently.

    Forms with a single stored value leave before any row meets another (pre-aggregated), so groups of exact copies cost nothing. The rest
    meets by form and stored value: groups of one form are joined by value first, rows only within pairs of different values.
    """
    own = df.select(F.col(row_id).alias("row_id"), F.col(text).cast("string").alias("t")).where("t is not null and t <> ''")
    own = own.select("row_id", "t", F.md5("t").alias("stored"))
    keyed = base.cut(uniform(own, "t", "row_id", "stored").select("row_id", "stored", F.md5("uniform_text").alias("form")))
    values = keyed.groupBy("form", "stored").agg(F.count("*").alias("n"))
    several = values.groupBy("form").agg(F.count("*").alias("v")).where("v > 1").select("form")
    values = values.join(several, "form").select("form", "stored")
    other = values.select("form", F.col("stored").alias("other"))
    meets = values.join(other, "form").where("stored < other").select("stored", "other")
    a, b = keyed.select(F.col("row_id").alias("a"), "stored"), keyed.select(F.col("row_id").alias("b"), F.col("stored").alias("other"))
    return meets.join(a, "stored").join(b, "other").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
