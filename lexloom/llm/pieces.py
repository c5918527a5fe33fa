"""Problem 2: cutting items larger than a limit into overlapping pieces at natural boundaries.

Byte-range processing: every text over the limit, a row of a table or a file that is never loaded whole, is taken in ranges with halos on both
sides. A worker finds the boundaries of its own range; whatever decides on a boundary stands within the halo. How the pieces run through a
range depends only on where the first one enters it, so a worker notes for every place of entry where the last piece leaves and how many there
are. These tables are stitched from range to range, the counts are summed into piece numbers, and every range emits its pieces by offset. The
result doesn't depend on the ranges' size. The ranges of a row, which Parquet reads whole, stay in the row's task; those of a file are spread over
the cluster and meet only by their tables.

Boundaries, best first: a unit of the section (numbered sub-section after the first, proviso, explanation, exception, block of
illustrations), a sentence, white space, any character. Defined results: null and empty texts give no piece; texts up to the limit are one
piece; repeated rows are cut each for itself; an empty table gives an empty table.
"""

from __future__ import annotations

import difflib
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm import base, pages
from lexloom.llm.uniform import fold_column, fold_text

LIMIT, OVERLAP = 1500, 150
#: Characters of a text's beginning in which its section's heading is looked for.
OPENING = 400
#: Characters of a table's text in a range: as many as the limit, so that every text over it has several. Bytes of a file in a range.
RANGE, FILE_RANGE = LIMIT, 1 << 18
#: What decides on a boundary stands within so many characters of it; in a scan, where lines that the page added lie between, within more.
CONTEXT, SCAN_CONTEXT = 128, 1024
#: Characters over which the parts of a unit's number or label, and what stands before and after it, may be spread in a scan; and without page lines.
SPREAD, LOOK = 320, 64

# The words that open a unit.
OPENERS = ("provided", "explanation", "exception", "illustration", "illustrations")
NUMBERED = regex.compile(r"[(\[]?(?<![\w.\-,])(\d{1,3})[)\]](?=\s{0,32}[\p{Lu}\"“‘(])")
WORD = regex.compile(r"(?<![\w\-])\p{Lu}[\p{L}\d']{6,13}(?![\w\-])")
#: What makes a number a mere reference; what follows the opener of a proviso, and of other units.
REFERENCE = regex.compile(r"(?i)\bsecs?\.$|\bnos?\.$|\brs\.$|sub-?\s?section$|section$|clause$")
PROVISO = regex.compile(r"\s+(?:(?:fur\w+|fu\w+er|al\w{1,2}|\w{4,7})\s+)?t\w{1,4}t\b|\s+\w{3,8}\s+\w{3,5}\b")
LABELLED = regex.compile(r"\s*\d{0,3}\s*[.:]?\s*[-—–]|\s*\d{0,3}\s*[.:]\s*[-—–]?")
SENTENCE = regex.compile(r"[.!?।॥۔。！？]['\"”’」』)\]]*\s+(?=\S)")
#: A line that gives only a value, as after "Number of entries:".
VALUE_LINE = regex.compile(r"\n\s*\d[\d,.]*\s*\n\s*$")
SPACE = regex.compile(r"(?<=\s)(?=\S)")


def compact(plain: str, source: np.ndarray, page: pages.Page | None) -> tuple[str, np.ndarray]:
    """A text in uniform characters as it reads: a scan without the lines that its pages added and without line-end hyphens. And each character's place."""
    if page is None:
        return plain, source
    body = [(a, b) for k, (a, b) in enumerate(page.spans) if page.marks[k] is None and page.words[k]]
    out, place = [], []
    for k, (a, b) in enumerate(body):
        end = a + len(plain[a:b].rstrip())
        joined = end - a > 1 and plain[end - 1] in pages.HYPHENS and plain[end - 2].isalpha() and k + 1 < len(body) and plain[body[k + 1][0] : body[k + 1][1]].lstrip()[:1].isalpha()
        if joined:
            end -= 1
        skip = len(plain[a:end]) - len(plain[a:end].lstrip())
        out.append(plain[a + skip : end])
        place.append(source[a + skip : end])
        if not joined:
            out.append("\n")
            place.append(source[min(end, len(source) - 1) :][:1])
    return "".join(out), np.concatenate([*place, np.zeros(0, np.int64)]).astype(np.int64)


@lru_cache(1 << 14)
def _opens(word: str) -> str | None:
    """Which opener a word is, if it is one but for a few misread letters."""
    low = word.lower()
    for opener in OPENERS:
        if low == opener:
            return opener
    if len(low) >= 7:
        for opener in OPENERS:
            if abs(len(low) - len(opener)) <= 2 and difflib.SequenceMatcher(None, low, opener, autojunk=False).ratio() >= 0.8:
                return opener
    return None


def unit_starts(text: str, place: np.ndarray | None = None) -> list[int]:
    """Places where a unit of the section begins in a compact text. What stands further off than LOOK characters here, or SPREAD in the text as stored, decides nothing."""
    place = np.arange(len(text)) if place is None else place
    out = []

    def near(at: int, to: int, of: int) -> str:
        """text[at:to] as far as it lies within SPREAD of the character `of`."""
        at, to = max(at, 0), min(to, len(text))
        if to > at and abs(int(place[at]) - int(place[of])) > SPREAD:
            at = max(at, bisect_left(place, place[of] - SPREAD))
        if to > at and abs(int(place[to - 1]) - int(place[of])) > SPREAD:
            to = min(to, bisect_right(place, place[of] + SPREAD))
        return text[at:to]

    for m in NUMBERED.finditer(text):
        if int(m[1]) < 2 or not near(m.end(), m.end() + 33, m.start()).strip():
            continue
        leading = near(m.start() - LOOK, m.start(), m.start())
        before = leading.rstrip()[-12:]
        if (before[-1:] in (".", ":", ";", "!", "?", "—", '"', "”", ")", "]") or VALUE_LINE.search(leading[-24:])) and not REFERENCE.search(before):
            out.append(m.start())
    for m in WORD.finditer(text):
        opener = _opens(m[0])
        if opener is None or len(near(m.start(), m.end(), m.start())) < len(m[0]):
            continue
        before = near(m.start() - LOOK, m.start(), m.start()).rstrip()[-1:]
        after = near(m.end(), m.end() + 24, m.start())
        if before and before not in ".:;!?—\"”)]":
            continue
        if opener == "provided":
            if PROVISO.match(after):
                out.append(m.start())
        elif LABELLED.match(after):
            out.append(m.start())
    return [int(place[k]) for k in sorted(set(out))]


def starts_in(text: str, page=None, end_page=None, title=None, document=None, scanned=False) -> list[int]:
    """Unit starts of a whole text, by place in it as stored."""
    plain, source = fold_text(text)
    return unit_starts(*compact(plain, source, Scan(plain, page, end_page, title, document).page if scanned else None))


class Scan:
    """What relates a scan's pages to each other: heads that are known or repeat, numbers that go on."""

    def __init__(self, plain: str, page: int | None, end_page: int | None, title: str | None, document: str | None):
        self.facts = (page, end_page, pages.known_heads(title, document, plain[:OPENING]))
        self.seen: dict[str, tuple[str, bool]] = {}
        self.page = pages.Page(plain, *self.facts, seen=self.seen)
        bare = {n for k, n in self.page.numbers.items() if self.page.bare(k)} if page is None else set()
        self.continued = {n for n in bare if n - 1 in bare or n + 1 in bare}
        self.running = self.page.repeated()
        self.page.mark_heads(self.running)

    def part(self, plain: str, begins: bool, ends: bool) -> pages.Page:
        """The lines of a range."""
        return pages.Page(plain, *self.facts, self.continued, begins, ends, self.seen).mark_heads(self.running)


class Cutter:
    """Chooses cuts in a body of text; `units` are places of unit starts in it."""

    def __init__(self, body: str, units: list[int], limit: int, overlap: int):
        self.body, self.limit, self.overlap = body, limit, overlap
        self.spaces = [m.start() for m in SPACE.finditer(body)]
        self.levels = [units, [m.end() for m in SENTENCE.finditer(body)], self.spaces]

    def following(self, at: int) -> int:
        """Where a piece that begins at a place ends: of the best kind of boundary that there is, the last within the limit."""
        low, high = at + self.overlap, at + self.limit
        if high >= len(self.body):
            return len(self.body)
        for level in self.levels:
            k = bisect_right(level, high)
            if k and level[k - 1] > low:
                return level[k - 1]
        return high

    def entries(self, begin: int, end: int) -> list[int]:
        """Places in [begin, end) where the first piece of a range can begin whose text before it is cut elsewhere: all that a boundary allows, and all within a stretch without any."""
        end = min(end, begin + self.limit - self.overlap)
        near = {b - self.overlap for level in self.levels for b in level[bisect_left(level, begin + self.overlap) : bisect_left(level, end + self.overlap)]}
        places = np.arange(begin, max(begin, end))
        spaces = np.array([-1 << 40, *self.spaces])
        last = spaces[np.searchsorted(spaces, places + self.overlap, "right") - 1]
        free = last <= np.maximum(places - self.limit + 2 * self.overlap, 0)
        return sorted(near | set(places[free].tolist()))

    def through(self, begins: list[int], end: int) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
        """For each place of entry, where the first piece beyond `end` begins (or the text's length) and how many pieces begin before; and the ends of all pieces on these ways."""
        known: dict[int, tuple[int, int]] = {}
        ends: dict[int, int] = {}
        for first in begins:
            way, at = [], first
            while at < end and at not in known:
                ends[at] = to = self.following(at)
                way.append(at)
                at = to - self.overlap if to < len(self.body) else len(self.body)
            leave, n = known.get(at, (at, 0))
            for place in reversed(way):
                n += 1
                known[place] = (leave, n)
        return {b: known[b] for b in begins if b in known}, ends


def pieces_of(text: str, units: list[int], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces of a whole text, one after the other."""
    cutter, at, out = Cutter(text, units, limit, overlap), 0, []
    while at < len(text):
        to = cutter.following(at)
        out.append((at, to))
        at = to - overlap if to < len(text) else to
    return out


#: What the record may say of a scan.
FACTS = {"page": "int", "end_page": "int", "title": "string", "document": "string", "scanned": "boolean"}
#: A range's table: for places of entry, where the last piece leaves and how many pieces there are; and the pieces on all these ways.
TABLE = ("enter", "leave", "many", "starts", "until")


def _table(body: str, units: list[int], lead: int, size: int, offset: int, limit: int, overlap: int) -> dict[str, list[int]]:
    cutter = Cutter(body, units, limit, overlap)
    begins = [0] if offset == 0 else cutter.entries(lead, lead + size)
    ways, ends = cutter.through(begins, lead + size)
    whole = offset - lead
    return dict(zip(TABLE, ([whole + b for b in ways], [whole + leave for leave, _ in ways.values()], [n for _, n in ways.values()], [whole + b for b in ends], [whole + e for e in ends.values()])))


def stitch(parts: list[dict]) -> list[tuple[int, int, int]]:
    """From range to range of a text: (index of a range, where its first piece begins, how many pieces there are before). A range that a piece spans has none."""
    at, before, out = 0, 0, []
    for no, part in enumerate(parts):
        enter = part["enter"]
        k = bisect_left(enter, at)
        if k < len(enter) and enter[k] == at:
            out.append((no, at, before))
            at, before = part["leave"][k], before + part["many"][k]
        elif k < len(enter):
            raise RuntimeError(f"a piece begins at {at}, where none can")
    return out


def follow(part: dict, first: int, before: int, overlap: int) -> list[tuple[int, int, int]]:
    """(number, start, end) of the pieces of a range on the way from its place of entry."""
    ends, at, out = dict(zip(part["starts"], part["until"])), first, []
    for no in range(before, before + part["many"][bisect_left(part["enter"], first)]):
        out.append((no, at, ends[at]))
        at = ends[at] - overlap
    return out


def ranges_of(n: int, size: int, context: int, tail: int) -> list[tuple[int, int, int, bool]]:
    """(offset, characters of halo before, end of the halo behind, whether that is the text's end) of each range of n characters."""
    return [(at, min(context, at), min(n, at + size + context + tail), at + size + context + tail >= n) for at in range(0, n, size)]


def _texts(df: DataFrame, row_id: str, text: str, facts: dict[str, str]) -> DataFrame:
    """The columns that a worker needs; facts name the columns of title, document, page, end_page and scanned, or leave them out."""
    own = df.select(F.col(row_id).alias("row_key"), F.col(text).cast("string").alias("t"), *((F.expr(facts[k]) if k in facts else F.lit(None)).cast(kind).alias(k) for k, kind in FACTS.items()))
    return own.where("t is not null and t <> ''")


def _bodies(batch: pa.RecordBatch, size: int, tail: int):
    """(row, text, offset, lead, body, units in the body) of every range of every text; the bodies of a slice of texts are folded together."""
    texts = batch.column(1).to_pylist()
    rows = list(zip(*(batch.column(n).to_pylist() for n in ("page", "end_page", "title", "document", "scanned"))))
    scanned = [i for i, r in enumerate(rows) if r[4]]
    scans = {i: Scan(plain, *rows[i][:4]) for i, plain in zip(scanned, fold_column(batch.column(1).take(pa.array(scanned, pa.int64())))[0])} if scanned else {}
    cuts = [(i, *r) for i, t in enumerate(texts) for r in ranges_of(len(t), size, SCAN_CONTEXT if i in scans else CONTEXT, tail)]
    bodies = [texts[i][at - lead : to] for i, at, lead, to, _ in cuts]
    for (i, at, lead, _, ends), body, plain, source in zip(cuts, bodies, *fold_column(pa.array(bodies, pa.string()))):
        page = scans[i].part(plain, at == lead, ends) if i in scans else None
        yield i, texts[i], at, lead, body, unit_starts(*compact(plain, source, page))


def _units(size: int):
    def work(batches):
        for batch in base.slices(batches, 1):
            keys, starts = [], []
            for i, text, at, lead, _, units in _bodies(batch, size, 0):
                own = [at + u - lead for u in units if lead <= u < lead + min(size, len(text) - at)]
                keys += [i] * len(own)
                starts += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(starts, pa.int32())], ["row_key", "start_char"])

    return work


def _spans(size: int, limit: int, overlap: int):
    def work(batches):
        for batch in base.slices(batches, 1):
            parts: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, text, at, lead, body, units in _bodies(batch, size, limit):
                parts[i].append(_table(body, units, lead, min(size, len(text) - at), at, limit, overlap))
            found = [(i, *span) for i, own in enumerate(parts) for no, first, before in stitch(own) for span in follow(own[no], first, before, overlap)]
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int32()) for c in columns[1:])], ["row_key", "piece_no", "start_char", "end_char"])

    return work


def unit_table(df: DataFrame, row_id: str, text: str, facts: dict[str, str], limit: int = LIMIT, size: int = RANGE) -> DataFrame:
    """`row_id`, `start_char` of every unit in texts over the limit, which are read in ranges of `size` characters."""
    own = base.spread(_texts(df, row_id, text, facts).where(F.length("t") > limit))
    out = base.map_arrow(own, _units(size), f"row_key {own.schema['row_key'].dataType.simpleString()}, start_char int")
    return out.select(F.col("row_key").alias(row_id), "start_char").distinct()


def pieces(df: DataFrame, row_id: str, text: str, facts: dict[str, str], limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """`row_id`, `piece_no`, `start_char`, `end_char` of every piece of every non-empty text; join by `row_id` for whatever the record keeps."""
    own = base.spread(_texts(df, row_id, text, facts))
    schema = f"row_key {own.schema['row_key'].dataType.simpleString()}, piece_no int, start_char int, end_char int"
    short = own.where(F.length("t") <= limit).select("row_key", F.lit(0).alias("piece_no"), F.lit(0).alias("start_char"), F.length("t").alias("end_char"))
    return short.unionAll(base.map_arrow(own.where(F.length("t") > limit), _spans(size, limit, overlap), schema)).withColumnRenamed("row_key", row_id)


def _opened(path: str):
    """A file on whatever storage its address names."""
    from pyarrow import fs

    if "://" not in path:
        path = "file://" + path
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner


def _read_range(path: str, begin: int, end: int, lead: int, tail: int) -> tuple[str, int, int]:
    """Body with halos, characters before the range's own, and its own characters. A character belongs to the range of its first byte."""
    system, inner = _opened(path)
    at = max(0, begin - 4 * lead)
    with system.open_input_file(inner) as f:
        f.seek(at)
        raw = f.read(end - at + 4 * tail)
    heads = lambda k: next((i for i in range(k, min(k + 4, len(raw))) if raw[i] & 0xC0 != 0x80), len(raw))
    first, own, to = heads(0), heads(begin - at), heads(min(end - at, len(raw)))
    before, body, after = raw[first:own].decode("utf-8", "replace"), raw[own:to].decode("utf-8", "replace"), raw[to:].decode("utf-8", "ignore")
    before = before[len(before) - min(lead, len(before)) :]
    return before + body + after[:tail], len(before), len(body)


def _columns(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names)


def file_pieces(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = FILE_RANGE) -> DataFrame:
    """`path`, `piece_no`, `start_char`, `end_char`, `piece` of UTF-8 files on storage that all workers see. No file is loaded whole.

    First pass: characters per range; these are prefix-summed. Second: every range's table; these are stitched, one small table per range.
    Third: the pieces, by offset.
    """
    long, longs, string = pa.int64(), pa.list_(pa.int64()), pa.string()

    def sized(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield _columns([(n, system.get_file_info(inner).size) for n, (system, inner) in zip(names, map(_opened, names))], [string, long], ["path", "bytes"])

    def count(batches):
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            yield _columns([(*r, _read_range(r[0], r[2], r[3], 0, 0)[2]) for r in rows], [string, pa.int32(), long, long, long], ["path", "range_no", "begin", "end", "chars"])

    def tables(batches):
        for batch in batches:
            out = []
            for path, no, begin, end, offset in zip(*(c.to_pylist() for c in batch.columns)):
                body, lead, size = _read_range(path, begin, end, CONTEXT, limit + CONTEXT)
                out.append((path, no, *_table(body, unit_starts(*fold_text(body)), lead, size, offset, limit, overlap).values()))
            yield _columns(out, [string, pa.int32(), *[longs] * 5], ["path", "range_no", *TABLE])

    def ways(batches):
        for batch in batches:
            out = []
            for path, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts.sort(key=lambda p: p["range_no"])
                out += [(path, parts[k]["range_no"], first, before) for k, first, before in stitch(parts)]
            yield _columns(out, [string, pa.int32(), long, long], ["path", "range_no", "first", "before"])

    def emit(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                body, lead, _ = _read_range(r["path"], r["begin"], r["end"], 0, limit)
                out += [(r["path"], no, a, b, body[a - r["offset"] + lead : b - r["offset"] + lead]) for no, a, b in follow(r, r["first"], r["before"], overlap)]
            yield _columns(out, [string, long, long, long, string], ["path", "piece_no", "start_char", "end_char", "piece"])

    names = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string")
    sizes = base.map_arrow(names, sized, "path string, bytes long").where("bytes > 0")
    ranges = sizes.select("path", "bytes", F.explode(F.sequence(F.lit(0), ((F.col("bytes") - 1) / range_bytes).cast("int"))).alias("range_no"))
    ranges = ranges.select("path", "range_no", (F.col("range_no").cast("long") * range_bytes).alias("begin"), F.least(F.col("bytes"), (F.col("range_no").cast("long") + 1) * range_bytes).alias("end")).repartition("path", "range_no")
    counted = base.cut(base.map_arrow(ranges, count, "path string, range_no int, begin long, end long, chars long"))
    before = Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.select("path", "range_no", "begin", "end", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("offset")).repartition("path", "range_no")
    own = base.cut(base.map_arrow(placed, tables, "path string, range_no int, " + ", ".join(f"{c} array<long>" for c in TABLE)))
    by = own.groupBy("path").agg(F.collect_list(F.struct("range_no", "enter", "leave", "many")).alias("parts"))
    entered = base.map_arrow(by, ways, "path string, range_no int, first long, before long")
    met = placed.join(own, ["path", "range_no"]).join(entered, ["path", "range_no"])
    return base.map_arrow(met, emit, "path string, piece_no long, start_char long, end_char long, piece string")
