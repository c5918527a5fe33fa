"""Problem 6: text from scanned pages, repaired into continuous paragraphs.

Headers and footers are lines at page edges that repeat, fuzzily: at other edges of the same record, at the edges of a share of its book's
records, or what the record says its pages carry (`llm.pages`); page-number lines follow the record's pages. Without them, lines are joined
by the corpus's vocabulary: a word cut at a line's end becomes the one of its two spellings that the clean records use more often. A word
is taken for a misreading if undoing one or two misread sequences gives a word that the clean records have RARER times as often; it is
corrected to the commonest such word. Both are rates, so that they hold at any size of the corpus.

Every scan is read once; those whose edges carry a head that only its book's other records tell are read again with it. The vocabulary,
the heads and the corrections are tables that grow with the corpus; they are joined, never broadcast by hand.
Defined results: null and empty texts give no row; a text without lines to remove or words to repair gives itself; repeated rows are repaired each for itself;
without any clean record no word is corrected; an empty table gives an empty table.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import base, pages
from lexloom.llm.uniform import fold_column

WORD = regex.compile(r"[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}]|'I'|'i'|['’](?=\p{L}{2}))*(?:-(?:[\p{L}\p{M}\p{N}]|'I'|'i')+)*|'[Ii]'[\p{L}\p{M}\p{N}]+(?:-[\p{L}\p{M}\p{N}]+)*")
#: What a word can have been misread from: letters, with hyphens and apostrophes inside.
PLAIN = regex.compile(r"\p{L}+(?:[-'’]\p{L}+)*")
#: A misreading is at least so many times rarer in clean records than the word it stands for; a word that none has counts as a quarter of one.
RARER, NONE = 8, 0.25
#: A running head stands at the edges of at least this share of its book's records, and of two.
SHARE = 0.05


def _vocabulary_rows(batches):
    """Distinct words of each clean text."""
    for batch in base.slices(batches, 0):
        out = []
        for text in fold_column(batch.column(0))[0]:
            out += set(WORD.findall(text.lower()))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["word"])


def vocabulary(clean: DataFrame, text: str) -> DataFrame:
    """`word`, `n` (rows that have it) of clean texts."""
    own = base.spread(clean.select(F.col(text).cast("string").alias("t")).where("t is not null and t <> ''"))
    return base.map_arrow(own, _vocabulary_rows, "word string").groupBy("word").agg(F.count("*").alias("n"))


def undone(word: str) -> dict[str, int]:
    """Words that `word` may be misread from: one or two misread sequences undone, with how many."""
    out: dict[str, int] = {}
    for step, sources in ((1, [word]), (2, None)):
        for w in sources or [w for w, k in out.items() if k == 1]:
            for seen, meant in pages.MISREAD:
                at = w.find(seen)
                while at >= 0:
                    out.setdefault(w[:at] + meant + w[at + len(seen) :], step)
                    at = w.find(seen, at + 1)
    return {w: k for w, k in out.items() if w != word and k < len(word) and PLAIN.fullmatch(w)}


def _reads(batches):
    """Per row: furniture lines, cut words and words, and edge lines that may be heads. kind: header, pagenum, cut (left and right part), word, edge (key and book)."""
    for batch in base.slices(batches, 1):
        out: tuple[list, ...] = ([], [], [], [])
        for key, text, page, end, title, document, running in zip(batch.column(0).to_pylist(), *(c.to_pylist() for c in batch.columns[1:])):
            own = marked(text, page, end, title, document, running)
            found = {(m, own.words[i], "") for i, m in enumerate(own.marks) if m}
            words, cuts = read_words(text, own.spans, own.marks)
            found |= {("cut", left, right) for left, right in cuts} | {("word", w, "") for w in words}
            found |= {("edge", own.keys[i], document or "") for i in own.edges()}
            for kind, item, right in found:
                for column, value in zip(out, (key, kind, item, right)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), *(pa.array(c, pa.string()) for c in out[1:])], ["row_key", "kind", "item", "rest"])


def marked(text, page, end, title, document, running) -> pages.Page:
    """Lines and their marks; running: keys that repeat at the edges of the book's records."""
    own = pages.Page(text, page, end, pages.known_heads(title, document, text[:400]))
    return own.mark_heads(own.repeated() | set(running or ()))


def read_words(text, spans, marks) -> tuple[set[str], set[tuple[str, str]]]:
    """Whole words, and the two parts of words cut at line ends, all in lower case."""
    body = [text[a:b].strip() for (a, b), m in zip(spans, marks) if m is None and text[a:b].strip()]
    words, cuts, head = set(), set(), ""
    for i, line in enumerate(body):
        found = [(m.start(), m.end(), m[0]) for m in WORD.finditer(line)]
        follows = body[i + 1] if i + 1 < len(body) else ""
        cut_here = bool(len(line) > 1 and line[-1] in pages.HYPHENS and found and found[-1][1] == len(line) - 1 and (n := WORD.match(follows)))
        if head and found:
            found = found[1:]
        words.update(w.lower() for _, _, w in (found[:-1] if cut_here else found))
        if cut_here:
            left = found[-1][2] if found else head
            cuts.add((left.lower(), n[0].lower()))
            head = n[0]
        else:
            head = ""
    return words, cuts


def _options(batches):
    """Readings of distinct unknown words and cut words. cost: misread sequences undone; hyphen: kept."""
    for batch in base.slices(batches, 0):
        out: tuple[list, ...] = ([], [], [], [])
        for item, rest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for spelt, hyphen in (((item + rest, 0), (f"{item}-{rest}", 1)) if rest else ((item, 0),)):
                for word, cost in {spelt: 0, **undone(spelt)}.items() if rest else undone(spelt).items():
                    for column, value in zip(out, (item, rest, word, 2 * cost + hyphen)):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in out[:3]), pa.array(out[3], pa.int32())], ["item", "rest", "word", "cost"])


def readings(reads: DataFrame, words: DataFrame) -> DataFrame:
    """`item`, `rest`, `meant`, `misread` for every distinct cut word, and every word that a much commoner word explains.

    The fewest misread sequences win, then the commonest word. A cut word that no clean record's word explains is joined without its hyphen
    unless clean records have both its parts.
    """
    distinct = reads.where("kind in ('cut', 'word')").select("item", "rest").distinct()
    asked = base.cut(distinct.where((F.col("rest") != "") | (F.length("item") > 1) & F.col("item").rlike(r"\p{L}")))
    common = words.where(F.col("n") >= RARER * NONE)
    options = base.map_arrow(asked, _options, "item string, rest string, word string, cost int").join(common, "word")
    order = F.struct(F.floor(F.col("cost") / 2), -F.col("n"), "cost", "word")
    best = options.groupBy("item", "rest").agg(F.min_by(F.struct("word", F.col("cost"), "n"), order).alias("b"))
    cuts = asked.where("rest <> ''").join(best, ["item", "rest"], "left")
    left, right = common.select(F.col("word").alias("item"), F.lit(True).alias("l")), common.select(F.col("word").alias("rest"), F.lit(True).alias("r"))
    cuts = cuts.join(left, "item", "left").join(right, "rest", "left")
    plain = F.when(F.col("l") & F.col("r"), F.concat_ws("-", "item", "rest")).otherwise(F.concat("item", "rest"))
    cuts = cuts.select("item", "rest", F.coalesce("b.word", plain).alias("meant"), F.coalesce(F.col("b.cost") >= 2, F.lit(False)).alias("misread"))
    own = words.select(F.col("word").alias("item"), F.col("n").alias("own"))
    wrong = best.where("rest = ''").join(own, "item", "left").where(F.col("b.n") >= RARER * F.coalesce(F.col("own"), F.lit(NONE)))
    return cuts.unionByName(wrong.select("item", "rest", F.col("b.word").alias("meant"), F.lit(True).alias("misread")))


class Scans:
    """The stages over one corpus, each made once."""

    def __init__(self, df: DataFrame, row_id: str, text: str, scanned: str, facts: dict[str, str]):
        """scanned: SQL condition of a scanned record (null counts as clean). facts: SQL of page, end_page, title, document, or none of them."""
        kinds = {"page": "int", "end_page": "int", "title": "string", "document": "string"}
        own = df.select(F.col(row_id).alias("row_key"), F.col(text).cast("string").alias("t"), *((F.expr(facts[k]) if k in facts else F.lit(None)).cast(kind).alias(k) for k, kind in kinds.items()), F.coalesce(F.expr(scanned), F.lit(False)).alias("scanned")).where("t is not null and t <> ''")
        self.row_id = row_id
        self.scans = base.spread(own.where("scanned").drop("scanned"))
        self.kind = own.schema["row_key"].dataType.simpleString()
        first = base.cut(self._read(self.scans.withColumn("running", F.lit(None).cast("array<string>"))))
        self.running = base.cut(self._running(first))
        again = self._read(self.scans.join(self.running, "row_key"))
        self.reads = base.cut(first.where("kind <> 'edge'").join(self.running.select("row_key"), "row_key", "left_anti").unionByName(again.where("kind <> 'edge'")))
        self.words = base.cut(vocabulary(own.where("not scanned"), "t"))
        self.readings = base.cut(readings(self.reads, self.words))

    def _read(self, rows: DataFrame) -> DataFrame:
        return base.map_arrow(rows.select("row_key", "t", "page", "end_page", "title", "document", "running"), _reads, f"row_key {self.kind}, kind string, item string, rest string")

    def _running(self, reads: DataFrame) -> DataFrame:
        """`row_key`, `running`: heads of its book that a record's edges repeat. A book has at most as many as an edge's share allows."""
        edges = reads.where("kind = 'edge'").select("row_key", F.col("item").alias("line"), F.col("rest").alias("book")).distinct()
        size = self.scans.groupBy(F.coalesce("document", F.lit("")).alias("book")).agg(F.count("*").alias("size"))
        heads = edges.groupBy("book", F.col("line").alias("head")).agg(F.count("*").alias("n")).join(size, "book").where((F.col("n") >= 2) & (F.col("n") >= SHARE * F.col("size"))).select("book", "head")
        half = lambda c: F.explode(F.array(F.concat(F.lit("<"), F.substring(c, 1, pages.HALF)), F.concat(F.lit(">"), F.right(F.col(c), F.lit(pages.HALF)))))
        met = edges.withColumn("half", half("line")).join(heads.withColumn("half", half("head")), ["book", "half"])
        most = F.floor(pages.REPEATS * F.greatest(F.length("line"), F.length("head")))
        return met.where(F.levenshtein("line", "head") <= most).groupBy("row_key").agg(F.collect_set("head").alias("running"))

    def findings(self) -> DataFrame:
        """Distinct `row_id`, `kind` (hyphen, misread, header, pagenum), `item`."""
        lines = self.reads.where("kind in ('header', 'pagenum')").select("row_key", "kind", "item")
        meant = self.reads.where("kind in ('cut', 'word')").join(self.readings, ["item", "rest"])
        hyphens = meant.where("kind = 'cut'").select("row_key", F.lit("hyphen").alias("kind"), F.col("meant").alias("item"))
        misread = meant.where("misread").select("row_key", F.lit("misread").alias("kind"), F.col("meant").alias("item"))
        return lines.unionByName(hyphens).unionByName(misread).distinct().withColumnRenamed("row_key", self.row_id)

    def repaired(self) -> DataFrame:
        """`row_id`, `paragraphs`: each scanned text as continuous paragraphs."""
        fixes = self.reads.where("kind in ('cut', 'word')").select("row_key", "item", "rest").join(self.readings, ["item", "rest"])
        by = fixes.groupBy("row_key").agg(F.collect_list(F.struct("item", "rest", "meant")).alias("fixes"))
        rows = self.scans.join(self.running, "row_key", "left").join(by, "row_key", "left").select("row_key", "t", "page", "end_page", "title", "document", "running", "fixes")
        return base.map_arrow(rows, _repair, f"row_key {self.kind}, paragraphs array<string>").withColumnRenamed("row_key", self.row_id)


def _cased(meant: str, seen: str) -> str:
    letters = [c for c in seen if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return meant.upper()
    return meant[:1].upper() + meant[1:] if letters and letters[0].isupper() and seen[:1].isalpha() else meant


def repair(text, page, end, title, document, running, fixes) -> list[str]:
    """A paragraph ends where a blank line that is not a page's edge, or a short line that closes a sentence, ends it."""
    own = marked(text, page, end, title, document, running)
    spans, marks = own.spans, own.marks
    meant = {(f["item"], f["rest"]): f["meant"] for f in fixes or ()}
    body = [(i, text[a:b].strip()) for i, ((a, b), m) in enumerate(zip(spans, marks)) if m is None and text[a:b].strip()]
    width = max((len(s) for _, s in body), default=0)
    out, now, carry = [], [], ""
    for k, (_, line) in enumerate(body):
        found = list(WORD.finditer(line))
        follows = body[k + 1][1] if k + 1 < len(body) else ""
        cut_here = bool(len(line) > 1 and line[-1] in pages.HYPHENS and found and found[-1].end() == len(line) - 1 and (n := WORD.match(follows)))
        pieces, at = [], 0
        for j, m in enumerate(found):
            pieces.append(line[at : m.start()])
            at = m.end()
            if j == 0 and carry:
                pieces.append(carry)
            elif j == len(found) - 1 and cut_here:
                pass
            else:
                fixed = meant.get((m[0].lower(), ""))
                pieces.append(_cased(fixed, m[0]) if fixed else m[0])
        pieces.append("" if cut_here else line[at:])
        carry = ""
        if cut_here:
            left = found[-1][0]
            carry = _cased(meant.get((left.lower(), n[0].lower()), left + n[0]), left)
        now.append("".join(pieces).rstrip() if not cut_here else "".join(pieces))
        if not cut_here and (len(line) < 0.75 * width and line[-1] in ".:!?]" or not follows):
            out.append(_joined(now))
            now = []
    return out + ([_joined(now)] if now else [])


def _joined(parts: list[str]) -> str:
    return " ".join(p.strip() for p in parts if p.strip())


def _repair(batches):
    for batch in base.slices(batches, 1):
        rows = [repair(*row) for row in zip(*(c.to_pylist() for c in batch.columns[1:]))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.string()))], ["row_key", "paragraphs"])
