"""Problem 8: evaluation passages inside a training corpus.

Greedy string tiling: Karp-Rabin hashes of every run of `least` words seed the matches between a document and the items; each document
then repeatedly marks the longest match that overlaps no marked one, in the document and in the item, so that reordered passages are
covered too. What decides is the tiling: an item has leaked into a document if its tiles hold at least `least` of its words and at least
the share `coverage` of them. At a coverage of 0 the floor of `least` words alone decides.

Items of up to BLOCK_BYTES are broadcast and the corpus isn't shuffled. More of them meet the documents by winnowed fingerprints: of the
shorter runs within every `least` words each side keeps the one that hashes least, so two texts that share `least` words share a
fingerprint; only fingerprints are shuffled, then the texts of the pairs that have one. Both ways give the same rows.

Words are the longest runs of letters, combining marks and numbers, case ignored. Defined results: null and empty texts and texts under
`least` words on either side give no row; repeated rows of one id count as one document; ties between matches of one length go to the
earlier place in the document, then in the item; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import base

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Items of at most so many bytes of text are broadcast.
BLOCK_BYTES = 16 << 20
#: Shared seeds that are looked at together; their number bounds a task's memory, not the result.
CHUNK = 1 << 20
#: Items of one document are dealt to so many groups where texts are shuffled.
SALTS = 64
LEAST = 12


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def rolling(ids: np.ndarray, least: int) -> np.ndarray:
    """Hash of the run of `least` word ids that begins at each place."""
    n = len(ids) - least + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(least):
            out = out * FACTOR + ids[k : k + n]
            out ^= out >> np.uint64(29)
    return out


def fingerprints(text: str, least: int) -> np.ndarray:
    """Hashes such that texts which share `least` words in a row share one: the least hash in each window of shorter runs."""
    size = max(1, 2 * least // 3)
    hashes = rolling(np.array([xxhash.xxh64_intdigest(w) for w in words(text)], np.uint64), size)
    window = least - size + 1
    if len(hashes) < window:
        return hashes[:0]
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, window).min(axis=1))


class Items:
    """A block of items, ready to be searched for."""

    def __init__(self, rows: list[tuple[int, str]], least: int):
        self.least, self.vocabulary, self.names, ids = least, {}, [], []
        for name, text in rows:
            own = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text or "")], np.uint64)
            if len(own) >= least:
                self.names.append(name)
                ids.append(own)
        self.size = np.array([len(x) for x in ids], np.int64)
        self.first = np.append(0, np.cumsum(self.size))[:-1].astype(np.int64)
        self.flat = np.concatenate([*ids, np.zeros(0, np.uint64)])
        hashes = [rolling(x, least) for x in ids]
        every = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        by = np.argsort(every, kind="stable")
        self.seeds = every[by]
        self.item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]).astype(np.int64)[by]
        self.place = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, np.int64)]).astype(np.int64)[by]

    def _seeded(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, place in the document less place in the item, place in the document) of all shared runs of `least` words, in chunks by place."""
        hashes = rolling(ids, self.least)
        low, high = np.searchsorted(self.seeds, hashes, "left"), np.searchsorted(self.seeds, hashes, "right")
        hits = np.flatnonzero(high > low)
        ends = np.cumsum((high - low)[hits])
        at = 0
        while at < len(hits):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
            part = hits[at:to]
            many = (high - low)[part]
            d = np.repeat(part, many)
            s = np.arange(len(d)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[part], many)
            item, place = self.item[s], self.place[s]
            same = np.ones(len(d), bool)
            for k in range(self.least):
                same &= self.flat[self.first[item] + place + k] == ids[d + k]
            yield item[same], (d - place)[same], d[same]
            at = to

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Maximal common runs: item, shift, start and end in the document, by item."""
        parts = []
        for item, shift, d in self._seeded(ids):
            parts.append(_joined(item, shift, d, d + self.least))
        if not parts:
            return (np.zeros(0, np.int64),) * 4
        return _joined(*(np.concatenate(c) for c in zip(*parts)))

    def tiles(self, text: str) -> list[tuple[int, int, int]]:
        """(item, number of tiles, words in tiles) of every item with a tile in the text."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words(text)], np.uint64)
        if len(ids) < self.least or not len(self.seeds):
            return []
        item, shift, start, end = self.matches(ids)
        if not len(item):
            return []
        lead = np.flatnonzero(np.append(True, np.diff(item) > 0))
        out = []
        for a, b in zip(lead.tolist(), [*lead[1:].tolist(), len(item)]):
            if b - a == 1:  # one match is one tile
                out.append((int(item[a]), 1, int(end[a] - start[a])))
            else:
                runs = [(int(e - s), int(s), int(s - k)) for s, e, k in zip(start[a:b], end[a:b], shift[a:b])]
                out.append((int(item[a]), *tile(runs, len(ids), int(self.size[item[a]]), self.least)))
        return out

    def leaked(self, text: str, coverage: float) -> list[tuple[int, int, float]]:
        """(name, tiles, coverage) of the items whose tiles hold `least` words and the share `coverage`."""
        return [(self.names[i], n, k / int(self.size[i])) for i, n, k in self.tiles(text) if k >= self.least and k >= coverage * self.size[i]]


def _joined(item: np.ndarray, shift: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of one item and shift that touch or overlap, as one; sorted by item, shift and start."""
    by = np.lexsort((start, shift, item))
    item, shift, start, end = item[by], shift[by], start[by], end[by]
    if not len(item):
        return item, shift, start, end
    apart = (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] > end[:-1])
    lead = np.flatnonzero(np.append(True, apart))
    return item[lead], shift[lead], start[lead], np.maximum.reduceat(end, lead)


def tile(runs: list[tuple[int, int, int]], n_document: int, n_item: int, least: int) -> tuple[int, int]:
    """Greedy tiling of one document with one item. runs: (size, place in the document, place in the item). Number of tiles and their words."""
    in_document, in_item, count, covered = np.zeros(n_document, bool), np.zeros(n_item, bool), 0, 0
    waiting = [(-size, d, i) for size, d, i in runs]
    heapq.heapify(waiting)
    while waiting:
        size, d, i = heapq.heappop(waiting)
        size = -size
        taken = in_document[d : d + size] | in_item[i : i + size]
        if not taken.any():
            in_document[d : d + size] = in_item[i : i + size] = True
            count, covered = count + 1, covered + size
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], taken.astype(np.int8), [1]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= least:
                heapq.heappush(waiting, (a - b, d + a, i + a))
    return count, covered


def _rows(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*found)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.float64())], ["doc_key", "item_key", "tiles", "coverage"])


def _worker(items, coverage: float):
    def work(batches):
        block: Items = items.value
        for batch in base.slices(batches, 1):
            found = [(key, *row) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for row in block.leaked(text or "", coverage)]
            yield _rows(found, batch.schema.field(0).type)

    return work


def _fingerprint_rows(least: int):
    def work(batches):
        for batch in base.slices(batches, 1):
            prints = [fingerprints(t or "", least) for t in batch.column(1).to_pylist()]
            key = batch.column(0).take(pa.array(np.repeat(np.arange(len(prints)), [len(p) for p in prints]), pa.int64()))
            yield pa.RecordBatch.from_arrays([key, pa.array(np.concatenate([*prints, np.zeros(0, np.uint64)]).view(np.int64), pa.int64())], ["own_key", "print"])

    return work


def _pair_rows(least: int, coverage: float):
    def work(batches):
        for batch in base.slices(batches, 1):
            found = []
            for key, text, items in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found += [(key, *row) for row in Items([(i["item_key"], i["u"]) for i in items], least).leaked(text or "", coverage)]
            yield _rows(found, batch.schema.field(0).type)

    return work


def _shuffled(own: DataFrame, items: DataFrame, kind: str, least: int, coverage: float) -> DataFrame:
    """Documents and items meet by fingerprints."""
    prints = lambda df, key, kind, text: base.map_arrow(df.select(key, text), _fingerprint_rows(least), f"own_key {kind}, print long").withColumnRenamed("own_key", key)
    pairs = prints(own, "doc_key", kind, "t").join(prints(base.spread(items), "item_key", "long", "u"), "print").select("doc_key", "item_key").distinct()
    salt = F.pmod(F.xxhash64("item_key"), F.lit(SALTS))
    asked = pairs.join(items, "item_key").groupBy("doc_key", salt.alias("salt")).agg(F.collect_list(F.struct("item_key", "u")).alias("items"))
    return base.map_arrow(asked.join(own, "doc_key").select("doc_key", "t", "items"), _pair_rows(least, coverage), f"doc_key {kind}, item_key long, tiles int, coverage double")


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least: int = LEAST, coverage: float = 0.0) -> DataFrame:
    """One row per document and item that leaked into it: `doc_id`, `item_id`, `tiles`, `coverage` (share of the item's words in tiles; the
    largest, where an id has several rows).

    The items' bytes are summed first; up to BLOCK_BYTES they are sent to the workers, beyond that nothing is.
    """
    own = base.spread(documents.select(F.col(doc_id).alias("doc_key"), F.col(text).cast("string").alias("t")).where("t is not null and t <> ''"))
    asked = items.select(F.col(item_id).cast("long").alias("item_key"), F.col(item_text).cast("string").alias("u")).where("u is not null and u <> ''")
    kind = own.schema["doc_key"].dataType.simpleString()
    if (asked.agg(F.sum(F.octet_length("u"))).first()[0] or 0) <= BLOCK_BYTES:
        block = Items([tuple(r) for r in asked.orderBy("item_key", "u").collect()], least)
        found = base.map_arrow(own, _worker(documents.sparkSession.sparkContext.broadcast(block), coverage), f"doc_key {kind}, item_key long, tiles int, coverage double")
    else:
        found = _shuffled(own, asked, kind, least, coverage)
    out = found.groupBy("doc_key", "item_key").agg(F.max("tiles").alias("tiles"), F.max("coverage").alias("coverage"))
    return out.select(F.col("doc_key").alias(doc_id), F.col("item_key").alias(item_id), "tiles", "coverage")
