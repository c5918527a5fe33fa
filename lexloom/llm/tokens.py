"""Problem 7: encoding a corpus with a public byte-level BPE vocabulary.

Forced-boundary splitting: a pair of bytes that stands side by side in no vocabulary entry can never be merged over, so the text may be
cut there; so may it between the vocabulary's pre-tokens. Fragments between certain cuts are encoded independently, each distinct one once
while it stays in a bounded store, and their ids are concatenated. A text without spaces of any length falls into short fragments too.

Defined results: a null and an empty text give the empty list; strings that look like special tokens are ordinary text; repeated rows give
repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import base

#: Fixed value: the vocabulary's published pre-token pattern.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct fragments whose ids a worker keeps; a full store starts anew.
STORE = 1 << 17
KEPT_CHARS = 48


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Encodes texts by a table of ranks. One per worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.joined = np.zeros((256, 256), bool)
        for token in ranks:
            b = np.frombuffer(token, np.uint8)
            self.joined[b[:-1], b[1:]] = True
        self.store: dict[str, list[int]] = {}

    def cuts(self, raw: bytes) -> list[int]:
        """Places in `raw` where a cut is certain."""
        if len(raw) < 2:
            return []
        b = np.frombuffer(raw, np.uint8)
        return (np.flatnonzero(~self.joined[b[:-1], b[1:]]) + 1).tolist()

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one fragment: the pair of lowest rank, leftmost first, is merged until none is left."""
        ranks, n = self.ranks, len(raw)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or end[j] != to:
                continue
            alive[j], end[i], after[i] = False, to, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(raw[i : end[after[j]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[j]]))
            if before[i] >= 0 and (r := ranks.get(raw[before[i] : to])) is not None:
                heapq.heappush(heap, (r, before[i], to))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = after[i]
        return out

    def piece(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        raw = text.encode("utf-8", "surrogatepass")
        if (whole := self.ranks.get(raw)) is not None:
            ids = [whole]
        else:
            ids, at = [], 0
            for to in [*self.cuts(raw), len(raw)]:
                part = raw[at:to]
                whole = self.ranks.get(part)
                ids += self.merge(part) if whole is None else [whole]
                at = to
        if len(text) <= KEPT_CHARS:
            if len(self.store) >= STORE:
                self.store.clear()
            self.store[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        get, piece, out = self.store.get, self.piece, []
        for part in self.split.findall(text):
            out += get(part) or piece(part)
        return out


def _worker(ranks, pattern: str):
    def work(batches):
        encoder = Encoder(ranks.value, pattern)
        for batch in base.slices(batches, 1):
            lists = [encoder.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["row_key", "ids"])

    return work


def encode(df: DataFrame, key: str, text: str, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken", pattern: str = PATTERN) -> DataFrame:
    """`key` and `ids`, the list of ids of column `text`. The vocabulary (fixed, under 1 MB) is read once by the driver and broadcast."""
    own = df.select(F.col(key).alias("row_key"), F.col(text).cast("string").alias("t"))
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    out = base.map_arrow(base.spread(own), _worker(ranks, pattern), f"row_key {own.schema['row_key'].dataType.simpleString()}, ids array<int>")
    return out.select(F.col("row_key").alias(key), "ids")
