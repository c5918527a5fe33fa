"""The best documents of many queries, block by block: no pair of a query and a document ever leaves the task that scores it.

Documents lie in blocks and queries in shares, both packed and checkpointed once. A task reads its share and, one by one, its blocks; it makes
an index of each block and keeps the k best documents of each query and code over all of its blocks. So each document and query is shuffled once,
and disk grows as their sum, not their product. Nothing is left out of a sum: a token's documents are listed, or, if they are many, a whole row
of the block is added.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import cut, ship

#: Documents of a block at least, where shares alone keep too few cores busy, and at most.
SMALL, LARGE = 1 << 13, 1 << 15
#: Queries of a share at least, and at most; bytes of a pack, and rows that a task holds before it keeps only the best.
FEW, MANY = 1 << 14, 1 << 16
PACK, HELD = 1 << 25, 1 << 20
#: A token in more than one of so many documents of a block has a row of its own. Scores count by thousandths; MARGIN is more than rounding can move.
FREQUENT, UNIT, MARGIN = 8, 1000, 0.002
STRIPES = 64
WORDS, DOCS = 0, 1


def _codes(column: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and vocabulary number of each known token of texts of tokens."""
    lists = pc.split_pattern(column, " ")
    found = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    return rows[found >= 0], found[found >= 0]


def _postings(rows: np.ndarray, tokens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by token, and where each token's begin."""
    at = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(tokens, minlength=n), out=at[1:])
    return rows[np.argsort(tokens, kind="stable")].astype(np.int64), at


def _places(keys: Iterable) -> dict:
    out: dict = {}
    for i, key in enumerate(keys):
        if key is not None:
            out.setdefault(key, []).append(i)
    return {key: np.array(rows) for key, rows in out.items()}


def _union(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _bound(sums: np.ndarray, k: int) -> float:
    """At most the k-th greatest of more than k sums: the k-th of the greatest of stripes, which are quicker to find."""
    width = len(sums) // STRIPES
    most = sums[: STRIPES * width].reshape(STRIPES, width).max(axis=0) if width >= k else sums
    return np.partition(most, len(most) - k)[len(most) - k]


class Index:
    """The documents of one code in a block, in the order of their ids."""

    def __init__(self, code: str, docs: pa.Table, vocabulary: pa.Array, idf: np.ndarray, points: dict):
        docs = docs.take(pc.sort_indices(docs["doc"])).combine_chunks()
        self.code, self.idf, self.points = code, idf, points
        self.ids, self.sections = docs["doc"].combine_chunks(), docs["section"].combine_chunks()
        self.n = docs.num_rows
        self.rows, self.at = _postings(*_codes(docs["words"].combine_chunks(), vocabulary), len(idf))
        rows, tokens = _codes(docs["title"].combine_chunks(), vocabulary)
        pairs = np.unique(rows.astype(np.int64) * max(len(idf), 1) + tokens)
        self.heads, self.heads_at = _postings(pairs // max(len(idf), 1), pairs % max(len(idf), 1), len(idf))
        often = np.flatnonzero(np.diff(self.at) * FREQUENT > self.n)
        self.place = np.full(len(idf), -1)
        self.place[often] = np.arange(len(often))
        self.weights = np.zeros((len(often), self.n))
        for i, t in enumerate(often):
            self.weights[i, self.rows[self.at[t] : self.at[t + 1]]] = idf[t]
        self.by_section = _places(self.sections.to_pylist())
        names: dict = {}
        for i, maps in enumerate(docs["maps"].to_pylist()):
            for name in set(maps or ()):
                names.setdefault(name, []).append(i)
        self.by_name = {name: np.array(rows) for name, rows in names.items()}

    def best(self, tokens: np.ndarray, query: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, thousandths and whether cited of a query's k best: cited ones first, then by score, then by id."""
        primary, both = query["primary"], query["route"] == "MULTI_PERIOD_REVIEW"
        bonus = self.points["both"] if both else self.points["primary"] if self.code == primary else 0.0
        sums = np.zeros(self.n)
        often = self.place[tokens]
        for t in tokens[often < 0].tolist():
            sums[self.rows[self.at[t] : self.at[t + 1]]] += self.idf[t]
        for row in often[often >= 0].tolist():
            sums += self.weights[row]
        for t in tokens.tolist():
            sums[self.heads[self.heads_at[t] : self.heads_at[t + 1]]] += self.points["title"]
        refs = query["refs"] or ()
        exact = _union([self.by_section[r["section"]] for r in refs if r["section"] in self.by_section and r["code"] in (None, self.code)])
        asked = {"-".join(x.lower() for x in (r["code"], r["section"]) if x is not None) for r in refs if r["code"] is not None and r["code"] != self.code} if both or self.code == primary else set()
        mapped = _union([self.by_name[name] for name in asked if name in self.by_name])
        sums[exact] += self.points["exact"]
        sums[mapped] += self.points["mapped"]
        for p in query["points"] or ():
            if p["code"] == self.code and p["section"] in self.by_section:
                sums[self.by_section[p["section"]]] += p["points"]
        least = _bound(sums, k) - MARGIN if self.n > k else 0.0
        at = np.flatnonzero(sums >= least) if least > 0 else np.flatnonzero(sums)
        marked = _union([self.by_section[r["section"]] for r in refs if r["code"] == self.code == primary and r["section"] in self.by_section])
        if len(marked):
            at = np.union1d(at, marked)
        at = at[sums[at] > 0]
        units = np.floor((sums[at] + bonus) * UNIT + 0.5).astype(np.int64)
        cited = np.isin(at, marked) if len(marked) else np.zeros(len(at), bool)
        chosen = np.lexsort((at, -units, ~cited))[:k]
        return at[chosen], units[chosen], cited[chosen]


def _bytes(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for batch in batches:
            out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _table(packed: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(packed.as_buffer()).read_all()


def _packs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= PACK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _pack_docs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's documents, each pack with the words that it is read by; the words come first."""
    words: list[pa.RecordBatch] = []

    def docs() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = int(np.searchsorted(batch.column("kind").to_numpy(), DOCS))
            words.append(batch.slice(0, first).select(["words", "idf"]))
            yield batch.slice(first).select(["doc", "code", "section", "words", "title", "maps"])

    for held in _packs(docs()):
        yield pa.RecordBatch.from_arrays([pa.array([_bytes(words)], pa.binary()), pa.array([_bytes(held)], pa.binary())], ["known", "docs"])


def _pack_queries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for i, held in enumerate(_packs(batches)):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([_bytes(held)], pa.binary())], ["share", "asked"])


def _kept(parts: list[pa.Table], k: int) -> pa.Table:
    """Of rows of several blocks the k best of each query and code."""
    table = pa.concat_tables(parts).combine_chunks()
    table = table.take(pc.sort_indices(table, [("place", "ascending"), ("code", "ascending"), ("cited", "descending"), ("score", "descending"), ("doc", "ascending")]))
    place, code = table["place"].to_numpy(), table["code"].combine_chunks().dictionary_encode().indices.to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 0) | (np.diff(code) != 0)]))
    rank = np.arange(len(place)) - np.repeat(starts, np.diff(np.append(starts, len(place))))
    return table.filter(pa.array(rank < k))


def _score(k: int, points: dict, allowed: dict[str, tuple[str, ...]]):
    codes = sorted({c for own in allowed.values() for c in own})

    def build(known: pa.Table, docs: pa.Table) -> tuple[pa.Array, dict[str, Index]]:
        known = known.combine_chunks()
        vocabulary = known["words"].combine_chunks()
        parts = {c: docs.filter(pc.equal(docs["code"], c)) for c in codes}
        return vocabulary, {c: Index(c, part, vocabulary, known["idf"].to_numpy(), points) for c, part in parts.items() if part.num_rows}

    def rows(batch: pa.RecordBatch, at: int, vocabulary: pa.Array, indexes: dict[str, Index]) -> Iterator[pa.Table]:
        place, tokens = _codes(batch.column("words"), vocabulary)
        ends = np.searchsorted(place, np.arange(batch.num_rows + 1))
        out: dict[str, list] = {c: [] for c in codes}
        for i, query in enumerate(batch.select(["route", "primary", "refs", "points"]).to_pylist()):
            own = tokens[ends[i] : ends[i + 1]]
            first = 0
            for code in allowed[query["route"]]:
                if query["route"] == "BNS_PRIMARY" and first >= k:  # the other code comes after all of the first
                    break
                if code in indexes:
                    found = indexes[code].best(own, query, k)
                    first += len(found[0])
                    out[code].append((np.full(len(found[0]), i), *found))
        for code, parts in out.items():
            if parts:
                asked, best, units, cited = (np.concatenate(x) for x in zip(*parts))
                index = indexes[code]
                best, own = pa.array(best, pa.int64()), pa.array(asked, pa.int64())
                values = [pa.array(asked + at, pa.int64()), batch.column("qid").take(own), batch.column("route").take(own), batch.column("primary").take(own), index.ids.take(best), pa.array([code] * len(best), pa.string()), index.sections.take(best), pa.array(units / UNIT), pa.array(cited.astype(np.int32))]
                yield pa.table(values, ["place", "qid", "route", "primary", "doc", "code", "section", "score", "cited"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, built = None, None
        best: dict[int, list[pa.Table]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                known, docs = batch.column("known")[i], batch.column("docs")[i]
                if at is None or not docs.as_buffer().equals(at):
                    at, built = docs.as_buffer(), build(_table(known), _table(docs))
                held, first = best.setdefault(batch.column("share")[i].as_py(), []), 0
                for part in _table(batch.column("asked")[i]).to_batches():
                    held += rows(part, first, *built)
                    first += part.num_rows
                if len(held) > 1 and sum(x.num_rows for x in held) > HELD:
                    held[:] = [_kept(held, k)]
        for held in best.values():
            if held:
                yield from _kept(held, k).drop_columns(["place"]).to_batches(max_chunksize=1 << 16)

    return work


def best(queries: DataFrame, docs: DataFrame, idf: Column, k: int, points: dict, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """`qid`, `route`, `primary`, `doc`, `code`, `section`, `score`, `cited`: of each query and group of blocks the k best documents of each code that may count.

    queries: `qid`, `route`, `primary`, `words` (distinct tokens, joined by blanks), `refs`, `points` (code, section, points). docs: `doc`, `code`,
    `section`, `words`, `title` (tokens too), `maps`; those of other codes count in the tokens' weights only. idf: from `df` and `n`.
    points: of a title's token (title), a reference (exact, mapped), the primary code, both codes (primary, both).
    """
    spark = docs.sparkSession
    ship(spark)
    docs, queries = cut(docs), cut(queries)  # both are read for the weights and for the blocks
    n, asked_n, cores = docs.count(), queries.count(), spark.sparkContext.defaultParallelism
    shares = max(1, -(-asked_n // MANY), min(-(-asked_n // FEW), 2 * cores))
    groups = -(-2 * cores // shares)  # of blocks: only as many as keep the cores busy
    blocks = max(1, -(-n // LARGE), min(-(-n // SMALL), groups))
    asked = queries.select(F.explode(F.split("words", " ")).alias("token")).distinct()
    counted = docs.select(F.explode(F.split("words", " ")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    words = counted.join(asked, "token", "left_semi").where("token <> ''").select("token", idf(F.col("df"), F.lit(n)).alias("idf"))
    kinds = dict(docs.dtypes) | dict(queries.dtypes)
    columns = ("doc", "code", "section", "title", "maps")

    def side(df: DataFrame, kind: int, block: Column, **own: Column) -> DataFrame:
        rest = (own.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in columns)
        return df.select(block.alias("block"), F.lit(kind).alias("kind"), own["words"].alias("words"), own.get("idf", F.lit(None)).cast("double").alias("idf"), *rest)

    named = lambda *names: {c: F.col(c) for c in names}
    every = side(words, WORDS, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), words=F.col("token"), idf=F.col("idf"))
    own = side(docs.where(F.col("doc").isNotNull() & F.col("code").isin(*{c for x in allowed.values() for c in x})), DOCS, F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int"), **named("doc", "code", "section", "words", "title", "maps"))
    dealt = every.unionAll(own).repartitionById(blocks, "block").sortWithinPartitions("kind")
    held = cut(dealt.mapInArrow(_pack_docs, "known binary, docs binary")).coalesce(min(groups, blocks))
    theirs = cut(queries.where("qid is not null").select("qid", "route", "primary", "words", "refs", "points").repartition(shares, "qid").mapInArrow(_pack_queries, "share long, asked binary"))
    schema = f"qid {kinds['qid']}, route string, primary string, doc {kinds['doc']}, code string, section string, score double, cited int"
    return held.hint("shuffle_replicate_nl").crossJoin(theirs).mapInArrow(_score(k, points, allowed), schema)  # packs are read again, not shuffled
