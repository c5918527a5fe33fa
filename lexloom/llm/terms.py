"""Problem 1: how often every distinct value or term occurs, and in how many records.

Heavy-light aggregation. Terms that make up at least 1 / HEAVY of all occurrences (so there are fewer than HEAVY of them, whatever the data) are detected
over all rows by bounded summaries and broadcast. Their occurrences are counted exactly in arrays inside the tasks; that a record has them
is a bit in a few numbers per record, which are or-ed by record (with map-side combining) and counted in arrays again. Only the remaining
terms are shuffled, as pre-aggregated (term, record) pairs, none of which is frequent. The two tables are united.

A record is a distinct id; a term occurs in it if any of its rows has it. Defined results: rows without an id belong to no record and are
left out; null fields have no terms; null and blank array values are none; a term over a record's repeated rows counts every occurrence but
one record; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import base

LETTERS = regex.compile(r"\p{L}+")
HEAVY = 512
#: Counters in a task's summary (Misra-Gries); four times as many as heavy terms can exist.
SUMMARY = 4 * HEAVY
WORDS = HEAVY // 64
RARE, COMMON = 3, 0.2


def _row_terms(values: list | None, text: str | None) -> list[tuple[int, str]]:
    """Terms of one row, with 0 for the array field and 1 for the text field."""
    out = [(0, v.strip().lower()) for v in values or () if v and not v.isspace()]
    if text:
        out += [(1, w.lower()) for w in LETTERS.findall(text)]
    return out


def _summaries(batches):
    """At most SUMMARY counters a task: when there are more, all are lowered until that many are left."""
    kept: Counter = Counter()
    total = 0
    for batch in base.slices(batches):
        for values, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            terms = _row_terms(values, text)
            kept.update(terms)
            total += len(terms)
            if len(kept) > 16 * SUMMARY:
                kept = _lowered(kept)
    kept = _lowered(kept)
    yield pa.RecordBatch.from_pydict({"field": pa.array([k[0] for k in kept] + [-1], pa.int32()), "term": pa.array([k[1] for k in kept] + [None], pa.string()), "n": pa.array([*kept.values(), total], pa.int64())})


def _lowered(kept: Counter) -> Counter:
    if len(kept) <= SUMMARY:
        return kept
    by = sorted(kept.values(), reverse=True)[SUMMARY]
    return Counter({k: v - by for k, v in kept.items() if v > by})


def _counts(heavy):
    """Per row: its record's bits. Per slice: the light terms, pre-aggregated. Per task: exact counters of the heavy terms."""

    def work(batches):
        place: dict = heavy.value
        counter = np.zeros(len(place), np.int64)
        for batch in base.slices(batches):
            ids = batch.column(0).to_pylist()
            bits = np.zeros((len(ids), WORDS * 64), bool)
            light: Counter = Counter()
            for row, (key, values, text) in enumerate(zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for term, n in Counter(_row_terms(values, text)).items():
                    at = place.get(term)
                    if at is None:
                        light[key, *term] += n
                    else:
                        bits[row, at] = True
                        counter[at] += n
            packed = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            yield _batch(0, ids, None, None, None, packed)
            if light:
                yield _batch(1, [k[0] for k in light], [k[1] for k in light], [k[2] for k in light], list(light.values()), None)
        if counter.any():
            at = np.flatnonzero(counter)
            yield _batch(2, None, at.tolist(), None, counter[at].tolist(), None)

    return work


def _batch(kind, ids, field, term, n, packed) -> pa.RecordBatch:
    size = len(ids if ids is not None else field)
    columns = [pa.array([kind] * size, pa.int32())]
    for values, t in ((ids, pa.string()), (field, pa.int32()), (term, pa.string()), (n, pa.int64())):
        columns.append(pa.nulls(size, t) if values is None else pa.array(values, t))
    columns += [pa.nulls(size, pa.int64()) if packed is None else pa.array(np.ascontiguousarray(packed[:, k])) for k in range(WORDS)]
    return pa.RecordBatch.from_arrays(columns, ["kind", "id", "field", "term", "n", *(f"b{k}" for k in range(WORDS))])


def _records_with(batches):
    """Heavy terms' records: the bits of all records of a task, added up."""
    counter = np.zeros(WORDS * 64, np.int64)
    for batch in batches:
        packed = np.stack([np.asarray(c) for c in batch.columns], axis=1)
        counter += np.unpackbits(np.ascontiguousarray(packed).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    at = np.flatnonzero(counter)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counter[at], pa.int64())], ["place", "n_records"])


def term_counts(df: DataFrame, record: str, values: str, text: str, names: tuple[str, str] = ("keywords", "text")) -> DataFrame:
    """`field`, `term`, `n_occurrences`, `n_records`, `mark` of every distinct term of an array column and a text column.

    mark: 'rare' in fewer than RARE records, 'common' in more than the share COMMON of all records, else null.
    """
    spark = df.sparkSession
    own = df.select(F.col(record).cast("string").alias("id"), F.col(values).cast("array<string>").alias("v"), F.col(text).cast("string").alias("t")).where("id is not null")
    own = base.spread(own)
    records = own.select("id").distinct().count()
    seen = base.map_arrow(own, _summaries, "field int, term string, n long").groupBy("field", "term").agg(F.sum("n").alias("n"))
    seen = base.cut(seen)
    total = seen.where("field = -1").agg(F.sum("n")).first()[0] or 0
    #: Fewer than HEAVY terms can reach this count, so this list is bounded.
    heavy = [(r.field, r.term) for r in seen.where((F.col("field") >= 0) & (F.col("n") * HEAVY > total)).orderBy("field", "term").collect()]
    parts = base.map_arrow(own, _counts(spark.sparkContext.broadcast({k: i for i, k in enumerate(heavy)})), "kind int, id string, field int, term string, n long, " + ", ".join(f"b{k} long" for k in range(WORDS)))
    parts = base.cut(parts)
    bits = parts.where("kind = 0").groupBy("id").agg(*(F.bit_or(f"b{k}").alias(f"b{k}") for k in range(WORDS))).drop("id")
    with_it = base.map_arrow(bits, _records_with, "place int, n_records long").groupBy("place").agg(F.sum("n_records").alias("n_records"))
    often = parts.where("kind = 2").groupBy(F.col("field").alias("place")).agg(F.sum("n").alias("n_occurrences"))
    listed = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(heavy)], "place int, field int, term string")
    top = listed.join(often, "place").join(with_it, "place").select("field", "term", "n_occurrences", "n_records")
    rest = parts.where("kind = 1").groupBy("field", "term", "id").agg(F.sum("n").alias("n")).groupBy("field", "term").agg(F.sum("n").alias("n_occurrences"), F.count("*").alias("n_records"))
    both = top.unionByName(rest)
    mark = F.when(F.col("n_records") < RARE, "rare").when(F.col("n_records") > COMMON * records, "common")
    return both.select(F.when(F.col("field") == 0, names[0]).otherwise(names[1]).alias("field"), "term", "n_occurrences", "n_records", mark.alias("mark"))
