"""What the operators of this package share: reading tables, spreading work, cutting lineage, and moving Arrow text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.session import cut, ship  # noqa: F401

#: A worker handles at most this many bytes of text at once, whatever Arrow batch it is given.
SLICE_BYTES = 4 << 20
OVERSAMPLE = 4


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a Parquet table; all columns if none is named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Inputs of fewer splits than the cluster has cores (a single small file) are dealt out; larger ones stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sampled(df: DataFrame, key: str, limit: Column | int, by: str | None = None) -> DataFrame:
    """At most `limit` rows of each value of `by` (of all, if None), those whose keys hash least.

    Rows are counted first, and only those under a hash that lets about OVERSAMPLE times the limit through are ordered, so that what tasks
    send on doesn't grow with their number. by: a column of few values; limit: a number, or an expression of `by`.
    """
    group = F.col(by) if by else F.lit(0)
    own = df.withColumn("__g", group).withColumn("__h", F.xxhash64(F.col(key)))
    size = own.groupBy("__g").agg(F.count("*").alias("__n")).select(F.col("__g").alias("__s"), "__n")
    most = F.lit(limit) if isinstance(limit, int) else limit
    near = own.join(F.broadcast(size), own["__g"].eqNullSafe(F.col("__s"))).where(F.pmod("__h", F.lit(1 << 30)) * F.col("__n") < F.lit(OVERSAMPLE << 30) * most.cast("double"))
    place = F.row_number().over(Window.partitionBy("__g").orderBy(F.pmod("__h", F.lit(1 << 30)), "__h", key))
    return near.withColumn("__r", place).where(F.col("__r") <= most).drop("__g", "__h", "__s", "__n", "__r")


def slices(batches: Iterable[pa.RecordBatch], text: int | None = None, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that column number `text` (all columns, if None) holds about `limit` bytes; a longer single row stays whole."""
    for batch in batches:
        n, size = batch.num_rows, (batch if text is None else batch.column(text)).nbytes
        step = max(1, int(n * limit / max(size, 1)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`mapInArrow` with this package on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(work, schema)


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as one array of code points and the rows' offsets in it; null counts as empty. No call per row."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
    raw = memoryview(column.buffers()[2])[first:last]
    heads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    before = np.zeros(last - first + 1, np.int64)
    np.cumsum(heads, out=before[1:])
    return np.frombuffer(str(raw, "utf-8").encode("utf-32-le", "surrogatepass"), np.uint32), before[offsets - first]


def strings(points: np.ndarray, offsets: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """The reverse of `code_points`; rows set in `mask` become null."""
    raw = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    ends = np.zeros(len(points) + 1, np.int64)
    np.cumsum(widths, out=ends[1:])
    at = np.ascontiguousarray(ends[offsets], np.int64)
    out = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at), pa.py_buffer(raw))
    if mask is not None and mask.any():
        out = pa.compute.if_else(pa.array(~mask), out, pa.scalar(None, pa.large_string()))
    return out.cast(pa.string())


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns under the operators' own names, so that further or clashing columns of the input do no harm."""
    return df.select(*(F.col(f"`{source}`" if "." not in source else source).alias(name) for name, source in columns.items()))
