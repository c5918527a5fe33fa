"""Event streams: windows and sessions with watermarks, and pairing with carried state. The reference tools have no event time; this is added."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.session import ship


def stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet file or folder as a stream."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, since a plain path must be a folder


def windowed(events: DataFrame, at: str, keys: list[str], size: str, late: str = "10 minutes", slide: str | None = None, value: str | None = None) -> DataFrame:
    """Counts (and sums) by tumbling or sliding windows; events later than `late` are dropped once their window is closed."""
    total = [F.round(F.sum(value), 4).alias("total")] if value else []
    return events.withWatermark(at, late).groupBy(F.window(at, size, slide or size).alias("w"), *keys).agg(F.count("*").alias("n"), *total)


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))


def _pairing(opens: str, closes: str):
    def pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["at", "tie"])
        out = []
        for at, kind in zip(rows["at"], rows["kind"]):
            if kind == opens:
                opened = int(at)
            elif opened is not None:
                out.append((key[0], opened, int(at)))
                opened = None
        if opened is None:
            state.remove()
        else:
            state.update((opened,))
        yield pd.DataFrame(out, columns=["key", "opened", "closed"])

    return pair


def paired(events: DataFrame, key: str, at: str, tie: str, kind: str, opens: str, closes: str) -> DataFrame:
    """`key`, `opened`, `closed` (microseconds): the last opening event before each closing one. A group's state is one number, kept across batches; events of a group must not arrive out of order between batches."""
    ship(events.sparkSession)
    own = events.where(F.col(kind).isin(opens, closes)).select(F.col(key).cast("long").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(kind).alias("kind"))
    return own.groupBy("key").applyInPandasWithState(_pairing(opens, closes), "key long, opened long, closed long", "opened long", "append", GroupStateTimeout.NoTimeout)


def run(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, then gives the result as a table in `folder`. Complete results replace each other; others are appended exactly once by Spark's file sink."""
    spark, out = df.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{out}/rows").awaitTermination()
    else:
        writer.foreachBatch(_replace(f"{out}/rows")).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def _replace(path: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, _: batch.write.mode("overwrite").parquet(path)
