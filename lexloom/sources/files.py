"""Reading and writing files: arrays and lines of JSON, text lists, digests, runs, and sinks that never overwrite."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A file that is one JSON array (or objects over several lines); a broken file is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One JSON object a line; a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def broken_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """`file`, `line`: lines that aren't JSON of the schema. Blank lines are none."""
    parsed = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"), F.from_json("value", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"}).alias("j"))
    return parsed.where("trim(line) <> ''").where("j.__bad is not null").select("file", "line")


def listed_words(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text list without blank ones and comments."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> '' and word not like '#%'")


def or_none(read, *arguments) -> DataFrame | None:
    """What a reader gives, or None if its path does not exist."""
    try:
        return read(*arguments)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """`file`, `bytes`, `sha256`, `blob` (Git's object id) of all files below a folder; contents stay in the tasks that read them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    head = F.concat(F.encode(F.concat(F.lit("blob "), F.col("length").cast("string")), "utf-8"), F.unhex(F.lit("00")))
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.sha1(F.concat(head, F.col("content"))).alias("blob"))


def identity_problems(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """`file`, `problem` (missing, unlisted, changed) of files (`file`, `sha256`) against a manifest of the same columns."""
    both = manifest.select("file", F.col("sha256").alias("want")).join(found.select("file", F.col("sha256").alias("have")), "file", "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("have") != F.col("want"), "changed")
    return both.select("file", problem.alias("problem")).where("problem is not null")


def latest_runs(runs: DataFrame, key: str, name: Column) -> DataFrame:
    """Each key's row of the run whose name sorts last."""
    columns = [c for c in runs.columns if c != key]
    best = runs.groupBy(key).agg(F.max_by(F.struct(*columns), name).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in columns))


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order (files have none of their own)."""
    return df.orderBy(*order).limit(n)


def write_new(df: DataFrame, path: str, kind: str = "json") -> None:
    """Writes a folder that must not exist."""
    df.write.mode("errorifexists").format(kind).save(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_by_code(df: DataFrame, path: str, code: str) -> None:
    """Parquet partitioned by code, so that filters on it prune folders."""
    df.repartition(code, F.pmod(F.xxhash64(*df.columns), F.lit(16))).write.partitionBy(code).parquet(path)


def forbidden_columns(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    """Columns that an input must not have, whatever their case."""
    return [c for c in df.columns if c.lower().replace("_", "") in {n.lower().replace("_", "") for n in names}]


def gated(spark: SparkSession, path: str, schema: str, sha256: str) -> DataFrame:
    """A catalog's rows if its file has the expected digest, else none."""
    found = digests(spark, path).where(F.col("sha256") == sha256).limit(1).count()
    rows = json_array(spark, path, schema)
    return rows if found else rows.limit(0)


def registered_changes(found: DataFrame, registered: DataFrame) -> DataFrame:
    """`file` of registered inputs that are gone or have another digest."""
    return identity_problems(found, registered).where("problem <> 'unlisted'").select("file")
