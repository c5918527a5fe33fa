"""Sessions, and shipping this package to the workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: What the package expects of a session; anything already set stays.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "lexloom", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A folder that all machines see: the one that the session names in spark.checkpoint.dir. A local session that names none gets a temporary
    one; on a cluster that is an error, since executors would write to disks of their own."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    folder = tempfile.mkdtemp(prefix=f"lexloom-{purpose}-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once per application: Spark's own file server hands the archive to each executor, late ones too. The
    archive is made on the driver, which serves it; it lies in the session's shared folder, where that is a path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    shared = shared_folder(spark, "package")
    if shared.startswith(("/", "file:")):
        folder = Path(urlparse(shared).path) / f"lexloom-package-{sc.applicationId}"
        folder.mkdir(parents=True, exist_ok=True)
    else:  # storage of another kind: only the driver needs the archive
        folder = Path(tempfile.mkdtemp(prefix="lexloom-package-"))
    atexit.register(shutil.rmtree, folder, True)
    archive = folder / "lexloom_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path(root.name) / path.relative_to(root))
    sc.addPyFile(str(archive))


def cut(df: DataFrame) -> DataFrame:
    """The same rows behind a reliable checkpoint in the session's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Inputs of fewer splits than the cluster has cores (a single small file) are dealt out; larger ones stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
