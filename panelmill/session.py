"""Session defaults and the reliable hand-over of intermediate tables."""

from __future__ import annotations

import atexit
import json
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark import SparkContext, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []
_RUNS: set[str] = set()
_SHIPPED: set[str] = set()


def local_session(app: str = "panelmill", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PANELMILL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset a temporary folder serves a local master only; a cluster
    without a shared folder is an error, as its machines would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share (master is {master})")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="panelmill-"))
        atexit.register(shutil.rmtree, _FALLBACK[0], ignore_errors=True)
    return _FALLBACK[0]


def run_folder(spark: SparkSession) -> str:
    """This application's own folder inside the shared one, deleted when the application ends."""
    path = f"{shared_folder(spark)}/run-{spark.sparkContext.applicationId}"
    if path not in _RUNS:
        _RUNS.add(path)
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def reuse(df: DataFrame) -> DataFrame:
    """Keep a table that several jobs read; lost blocks are recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def settle(df: DataFrame) -> DataFrame:
    """Write an aggregated table to the shared folder and read it back.

    Used where a reduced table feeds several further aggregations: the plan
    starts afresh from a file of known size, so neither the logical plan nor the
    work upstream is repeated, and a lost executor only rereads the file.
    """
    path = f"{run_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def discard(table: DataFrame) -> None:
    """Delete the files of a settled table from which nothing is computed any more."""
    delete(table.sparkSession.sparkContext, table._settled)


def delete(sc: SparkContext, path: str) -> None:
    """Delete a folder of the shared one."""
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A table of a few rows as a literal of the plan (folds, features, scenarios)."""
    names = [f.strip().split(" ")[0].strip("`") for f in schema.split(",")]
    data = json.dumps([dict(zip(names, r)) for r in rows], default=str)
    fields = ", ".join(f"`{f.strip().split(' ')[0].strip('`')}`: {f.strip().split(' ', 1)[1]}" for f in schema.split(","))
    return spark.range(1).select(F.inline(F.from_json(F.lit(data), f"array<struct<{fields}>>")))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so no machine needs it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="panelmill-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/panelmill.zip", "w") as out:
        for at, _, files in os.walk(package):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(f"{folder}/panelmill.zip")
    _SHIPPED.add(app)
