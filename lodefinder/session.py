"""Sessions, and sending this package to the executors."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each SparkContext: Python tasks import it there."""
    context = spark.sparkContext
    if getattr(context, "_lodefinder_sent", False):
        return
    folder = tempfile.mkdtemp(prefix="lodefinder-zip-")
    target = os.path.join(folder, "lodefinder.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, f"{ROOT.name}/{p.relative_to(ROOT)}")
    context.addPyFile(target)
    context._lodefinder_sent = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def work_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where none is set, in local mode."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodefinder-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """df written to the shared folder and read again: what reads it does not compute it again, lost executors or not.

    No file has more than rows_a_file rows, if that is not 0.
    """
    path = fresh_path(df.sparkSession, name)
    (df.write.option("maxRecordsPerFile", rows_a_file) if rows_a_file else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodefinder")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
