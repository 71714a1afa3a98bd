"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # hash instead of sort joins where every partition of the smaller side is proven small
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # lists are collected per document or per course, so many small groups fit a task's hash table
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("lectern")
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder of the cluster and read it back.

    The folder is the session's `spark.checkpoint.dir`. Only a local session that names none gets
    a folder of its own, so a cluster never writes to the disk of one machine. The files are columnar
    and compressed: a checkpoint of rows takes many times the disk.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or work_folder(spark, "cut")
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for sinks and stream state."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that Python workers anywhere can import it."""
    context = spark.sparkContext
    if getattr(context, "_lectern_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "lectern.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(os.path.join(root, "lectern")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    context._lectern_shipped = True
