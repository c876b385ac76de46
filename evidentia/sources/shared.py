"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN: list[str] = []  # the folder of a session that has none


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one where it is unset and all runs
    on this machine."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        if not OWN:
            OWN.append(f"file://{tempfile.mkdtemp(prefix='evidentia-')}")
        folder = OWN[0]
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/evidentia/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended: the folder's owner cleans up
        pass


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there, and lost executors cost no rerun."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
