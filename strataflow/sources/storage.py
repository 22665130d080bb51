"""The folder that driver and executors share, and tables written to it to end a plan's lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the library from where it is; on a cluster it is installed."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (env.get("PYTHONPATH", ""), root) if p)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where none is set and driver and executors are one process, as in tests, a local
    folder is made and set; on a cluster that names none there is no folder that all of it shares."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="strataflow-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def write(df: DataFrame, label: str, folder: str | None = None) -> str:
    """Writes a table to the shared folder, or to another that is shared, and returns where."""
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}" if folder else fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there. Unlike a cache it survives the loss
    of any executor. `dropped` gives the folder back once nothing reads it any more."""
    path = write(df, label)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, wherever it is, and the path as Hadoop has it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Removes what `cut` wrote for these tables. Only tables that no plan still to run reads."""
    for df in tables:
        if path := getattr(df, "_written", None):
            drop_path(df.sparkSession, path)
