"""Folders that every machine of the cluster sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Unset, a local one will do on one machine (tests) and is an error elsewhere."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    folder = "file://" + tempfile.mkdtemp(prefix="scoreloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/scoreloom/{name}-{uuid.uuid4().hex}"


def path_of(spark: SparkSession, folder: str):
    """(file system, path) of a folder, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there.  The folder goes with the application."""
    spark = df.sparkSession
    folder = fresh_folder(spark, name)
    schema = df.schema
    df.write.parquet(folder)
    system, path = path_of(spark, folder)
    system.deleteOnExit(path)
    return spark.read.schema(schema).parquet(folder)
