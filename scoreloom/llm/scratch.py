"""Tables written once and read many times, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What each owner wrote, by the thread that wrote it: two pipelines of one driver keep their own tables.
_WRITTEN: dict[tuple[int, str], list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.  Unset, a local one will do on one machine (tests) and is an error
    elsewhere."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="scoreloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, owner: str, partitions: list[str] | None = None) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read back: lineage ends here and any executor can reread it.
    The table goes with ``free``, or with the application."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/scoreloom/{owner}/{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.parquet(path)
    _WRITTEN.setdefault((threading.get_ident(), owner), []).append(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(schema).parquet(path)


def free(spark: SparkSession, owner: str) -> None:
    """Remove what ``owner`` wrote from this thread.  Call it only when no DataFrame over those tables is still to run."""
    for path in _WRITTEN.pop((threading.get_ident(), owner), []):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
