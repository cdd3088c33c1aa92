"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or setCheckpointDir; where neither is set, one of our own on a local master,
    else an error: a folder of one machine would hide each executor's files from the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file:///tmp/karst-scratch"
    return folder.rstrip("/")


def place(spark: SparkSession, path: str):
    """The file system of a path and the path, as Hadoop has them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared one, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/karst-{name}-{uuid.uuid4().hex}"
    fs, where = place(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def put(df: DataFrame, path: str, **options) -> DataFrame:
    """Writes a table and returns it as it stands there."""
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
