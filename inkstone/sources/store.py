"""Intermediate tables that several steps read: written once to a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of its own only on a local master where none is named, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="inkstone-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table and read again: lineage is cut, and readers prune columns.

    The table goes when the application ends, which is after any use of what is read from it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/inkstone-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)
