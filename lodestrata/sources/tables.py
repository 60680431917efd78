"""Parquet tables of one folder, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def version(spark: SparkSession, folder: str, name: str) -> str:
    """Changes when the table's files do: their number, sizes and times, from one listing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return f"{len(found)}-{sum(x.getLen() for x in found)}-{max((x.getModificationTime() for x in found), default=0)}"
