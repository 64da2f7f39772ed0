"""Writers: versioned replacement, append-only logs and CSV exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm  # noqa: SLF001
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001


def replace(df: DataFrame, root: str) -> str:
    """Writes a new version beside the old one, then moves the pointer over the old one in one step: readers see the old rows until the new ones are whole.

    The step is the file system's own rename over an existing file: atomic on local disks (POSIX) and on HDFS.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    jvm, pointer, fs = _fs(spark, f"{root}/CURRENT")
    local = fs.getUri().getScheme() == "file"
    fs = fs.getRawFileSystem() if local else fs  # without a checksum file, which would be a second step
    new = jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT.{version}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    if local:
        fs.rename(new, pointer)
        return version
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)  # noqa: SLF001
    over[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, pointer, over)  # noqa: SLF001
    return version


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version that the pointer names."""
    version = spark.read.text(f"{root}/CURRENT").first()[0]
    return spark.read.parquet(f"{root}/{version}")


def append_log(df: DataFrame, root: str) -> None:
    """Appends to a log by day; nothing is ever rewritten."""
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(root)


def write_lines(lines: DataFrame, path: str) -> None:
    """One text column as lines, for exports made by ``records.export``."""
    lines.write.mode("overwrite").text(path)
