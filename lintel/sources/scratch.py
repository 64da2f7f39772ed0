"""Intermediate tables in the cluster's shared folder: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root_of(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a folder of our own in local mode (tests), and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lintel-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def kept(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; the table goes when the session ends."""
    spark = df.sparkSession
    path = f"{root_of(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)  # noqa: SLF001
    out = spark.read.schema(df.schema).parquet(path)
    out._lintel_path = path  # noqa: SLF001
    return out


def drop(*frames: DataFrame) -> None:
    """Removes tables of ``kept`` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df._lintel_path)  # noqa: SLF001
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
