"""Streaming queries run to the end of what is there, so that their results are tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lintel.sources.scratch import root_of
from lintel.streaming import jobs as J

from .records import VIEWS_SQL
from .registry import query


#: All files of a table at once: they need not lie in the order of time, so that a later file's rows would be behind the watermark of the one before.
_ALL_FILES = 2**31 - 1


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.events(spark, f"{sf_dir}/events.parquet*", files_per_batch=_ALL_FILES)


def _drained(stream: DataFrame, mode: str, *keys: str) -> DataFrame:
    """Runs a stream over all files there are and returns what it wrote.

    ``update`` (windows, by ``keys``) holds provisional windows too; ``append`` only finished rows; ``complete`` is for sessions, which Spark
    can't update, where the last sessions of a table are wanted.
    """
    spark = stream.sparkSession
    root = f"{root_of(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        J.to_table(stream, f"{root}/out", f"{root}/state").awaitTermination()
    elif mode == "update":
        J.to_versions(stream, f"{root}/out", f"{root}/state").awaitTermination()
        written = spark.read.schema(StructType([*stream.schema.fields, StructField("version", LongType())])).parquet(f"{root}/out/*")
        return J.newest(written, *keys)
    else:
        write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/out")
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("SELECT CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS start_us, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(J.tumbling(_source(spark, sf_dir)), "update", "start", "event_type").select(F.unix_micros("start").alias("start_us"), "event_type", "n", "total")


@query("SELECT CAST((epoch_us(ts) // 21600000000 - i) * 21600000000 AS BIGINT) AS start_us, event_type, count(*) AS n FROM events, range(4) r(i) GROUP BY ALL")
def stream_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(J.rolling(_source(spark, sf_dir)), "update", "start", "event_type").select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is filed twice here and counted once."""
    twice = _source(spark, sf_dir).withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    return _drained(J.once(twice, "event_id", "ts").select("event_type"), "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS begins FROM events),
s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY us) AS k FROM e)
SELECT user_id, CAST(min(us) AS BIGINT) AS start_us, CAST(max(us) + 1800000000 AS BIGINT) AS end_us, count(*) AS n FROM s GROUP BY user_id, k"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _drained(J.sessions(_source(spark, sf_dir)), "complete")
    return found.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND value > 20 GROUP BY ALL")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts written batch by batch, then counted."""
    root = f"{root_of(spark)}/stream-{uuid.uuid4().hex}"
    J.alerts(_source(spark, sf_dir), lambda b: b.filter("event_type = 'error' and value > 20").select("user_id", "event_id"), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema("user_id long, event_id long, version int").parquet(f"{root}/out/*").groupBy("user_id").agg(F.count("*").alias("n"))


@query(VIEWS_SQL)
def stream_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequential view rule kept in state, as the batch form judges it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = _drained(J.counted_views(_source(spark, sf_dir), 21_600), "append")
    return found.select(F.col("event_id").alias("view_id"), "kept")
