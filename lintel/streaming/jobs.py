"""Structured Streaming jobs over event files: windows with late data, repeats, sessions, alerts and sequential rules.

Each takes a stream with ``ts`` as a timestamp and returns a stream (or starts a query, where it writes in batches). State is
bounded by the watermark: what is older than it is final and forgotten, what is newer is provisional.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, path: str, late: str = "1 hour", files_per_batch: int = 1) -> DataFrame:
    """Event files as they arrive. The files hold times without a zone; the session's zone (UTC) is theirs."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """Count and sum by type and hour, for clock-aligned limits and statistics."""
    rows = stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def rolling(stream: DataFrame, width: str = "1 day", slide: str = "6 hours") -> DataFrame:
    """Windows that overlap: each event counts in width / slide of them."""
    rows = stream.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n")


def once(stream: DataFrame, *keys: str) -> DataFrame:
    """Rows filed again within the watermark are dropped."""
    return stream.dropDuplicatesWithinWatermark([*keys])


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of a user's events without a pause of ``gap``."""
    rows = stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


class _Views(StatefulProcessor):
    """Keeps, for each bucket of keys, when the last view of each key that counts was: a call for state costs some milliseconds, so a bucket reads and writes its keys at once.

    A key goes once the watermark is a gap later: whatever comes then counts anyway. Buckets that get rows drop such keys themselves, and a timer
    at the end of its last key clears a bucket that gets none.
    """

    def __init__(self, gap_s: int) -> None:
        self.gap_us = gap_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "who array<string>, us array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.last.get()
        last = dict(zip(*held, strict=True)) if held else {}
        due = max(last.values(), default=None)
        # a bucket's rows of a micro-batch may come in several Arrow batches, in any order
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"])
        kept = []
        for who, us in zip(batch["who"], batch["us"], strict=True):
            counts = who not in last or us - last[who] > self.gap_us
            kept.append(counts)
            if counts:
                last[who] = int(us)
        yield pd.DataFrame({"event_id": batch["event_id"].to_numpy(), "kept": kept})
        end = max(last.values())
        if end != due:
            if due is not None:
                self.handle.deleteTimer(self._ends(due))
            self.handle.registerTimer(self._ends(end))
        # rows of the next micro-batch are not behind this one's watermark
        going = {who: us for who, us in last.items() if self._ends(us) > timerValues.getCurrentWatermarkInMs()}
        self.last.update((list(going), list(going.values())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter(())

    def _ends(self, us: int) -> int:
        """In milliseconds, rounded up and past the gap."""
        return (us + self.gap_us) // 1000 + 1

    def close(self) -> None:
        pass


def counted_views(stream: DataFrame, gap_s: int = 1800, buckets: int = 4096) -> DataFrame:
    """The sequential view rule with state: a view counts if no counted one of its user and type lies within the gap before it.

    Views of one micro-batch are judged in the order of their times; views behind the watermark are late and left out, as in all streams
    here. A key's state goes when the watermark is a gap past its last counted view. Keys share ``buckets``, a number that a checkpoint fixes: a micro-batch
    costs a few state calls for each bucket that it meets, however many keys there are.
    """
    who, bucket = F.to_json(F.struct("user_id", "event_type")), F.pmod(F.xxhash64("user_id", "event_type"), F.lit(buckets)).cast("int")
    rows = stream.select(bucket.alias("bucket"), who.alias("who"), "event_id", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("bucket").transformWithStateInPandas(_Views(gap_s), "event_id long, kept boolean", "Append", "EventTime")


def alerts(stream: DataFrame, matching: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Writes what matches of each new batch once: a batch that is run again overwrites its own folder."""

    def deliver(batch: DataFrame, number: int) -> None:
        matching(batch).withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_versions(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the rows that each batch changed, with the batch's number, in ``update`` mode: the watermark drops finished windows from the state, and no
    trigger writes anything again that did not change. ``newest`` reads them."""

    def deliver(batch: DataFrame, number: int) -> None:
        batch.withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(deliver).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(versions: DataFrame, *keys: str) -> DataFrame:
    """The last version of each key's row."""
    rest = [c for c in versions.columns if c not in (*keys, "version")]
    return versions.groupBy(*keys).agg(F.max(F.struct("version", *rest)).alias("x")).select(*keys, *(f"x.{c}" for c in rest))


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a finished stream of windows or rows as Parquet, exactly once by way of the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
