"""Account records: alerts, views, limits, retention, sessions, queues, exports and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintel.functions.quantiles import selected
from lintel.functions.text import csv_safe

VIEW_GAP_S, IDLE_DAYS, TOUCH_S, NEWEST, KEEP_DAYS = 1800, 14, 300, 200, 365


def kept_views(views: DataFrame, gap_s: int = VIEW_GAP_S) -> DataFrame:
    """Adds ``kept``: a view counts only if no view *that counts* of its user and item lies within the gap before it.

    The rule is sequential: comparing with the row before would let a chain of close views hide each other. Rows are dealt by
    key and sorted; a task walks them batch by batch and holds one time a key, so that a user of any size fits.
    """
    keys = ["user_id", "item"]
    dealt = views.withColumn("_s", F.unix_micros("ts")).repartition(*keys).sortWithinPartitions(*keys, "_s", "view_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = None, 0
        for batch in batches:
            kept = []
            for key, s in zip(zip(batch["user_id"], batch["item"], strict=True), batch["_s"], strict=True):
                counts = key != at or s - last > gap_s * 1_000_000
                kept.append(counts)
                if counts:
                    at, last = key, s
            yield pd.DataFrame({"view_id": batch["view_id"], "kept": kept})

    return dealt.mapInPandas(walk, "view_id long, kept boolean")


def limited(calls: DataFrame, most: int, window_s: int) -> DataFrame:
    """(call_id, refused, retry_s): more than ``most`` calls of a key within a window that begins with its first call.

    Windows follow each other from call to call and not from the clock, so they are walked in order like the views above.
    """
    dealt = calls.withColumn("_s", F.unix_micros("ts")).repartition("user_id").sortWithinPartitions("user_id", "_s", "call_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, begun, n = None, 0, 0
        for batch in batches:
            refused, retry = [], []
            for key, s in zip(batch["user_id"], batch["_s"], strict=True):
                if key != at or s - begun >= window_s * 1_000_000:
                    at, begun, n = key, s, 0
                n += 1
                refused.append(n > most)
                retry.append(max(1, window_s - (s - begun) // 1_000_000) if n > most else 0)
            yield pd.DataFrame({"call_id": batch["call_id"], "refused": refused, "retry_s": retry})

    return dealt.mapInPandas(walk, "call_id long, refused boolean, retry_s long")


def newest(history: DataFrame, key: str, order: list[Column], most: int = NEWEST) -> DataFrame:
    """The newest ``most`` rows of each key: a feature of the history, not a sample."""
    return history.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def retained(rows: DataFrame, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    return rows.filter(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))


def live_sessions(sessions: DataFrame, roles: DataFrame, now: Column) -> DataFrame:
    """Sessions neither expired nor idle for too long, with the user's roles in order, and whether last_seen is due to be written again."""
    live = sessions.filter((F.col("expires_at") > now) & (F.col("last_seen") > now - F.make_dt_interval(F.lit(IDLE_DAYS))))
    named = roles.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    due = F.col("last_seen") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(TOUCH_S)))
    return live.join(named, "user_id", "left").select("session_id", "user_id", F.coalesce("roles", F.lit("")).alias("roles"), due.alias("touch"))


def new_matches(matches: DataFrame, sales: DataFrame, searches: DataFrame, delivered: DataFrame, ready: int) -> DataFrame:
    """(search_id, property_id, sale_date, cents): matches whose latest sale was first seen after what the search has been told of, up to run
    ``ready``. ``matches`` names the search it belongs to; ``searches``: search_id, through, active; claimed deliveries are left out."""
    due = searches.filter(F.col("active") & (F.coalesce("through", F.lit(0)) < ready)).select("search_id", F.coalesce("through", F.lit(0)).alias("through"))
    due = due.join(delivered.filter(F.col("version") == ready).select("search_id"), "search_id", "left_anti")
    seen = sales.filter(~F.col("withdrawn") & ~F.col("possible_duplicate")).select("property_id", "sale_date", "cents", "first_seen")
    met = matches.join(due, "search_id").join(seen, ["property_id", "sale_date", "cents"]).filter((F.col("first_seen") > F.col("through")) & (F.col("first_seen") <= ready))
    return met.select("search_id", "property_id", "sale_date", "cents").distinct()


def private_history(searches: DataFrame) -> DataFrame:
    """A user's own position is stored as a marker only, and a search made again moves to the top instead of being listed twice."""
    masked = searches.withColumn("params", F.regexp_replace("params", r"near=[-0-9.]+,[-0-9.]+", "near=here"))
    return masked.groupBy("user_id", "params").agg(F.max("ts").alias("ts"), F.count("*").alias("times"))


def export(rows: DataFrame, most: int, notice: str, *order: str) -> DataFrame:
    """The first rows by ``order`` as lines of a CSV file: capped by role (a feature), guarded against formulas, each with the notice's licence."""
    cells = [F.coalesce(csv_safe(F.col(c).cast("string")), F.lit("")) for c in rows.columns]
    quoted = [F.when(x.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.regexp_replace(x, '"', '""'), F.lit('"'))).otherwise(x) for x in cells]
    return rows.orderBy(*order).limit(most).select(F.concat_ws(",", *quoted, F.lit(notice)).alias("line"))


def summaries(properties: DataFrame, sales: DataFrame, area_stats: DataFrame, areas: DataFrame, vicinity: DataFrame) -> DataFrame:
    """(property_id, payload): the property page as JSON; absent values are left out.

    The area is the settlement if its median is published for the latest month, else the county. A property's sales are few; they are
    gathered newest first.
    """
    shown = sales.filter(~F.col("withdrawn") & ~F.col("possible_duplicate"))
    flags = F.struct(F.col("not_full_market").alias("notFullMarketPrice"), F.col("vat_exclusive").alias("vatExclusive"), F.col("bulk_group_id").isNotNull().alias("bulk"))
    one = F.struct("sale_date", "sale_id", F.struct(F.col("sale_date").alias("date"), F.col("cents"), flags.alias("flags")).alias("s"))
    lists = shown.groupBy("property_id").agg(F.reverse(F.array_sort(F.collect_list(one))).alias("l"))
    lists = lists.select("property_id", F.get("l", F.lit(0))["s"].alias("latestSale"), F.transform(F.slice("l", F.lit(2), F.size("l")), lambda x: x["s"]).alias("previousSales"))
    stats = area_stats.filter("segment = 'all' and median is not null").join(areas.select("area_id", "name", "kind"), "area_id")
    latest = stats.select("area_id", F.struct("name", "kind", "median", "n").alias("a"))
    near, wide = (latest.select(F.col("area_id").alias(k), F.col("a").alias(f"{k}_a")) for k in ("settlement_id", "county_id"))
    met = properties.join(near, "settlement_id", "left").join(wide, "county_id", "left").join(lists, "property_id", "left").join(vicinity, "property_id", "left")
    payload = F.struct(
        F.col("property_id").alias("id"),
        "address",
        "latestSale",
        F.coalesce("previousSales", F.array()).alias("previousSales"),
        F.coalesce("settlement_id_a", "county_id_a").alias("area"),
        F.struct("stop_m", "primary_m", "post_primary_m").alias("vicinity"),
    )
    return met.select("property_id", F.to_json(payload).alias("payload"))


def profile(rows: DataFrame, value: str, by: str) -> DataFrame:
    """A data report by year: counts, missing values, distinct values and quantiles. Values are counted before they meet, and no task holds a year's values."""
    counted = rows.groupBy(by, value).agg(F.count("*").alias("k"))
    held = F.col(value).isNotNull()
    totals = counted.groupBy(by).agg(F.sum("k").alias("rows"), F.coalesce(F.sum(F.when(~held, F.col("k"))), F.lit(0)).alias("missing"), F.count_if(held).alias("distinct"), F.min(value).alias("least"), F.max(value).alias("most"))
    found = totals.join(selected(counted.filter(held), [by], (0.01, 0.5, 0.99), value).withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left")
    return found.select(by, F.col("rows").alias("n"), "missing", "distinct", "least", "most", *(F.floor(F.col("q")[i] + 0.5).cast("long").alias(f"p{p}") for i, p in enumerate((1, 50, 99))))
