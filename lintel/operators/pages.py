"""What area pages, property pages and the sources page show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.sources.binding import PRECISIONS

from .market import change_permille
from .statistics import register_end

#: Rolling figures before a full first year of the register are not shown.
REGISTER_START = "2010-12-01"
#: The windows that headlines show: the last complete one and the one a year before it, in months before the latest month.
HEADLINE_LAGS = (2, 14)


def since_start(rolling: DataFrame, start: str = REGISTER_START) -> DataFrame:
    return rolling.filter(F.col("period") >= F.lit(start).cast("date"))


def headlines(rolling: DataFrame, sales: DataFrame, areas: DataFrame, index: DataFrame) -> DataFrame:
    """Each area's last complete twelve months beside the country's, the change on the year before, and its price index over a year.

    Complete means up to two months before the end of the register. ``index``: area_id, period, value; the latest month against the same
    month a year earlier.
    """
    end = F.broadcast(register_end(sales).select(F.add_months("last_month", -HEADLINE_LAGS[0]).alias("end")))
    wanted = rolling.filter("segment = 'all'").join(end, F.col("period").isin(F.col("end"), F.add_months("end", -12)))
    now = wanted.filter("period = end").select("area_id", "end", "n", "median")
    before = wanted.filter("period < end").select("area_id", F.col("median").alias("median_before"))
    country = F.broadcast(now.filter("area_id = 0").select(F.col("median").alias("national")))
    last = index.groupBy("area_id").agg(F.max("period").alias("period"))
    moved = last.join(index, ["area_id", "period"]).select("area_id", "value", F.add_months("period", -12).alias("period")).join(index.withColumnRenamed("value", "value_before"), ["area_id", "period"])
    moved = moved.select("area_id", change_permille(F.col("value"), F.col("value_before")).alias("index_change"))
    met = areas.join(now, "area_id", "left").join(before, "area_id", "left").join(moved, "area_id", "left").join(country)
    return met.select("area_id", "kind", "name", F.date_sub(F.add_months("end", 1), 1).alias("window_end"), "n", "median", "national", change_permille(F.col("median"), F.col("median_before")).alias("change"), "index_change")


def caveats(properties: DataFrame, sales: DataFrame) -> DataFrame:
    """(property_id, caveats): the notes a property's page needs, in their order, joined by commas."""
    provisional = F.col("sale_date") >= F.add_months("last_month", -1)
    shown = sales.filter(~F.col("withdrawn")).join(F.broadcast(register_end(sales)))
    found = shown.groupBy("property_id").agg(F.bool_or("vat_exclusive").alias("vat"), F.bool_or("not_full_market").alias("market"), F.bool_or(F.col("bulk_group_id").isNotNull()).alias("bulk"), F.bool_or(provisional).alias("late"))
    met = properties.join(found, "property_id", "left")
    place = F.when(F.col("precision") == len(PRECISIONS) - 1, "unplaced").when(F.col("precision") > 1, "approximate")
    notes = F.array(place, F.when(F.col("vat"), "without_vat"), F.when(F.col("market"), "not_market"), F.when(F.col("bulk"), "bulk"), F.when(F.col("late"), "provisional"))
    return met.select("property_id", F.array_join(F.array_compact(notes), ",").alias("caveats"))


def catalogue(sources: DataFrame) -> DataFrame:
    """Adds ``listed``: in_use, planned or not_used. ``sources``: use, loaded."""
    return sources.withColumn("listed", F.when(~F.col("use"), "not_used").when(F.col("loaded"), "in_use").otherwise("planned"))


def to_sync(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """What has to be added to and removed from a held set of pairs to make it the wanted one."""
    add, remove = wanted.exceptAll(held).distinct(), held.exceptAll(wanted).distinct()
    return add.withColumn("action", F.lit("add")).unionByName(remove.withColumn("action", F.lit("remove")))
