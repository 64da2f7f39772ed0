"""Rows of map tiles: a grid of cells when far out, points and stacks when near."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.functions.geo import tile_box, web_mercator

SIDE, NEAR_ZOOM, MARGIN = 16, 14, 0.02


def cells(matches: DataFrame, z: int, x: int, y: int, least: int = 5) -> DataFrame:
    """(i, j, n, median, cx, cy) of the 16 x 16 cells of a tile; the median from ``least`` sales on; cx, cy: mean position in metres."""
    west, south, east, north = tile_box(z, x, y)
    size = (east - west) / SIDE
    px, py = web_mercator(F.col("lon"), F.col("lat"))
    rows = matches.select("cents", px.alias("px"), py.alias("py")).filter(F.col("px").between(west, east) & F.col("py").between(south, north))
    binned = rows.withColumn("i", F.floor((F.col("px") - west) / size).cast("int")).withColumn("j", F.floor((F.col("py") - south) / size).cast("int"))
    stats = binned.filter(F.col("i").between(0, SIDE - 1) & F.col("j").between(0, SIDE - 1)).groupBy("i", "j").agg(F.count("*").alias("n"), F.percentile("cents", F.lit(0.5)).alias("m"), F.avg("px").alias("cx"), F.avg("py").alias("cy"))
    return stats.select("i", "j", "n", F.when(F.col("n") >= least, F.floor(F.col("m") / 100 + 0.5).cast("long")).alias("median"), F.round("cx").cast("long").alias("cx"), F.round("cy").cast("long").alias("cy"))


def points(matches: DataFrame) -> DataFrame:
    """Sales of precisely placed properties, one feature each."""
    day = F.date_format("sale_date", "yyyyMMdd").cast("int")
    return matches.filter("precision <= 1").select("property_id", F.floor(F.col("cents") / 100 + 0.5).cast("long").alias("price"), day.alias("day"), "is_new", "precision")


def stacks(matches: DataFrame, least: int = 5) -> DataFrame:
    """Coarsely placed properties share a point: one feature a point."""
    grouped = matches.filter("precision > 1").groupBy("lon", "lat").agg(F.min("precision").alias("precision"), F.count("*").alias("n"), F.percentile("cents", F.lit(0.5)).alias("m"))
    return grouped.select("lon", "lat", "precision", "n", F.when(F.col("n") >= least, F.floor(F.col("m") / 100 + 0.5).cast("long")).alias("median"))
