"""Price index calibration, price estimates and comparable sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintel.functions import text as T

from .blocks import ranked_within
from .geocode import PLAIN_STREET_WORDS
from .market import is_market, is_plain, latest

LEAST_CENTS, LEAST_GAP_MONTHS, RECENT_MONTHS, LEAST_PAIRS, ROUND_TO = 1_000_000, 6, 6, 150, 1000
QUANTILES = (0.1, 0.5, 0.9)
_STREET_WORD = r"\b(" + "|".join(w for w in PLAIN_STREET_WORDS if w not in ("upper", "lower", "north", "south", "east", "west", "new", "old", "little", "great", "main", "church")) + r"|rd|ave|st|tce|pk)\b"


def gap_band_days(days: Column) -> Column:
    return F.when(days < 3 * 365.25, "0-3y").when(days < 7 * 365.25, "3-7y").otherwise("7y+")


def gap_band_months(months: Column) -> Column:
    """Bands by whole months: at exactly 36 and 84 months this differs from the bands by days, as the figures it reproduces do."""
    return F.when(months < 36, "0-3y").when(months < 84, "3-7y").otherwise("7y+")


def repeat_pairs(sales: DataFrame, series: DataFrame) -> DataFrame:
    """(property_id, series, m1, cents1, m2, cents2): consecutive plain sales of a property. ``series``: property_id, series of precisely placed ones."""
    rows = sales.filter(is_plain() & (F.col("cents") >= LEAST_CENTS)).join(series, "property_id")
    w = W.partitionBy("property_id").orderBy("sale_date", "sale_id")
    month = F.trunc("sale_date", "MM")
    pairs = rows.select("property_id", "series", F.lag(month).over(w).alias("m1"), F.lag("cents").over(w).alias("cents1"), month.alias("m2"), F.col("cents").alias("cents2"))
    return pairs.filter(F.col("m2") >= F.add_months("m1", LEAST_GAP_MONTHS))


def index_errors(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Adds the log of what the second price is of the first one carried along by the index; pairs without both months go. The index has
    one row a series and month and is joined by key, so Spark sends it along while it is small."""
    at = lambda n: index.select("series", F.col("period").alias(f"m{n}"), F.col("value").alias(f"i{n}"))
    met = pairs.join(at(1), ["series", "m1"]).join(at(2), ["series", "m2"])
    return met.withColumn("error", F.log(F.col("cents2") / (F.col("cents1") * F.col("i2") / F.col("i1"))))


def calibrate(errors: DataFrame) -> DataFrame:
    """(series, band, n, p10, p50, p90) for each series and for all together, in millionths of a log."""
    named = errors.select(F.explode(F.array(F.col("series").cast("string"), F.lit("all"))).alias("series"), gap_band_days(F.datediff("m2", "m1")).alias("band"), F.round(F.col("error") * 1_000_000).cast("long").alias("e"))
    counted = named.groupBy("series", "band", "e").agg(F.count("*").alias("k"))
    found = counted.groupBy("series", "band").agg(F.sum("k").alias("n"), F.expr("percentile(e, array(0.1D, 0.5D, 0.9D), k)").alias("q"))
    return found.select("series", "band", "n", *(F.floor(F.col("q")[i] + 0.5).cast("long").alias(f"p{int(p * 100)}") for i, p in enumerate(QUANTILES)))


def estimates(properties: DataFrame, sales: DataFrame, index: DataFrame, calibration: DataFrame) -> DataFrame:
    """Per property (property_id, series, precision): low, mid, high in whole thousands, or the first reason why there is none.

    Reasons in order: location, no_market_sale, no_index, before_index, recent, and no_index again for a blank month or a missing calibration.
    A series' own calibration counts from LEAST_PAIRS pairs on, else the pooled one.
    """
    last = latest(sales.filter(is_plain()).select("property_id", "sale_date", "sale_id", "cents"), "property_id", "sale_date", "sale_id")
    spans = index.groupBy("series").agg(F.min("period").alias("first"), F.max(F.struct("period", "value")).alias("now"))
    month = F.trunc("sale_date", "MM")
    then = index.select("series", F.col("period").alias("sold_month"), F.col("value").alias("then"))
    met = properties.join(last, "property_id", "left").join(F.broadcast(spans), "series", "left").withColumn("sold_month", month)
    met = met.join(then, ["series", "sold_month"], "left")
    months = (F.year("now.period") - F.year("sold_month")) * 12 + F.month("now.period") - F.month("sold_month")
    met = met.withColumn("months", months).withColumn("band", gap_band_months(F.col("months")))
    own = calibration.filter((F.col("series") != "all") & (F.col("n") >= LEAST_PAIRS)).select(F.col("series").cast("int").alias("series"), "band", F.struct("n", "p10", "p50", "p90").alias("own"))
    pooled = calibration.filter("series = 'all'").select("band", F.struct("n", "p10", "p50", "p90").alias("pooled"))
    met = met.join(F.broadcast(own), ["series", "band"], "left").join(F.broadcast(pooled), "band", "left").withColumn("c", F.coalesce("own", "pooled"))
    reason = (
        F.when(F.col("precision") > 1, "location")
        .when(F.col("sale_id").isNull(), "no_market_sale")
        .when(F.col("first").isNull(), "no_index")
        .when(F.col("sold_month") < F.col("first"), "before_index")
        .when(F.col("months") < RECENT_MONTHS, "recent")
        .when(F.col("then").isNull() | F.col("c").isNull(), "no_index")
    )
    mid = F.col("cents") / 100 * F.col("now.value") / F.col("then")
    price = lambda x: F.when(F.col("reason").isNull(), F.bround(x / ROUND_TO).cast("long") * ROUND_TO)
    met = met.withColumn("reason", reason)
    error = lambda p: F.exp(F.col(f"c.{p}") / 1_000_000)
    return met.select("property_id", "reason", price(mid * error("p10")).alias("low"), price(mid).alias("mid"), price(mid * error("p90")).alias("high"), F.when(F.col("reason").isNull(), F.col("own").isNull()).alias("pooled"))


def comparables(wanted: DataFrame, properties: DataFrame, sales: DataFrame, places: DataFrame, since: Column, radius_m: int = 500, size: int = 20, least: int = 5) -> DataFrame:
    """For each wanted property (property_id, lon, lat, address): its nearest latest market sales since a day, and their median.

    Properties within the radius meet in blocks and are never listed as pairs (``ranked_within``). The median is of prices that hold the tax and needs ``least`` of them; the list has
    those that share a street part first, then the nearest, then the newest. A part that names one of ``places`` (name) says where and
    not which street, unless it has a street word in it.
    """
    last = latest(sales.filter(is_market() & (F.col("sale_date") > since)).select("property_id", "sale_date", "sale_id", "cents", "vat_exclusive"), "property_id", "sale_date", "sale_id")
    there = properties.join(last, "property_id").withColumn("streets", T.street_parts(F.lower("address"))).select(F.col("property_id").alias("other_id"), "lon", "lat", "streets", "sale_date", "sale_id", "cents", "vat_exclusive")
    parts = wanted.select("property_id", F.explode(T.street_parts(F.lower("address"))).alias("part"))
    elsewhere = parts.filter(~F.col("part").rlike(_STREET_WORD)).join(places.select(F.lower("name").alias("part")).distinct(), "part", "left_semi")
    streets = parts.join(elsewhere.withColumn("_out", F.lit(True)), ["property_id", "part"], "left").filter("_out is null")
    mine = streets.groupBy("property_id").agg(F.collect_set("part").alias("own"))
    here = wanted.select("property_id", "lon", "lat").join(mine, "property_id", "left")
    near = ranked_within(here, there.withColumn("full", F.coalesce(~F.col("vat_exclusive"), F.lit(False))), "property_id", radius_m, size)
    median = F.when(F.col("full_n") >= least, F.col("median")).alias("median")
    return near.select("property_id", "place", "other_id", F.col("m").alias("distance_m"), F.col("same").alias("same_street"), "sale_date", "cents", "total", F.col("full_n").alias("median_n"), median)
