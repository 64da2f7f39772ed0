"""Places of interest and the gazetteer: classification, loading, and the build from map features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geocode import name_variants, place_radius_km
from .spatial import clusters, inside

# Name patterns of schools and shops that don't count.
SPECIAL = r"(?i)\bspecial school\b"
POST_PRIMARY = (
    r"(?i)\b(secondary|community school|community college|college|col[aá]iste|gaelchol[aá]iste|comprehensive|vocational|high school|grammar|post[- ]primary|"
    r"pobal ?scoil|pobail ?scoil|scoil phobail|scoil phobal|me[aá]n ?scoil|scoil chuimsitheach|gairm ?scoil|ard ?scoil)\b"
)
PRIMARY = r"(?i)\b(national school|n\.?\s?s\.?|scoil|bunscoil|primary|gaelscoil|infant|junior school)\b"
NOT_SHOPS = ("vacant", "car", "car_repair", "car_parts", "tyres", "motorcycle", "boat", "caravan", "trade", "agrarian", "funeral_directors", "storage_rental", "fuel")


def school_kind(name: Column, tag: Column) -> Column:
    """A special school by either; else the tag decides before the name, and post-primary names before primary ones."""
    name, tag = F.coalesce(name, F.lit("")), F.lower(F.coalesce(tag, F.lit("")))
    return (
        F.when(name.rlike(SPECIAL) | tag.isin("special", "special_education_needs"), "school_special")
        .when(tag.isin("secondary", "post_primary"), "school_post_primary")
        .when(tag == "primary", "school_primary")
        .when(name.rlike(POST_PRIMARY), "school_post_primary")
        .when(name.rlike(PRIMARY), "school_primary")
    )


def poi_kind() -> Column:
    """Of the columns name, amenity, shop, leisure, healthcare and school; null for what is no place of interest."""
    a, s, le, h = (F.coalesce(F.col(c), F.lit("")) for c in ("amenity", "shop", "leisure", "healthcare"))
    return (
        F.when(a == "school", school_kind(F.col("name"), F.col("school")))
        .when((a == "pharmacy") | (h == "pharmacy"), "pharmacy")
        .when((a == "doctors") | (h == "doctor"), "gp")
        .when(a.isin("restaurant", "cafe", "fast_food"), "restaurant")
        .when(s == "supermarket", "supermarket")
        .when((s != "") & ~s.isin(*NOT_SHOPS), "shop")
        .when(le == "park", "park")
        .when(le == "fitness_centre", "gym")
    )


def loaded_pois(held: DataFrame, new: DataFrame) -> DataFrame:
    """Sources that ``new`` brings replace their held rows; of rows with one reference the first (smallest row_id) stays."""
    once = new.groupBy("source", "source_ref").agg(F.min_by(F.struct("kind", "name", "lon", "lat"), "row_id").alias("r")).select("source", "source_ref", "r.*")
    kept = held.join(once.select("source").distinct(), "source", "left_anti")
    return kept.select(*once.columns).unionByName(once)


def build(streets: DataFrame, others: DataFrame, counties: DataFrame, reach_m: int = 250, cell: float = 30_000) -> DataFrame:
    """(kind, name, detail, ref, county, lon, lat, x, y): segments of one street name within reach of each other become one street, its place the
    segment nearest their middle and its detail the commonest (ties: the smallest); then all get the county whose polygon holds them.

    ``streets``: segment_id, name, detail, ref, lon, lat, x, y. ``others``: kind, name, detail, ref and positions. ``counties``: county, ring.
    """
    named = streets.withColumn("_name", F.lower("name"))
    found = named.join(clusters(named, "_name", "segment_id", reach_m), "segment_id")
    groups = found.groupBy("_name", "cluster").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.min("name").alias("_first"), F.min("ref").alias("_ref"))
    counted = found.groupBy("_name", "cluster", "detail").agg(F.count("*").alias("k"))
    usual = counted.groupBy("_name", "cluster").agg(F.max_by("detail", "k").alias("_any"), F.max("k").alias("_k")).drop("_any")
    usual = counted.join(usual, ["_name", "cluster"]).filter("k = _k").groupBy("_name", "cluster").agg(F.min("detail").alias("_detail"))
    away = F.pow(F.col("x") - F.col("mx"), F.lit(2)) + F.pow(F.col("y") - F.col("my"), F.lit(2))
    middle = found.join(groups, ["_name", "cluster"]).groupBy("_name", "cluster", "_first", "_ref").agg(F.min_by(F.struct("lon", "lat", "x", "y"), F.struct(away.alias("d"), "segment_id")).alias("p"))
    merged = middle.join(usual, ["_name", "cluster"]).select(F.lit("street").alias("kind"), F.col("_first").alias("name"), F.col("_detail").alias("detail"), F.col("_ref").alias("ref"), "p.*")
    features = merged.unionByName(others.select(*merged.columns)).withColumn("_id", F.xxhash64("kind", "name", "ref", "lon", "lat"))
    return features.join(inside(features.select("_id", "x", "y"), counties, "_id", "county", cell), "_id").drop("_id")


def official_places(areas: DataFrame) -> DataFrame:
    """(name, radius_m, …) of settlements and townlands: a row for each way of writing the name, English or Irish. ``areas``: area_id, name,
    name_ga, county, km2, lon, lat."""
    names = F.array_distinct(F.flatten(F.transform(F.filter(F.array("name", "name_ga"), lambda n: n.isNotNull() & (n != "")), name_variants)))
    radius = F.bround(place_radius_km(F.col("km2")) * 1000).cast("int")
    return areas.select("area_id", F.explode(names).alias("name"), "county", radius.alias("radius_m"), "lon", "lat")
