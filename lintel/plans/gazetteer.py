"""Queries over places of interest and the gazetteer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import geo
from lintel.operators import gazetteer as G
from lintel.operators import geocode
from lintel.sources import binding as B

from .places import rectangles
from .registry import query


@query(
    """WITH t AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'school' WHEN 1 THEN 'pharmacy' WHEN 2 THEN 'doctors' WHEN 3 THEN 'cafe' ELSE '' END AS amenity,
  CASE p_partkey % 9 WHEN 4 THEN 'supermarket' WHEN 5 THEN 'bakery' WHEN 6 THEN 'tyres' ELSE '' END AS shop, CASE p_partkey % 9 WHEN 7 THEN 'park' WHEN 8 THEN 'fitness_centre' ELSE '' END AS leisure,
  CASE (p_partkey // 9) % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'special' ELSE '' END AS tag FROM part)
SELECT p_partkey, CASE WHEN amenity = 'school' THEN CASE tag WHEN 'special' THEN 'school_special' WHEN 'secondary' THEN 'school_post_primary' WHEN 'primary' THEN 'school_primary' END WHEN amenity = 'pharmacy' THEN 'pharmacy' WHEN amenity = 'doctors' THEN 'gp'
  WHEN amenity = 'cafe' THEN 'restaurant' WHEN shop = 'supermarket' THEN 'supermarket' WHEN shop = 'bakery' THEN 'shop' WHEN leisure = 'park' THEN 'park' WHEN leisure = 'fitness_centre' THEN 'gym' END AS kind FROM t"""
)
def poi_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags spread over the parts, classified."""
    key = F.col("p_partkey")
    pick = lambda of, size, table: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), (of % size).cast("int")), F.lit(""))
    tags = B.read(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_name").alias("name"),
        pick(key, 9, {0: "school", 1: "pharmacy", 2: "doctors", 3: "cafe"}).alias("amenity"),
        pick(key, 9, {4: "supermarket", 5: "bakery", 6: "tyres"}).alias("shop"),
        pick(key, 9, {7: "park", 8: "fitness_centre"}).alias("leisure"),
        F.lit("").alias("healthcare"),
        pick(F.floor(key / 9), 4, {0: "primary", 1: "secondary", 2: "special"}).alias("school"),
    )
    return tags.select("p_partkey", G.poi_kind().alias("kind"))


@query(
    """WITH n AS (SELECT s_suppkey AS row_id, 'source' || CAST(s_suppkey % 3 AS VARCHAR) AS source, CAST(s_suppkey // 2 AS VARCHAR) AS source_ref, s_name AS name FROM supplier WHERE s_suppkey % 3 <> 2),
o AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY source, source_ref ORDER BY row_id) = 1)
SELECT source, source_ref, name FROM o UNION ALL SELECT 'source' || CAST(s_suppkey % 3 AS VARCHAR), 'held' || CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE s_suppkey % 3 = 2"""
)
def poi_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three sources come anew and replace their held rows; one reference stays one row."""
    rows = B.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), F.concat(F.lit("source"), (F.col("s_suppkey") % 3).cast("string")).alias("source"), F.lit("shop").alias("kind"), F.col("s_name").alias("name"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    held = rows.withColumn("source_ref", F.concat(F.lit("held"), F.col("row_id").cast("string")))
    new = rows.filter("row_id % 3 <> 2").withColumn("source_ref", F.expr("cast(row_id div 2 as string)"))
    return G.loaded_pois(held, new).select("source", "source_ref", "name")


_POINT = f"SELECT poi_id, kind, lon, lat, {geo.to_metres_sql('lon', 'lat')} FROM poi"
_NEAR = geo.distance_sql("a.lon", "a.lat", "b.lon", "b.lat")


@query(
    f"""WITH q AS ({_POINT}), l AS (SELECT a.poi_id AS a, b.poi_id AS b FROM q a JOIN q b ON a.kind = b.kind AND {_NEAR} * 1000 <= 25000),
r AS (SELECT poi_id AS a, poi_id AS b FROM q UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), c AS (SELECT a AS poi_id, min(b) AS cluster FROM r GROUP BY ALL),
g AS (SELECT q.*, cluster, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM q JOIN c USING (poi_id) WINDOW w AS (PARTITION BY cluster)),
p AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY power(x - mx, 2) + power(y - my, 2), poi_id) = 1),
b AS (SELECT 100 + n_nationkey AS county, (n_nationkey % 5) * 50000 - 140000 AS x0, (n_nationkey // 5) * 80000 - 220000 AS y0 FROM nation)
SELECT p.kind AS name, p.cluster AS ref, CAST(min(b.county) AS BIGINT) AS county, CAST(p.x AS BIGINT) AS x, CAST(p.y AS BIGINT) AS y FROM p JOIN b ON x BETWEEN x0 AND x0 + 52000 AND y BETWEEN y0 AND y0 + 70000 GROUP BY ALL""",
    "poi",
)
def gazetteer_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street segments (places of one kind as one name) merged within 25 km, placed at the segment nearest the middle, with their area."""
    pois = B.places_of_interest(spark, sf_dir)
    x, y = geo.to_metres(F.col("lon"), F.col("lat"))
    segments = pois.select(F.col("poi_id").alias("segment_id"), F.col("kind").alias("name"), F.lit("residential").alias("detail"), F.col("poi_id").alias("ref"), "lon", "lat", x.cast("double").alias("x"), y.cast("double").alias("y"))
    none = segments.limit(0).select(F.lit("place").alias("kind"), "name", "detail", "ref", "lon", "lat", "x", "y")
    built = G.build(segments, none, rectangles(spark, sf_dir).withColumnRenamed("area_id", "county"), 25_000)
    return built.select("name", "ref", "county", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query(
    """SELECT c_custkey AS area_id, CASE WHEN i = 0 THEN 'Town' || c_custkey || ' (Village' || c_custkey || ')' WHEN i = 1 THEN 'Town' || c_custkey WHEN i = 2 THEN 'Village' || c_custkey ELSE 'Baile' || c_custkey END AS name,
  CAST(round_even(least(sqrt(CAST(c_custkey AS DOUBLE) / 10 / pi()) + 0.5::DOUBLE, 4.0::DOUBLE) * 1000, 0) AS INTEGER) AS radius_m FROM customer, range(4) r(i) WHERE i < 3 OR c_custkey % 2 = 0"""
)
def official_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in every way of writing them, reaching as far as the area's size says."""
    key = F.col("c_custkey")
    areas = B.read(spark, sf_dir, "customer").select(
        key.alias("area_id"), F.concat(F.lit("Town"), key.cast("string"), F.lit(" (Village"), key.cast("string"), F.lit(")")).alias("name"), F.when(key % 2 == 0, F.concat(F.lit("Baile"), key.cast("string"))).alias("name_ga"), F.lit("x").alias("county"), (key.cast("double") / 10).alias("km2"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat")
    )
    return G.official_places(areas).select("area_id", "name", "radius_m")


@query(
    """WITH s AS (SELECT property_id, unnest(range(0, 3)) AS step FROM property), a AS (SELECT 'q' || CAST(i AS VARCHAR) AS query, CASE WHEN i % 4 <> 0 THEN i END AS candidate_id FROM range(0, 50) r(i))
SELECT property_id, arg_min(candidate_id, step) AS candidate_id, CAST(min(step) AS INTEGER) AS step FROM s JOIN a ON a.query = 'q' || CAST((property_id * 3 + step * 7) % 60 AS VARCHAR) WHERE candidate_id IS NOT NULL GROUP BY ALL""",
    "property",
)
def ladder_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first accepted step of each property's queries; fifty distinct answers, some refused, some missing."""
    step = lambda i: F.struct(F.concat(F.lit("q"), ((F.col("property_id") * 3 + i * 7) % 60).cast("string")).alias("query"))
    asked = B.properties(spark, sf_dir).select("property_id", F.array(*map(step, range(3))).alias("steps"))
    answers = spark.range(50).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("query"), F.when(F.col("id") % 4 != 0, F.col("id")).alias("candidate_id"), F.lit(1).alias("level"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    return geocode.ladder_picks(asked, answers).select("property_id", "candidate_id", "step")
