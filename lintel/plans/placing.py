"""Queries over placements: matches in the local gazetteer, the whole cascade, corrections by hand and what they count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import geo, text
from lintel.operators import geocode as G
from lintel.operators import spatial as S
from lintel.sources import binding as B

from .places import _BOX, precise
from .registry import query

#: The streets of ``binding.STREETS`` as the gazetteer spells them.
STREETS = ("Main Street", "Church Road", "Mill Avenue", "Abbey Terrace", "Saint Brigid's Park", "Bridge Street Lower", "Tullow Road")

_CENTRES = "centre AS (SELECT n_nationkey AS n, n_regionkey AS r, -9.0::DOUBLE + n_regionkey + (n_nationkey % 3) * 0.12::DOUBLE AS clon, 52.0::DOUBLE + n_regionkey * 0.3::DOUBLE + (n_nationkey % 4) * 0.1::DOUBLE AS clat FROM nation)"
_AWAY = geo.distance_sql("f.lon", "f.lat", "c.clon", "c.clat")
_PAIR = geo.distance_sql("a.lon", "a.lat", "b.lon", "b.lat")
_LOCAL = f"""{_CENTRES},
asked AS (SELECT c_custkey AS id, n_nationkey AS n, n_regionkey AS r, (c_custkey * 13) % 7 AS s, c_custkey % 60 + 1 AS h, c_custkey % 3 AS v, m
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT n_regionkey, min(n_nationkey) AS m FROM nation GROUP BY ALL) USING (n_regionkey)),
feature AS (
  SELECT n, r, s, CAST(1000 + (n * 7 + s) * 3 + k AS BIGINT) AS feature_id, CASE WHEN s = 2 AND k = 1 THEN 'estate' ELSE 'street' END AS kind, CAST(NULL AS BIGINT) AS h, clon + (s * 5 + k * (n % 4)) * 0.004::DOUBLE AS lon, clat + (k * (s % 3)) * 0.004::DOUBLE AS lat
  FROM centre, range(7) a(s), range(3) b(k)
  UNION ALL SELECT n, r, s, CAST(100000 + ((n * 7 + s) * 61 + h) * 2 + k AS BIGINT), 'address', h, clon + s * 0.006::DOUBLE + k * (n % 5) * 0.0013::DOUBLE, clat + h * 0.0005::DOUBLE
  FROM centre, range(7) a(s), range(1, 61) b(h), range(2) e(k) WHERE (n + s + h) % 4 = 0 AND (k = 0 OR h % 8 = 0)),
met AS (SELECT id, asked.n, m, v, f.feature_id, f.kind, f.lon, f.lat, CASE WHEN f.kind = 'address' THEN 0 ELSE 1 END AS level, {_AWAY} - (2.0 + c.n % 3) - CASE WHEN f.kind = 'street' THEN 0.5 ELSE 0 END AS over
  FROM asked JOIN feature f ON f.r = asked.r AND f.s = asked.s AND (f.kind <> 'address' OR f.h = asked.h) AND (f.kind = 'address' OR f.r <> 3 OR f.s <> 6)
  JOIN centre c ON c.n = CASE WHEN v = 2 THEN m ELSE asked.n END WHERE (v <> 1 OR asked.s NOT IN (0, 1)) AND over <= 0),
spread AS (SELECT a.id, a.level FROM met a JOIN met b ON a.id = b.id AND a.level = b.level GROUP BY ALL HAVING max({_PAIR}) <= CASE WHEN a.level = 0 THEN 0.2 ELSE 1.0 END),
best AS (SELECT met.* FROM met JOIN spread USING (id, level) QUALIFY row_number() OVER (PARTITION BY id, level ORDER BY kind <> 'street', over, feature_id) = 1),
local_place AS (SELECT f.id AS property_id, f.feature_id, f.level, f.lon, f.lat FROM best f JOIN centre c ON c.n = f.n WHERE v <> 2 OR ({_AWAY} - (2.0 + c.n % 3) <= 20)
  QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY f.level) = 1)"""


def _place(name: Column) -> Column:
    """A nation's name without digits, which names of places don't count by."""
    return F.concat(F.lit("Bally"), F.translate(F.regexp_replace(name, "[^A-Za-z0-9]", ""), "0123456789", "abcdefghij"))


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place for each nation, in clumps of one county."""
    n, r = F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")
    named = B.read(spark, sf_dir, "nation").join(B.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lon, lat = F.lit(-9.0) + r + (n % 3) * 0.12, F.lit(52.0) + r * 0.3 + (n % 4) * 0.1
    return named.select(n.alias("n"), r.alias("r"), F.lower("r_name").alias("county"), _place(F.col("n_name")).alias("name"), lon.alias("clon"), lat.alias("clat"))


def gazetteer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, their streets (three pieces each, one of them an estate), houses, and a place named like a street."""
    at, n, s, k, h = centres(spark, sf_dir), F.col("n"), F.col("s"), F.col("k"), F.col("h")
    numbers = lambda a, b: F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b).cast("long")))
    street = F.element_at(F.array(*map(F.lit, STREETS)), (s + 1).cast("int"))
    row = lambda df, key, kind, name, house, lon, lat, radius: df.select(key.alias("feature_id"), "county", kind.alias("kind"), name.alias("name"), house.cast("string").alias("house_number"), lon.alias("lon"), lat.alias("lat"), radius.cast("double").alias("radius_km"))
    none, no_reach = F.lit(None), F.lit(0.0)
    places = row(at, n, F.lit("place"), F.col("name"), none, F.col("clon"), F.col("clat"), n % 3 + 2)
    twin = row(at.filter("r = 3").groupBy("county").agg(F.min("clon").alias("clon"), F.min("clat").alias("clat")), F.lit(500).cast("long"), F.lit("place"), F.lit(STREETS[6]), none, F.col("clon"), F.col("clat"), F.lit(3))
    cut = at.withColumn("s", numbers(0, 6)).withColumn("k", numbers(0, 2))
    kind = F.when((s == 2) & (k == 1), "estate").otherwise("street")
    streets = row(cut, (n * 7 + s) * 3 + k + 1000, kind, street, none, F.col("clon") + (s * 5 + k * (n % 4)) * 0.004, F.col("clat") + (k * (s % 3)) * 0.004, no_reach)
    doors = at.withColumn("s", numbers(0, 6)).withColumn("h", numbers(1, 60)).withColumn("k", numbers(0, 1)).filter(((n + s + h) % 4 == 0) & ((k == 0) | (h % 8 == 0)))
    houses = row(doors, ((n * 7 + s) * 61 + h) * 2 + k + 100_000, F.lit("address"), street, h, F.col("clon") + s * 0.006 + k * (n % 5) * 0.0013, F.col("clat") + h * 0.0005, no_reach)
    return places.unionByName(twin).unionByName(streets).unionByName(houses)


def asked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each address: house and street, for a third an unknown part, for a third the county's first place, then the place."""
    at = centres(spark, sf_dir)
    first = at.groupBy("county").agg(F.min_by("name", "n").alias("first"))
    cut = F.split(F.regexp_replace("address", "^Apt [0-9]+, ", ""), ", ")
    middle = F.when(F.col("property_id") % 3 == 1, F.array(F.lit("Somewhere"))).when(F.col("property_id") % 3 == 2, F.array("first")).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.slice(cut, 1, 1), middle, F.array(_place(F.get(cut, 1))))
    return B.properties(spark, sf_dir).join(first, "county").select("property_id", "county", parts.alias("parts"))


@query(f"WITH {_LOCAL} SELECT property_id, feature_id, level FROM local_place")
def local_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most specific part of each address found near a place that a later part names."""
    found = G.local_match(asked_parts(spark, sf_dir), gazetteer_features(spark, sf_dir))
    return found.select("property_id", "feature_id", F.col("level").cast("int").alias("level"))


_MEDIANS = "SELECT routing_key, quantile_cont(lon, 0.5) AS lon, quantile_cont(lat, 0.5) AS lat FROM property WHERE precision <= 1 GROUP BY ALL HAVING count(*) >= 3"


def uniquely_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(property_id, lon, lat): the one feature of the county with the name that an address gives: its place, or in three of four its street, which many places have."""
    features = gazetteer_features(spark, sf_dir).filter("kind <> 'address'")
    cut = F.split(F.regexp_replace("address", "^(Apt [0-9]+, )?[0-9]+ ", ""), ", ")
    wanted = B.properties(spark, sf_dir).select(F.col("property_id").alias("wanted_id"), "county", F.when(F.col("property_id") % 4 == 0, _place(F.get(cut, 1))).otherwise(F.get(cut, 0)).alias("name"))
    found = G.unique_names(features.select("feature_id", "county", "name"), wanted)
    return found.join(features.select("feature_id", "lon", "lat"), "feature_id").select(F.col("wanted_id").alias("property_id"), "lon", "lat")


@query(
    f"""WITH {_CENTRES}, d AS ({_MEDIANS}), c AS (SELECT county, round(avg(lon), 3) AS lon, round(avg(lat), 3) AS lat FROM property GROUP BY ALL), o AS (SELECT property_id, clon AS lon, clat AS lat FROM property JOIN centre ON n = settlement_id - 100 WHERE property_id % 4 = 0)
SELECT property_id, CASE WHEN p.precision <= 2 THEN 'own' WHEN o.lon IS NOT NULL THEN 'unique_name' WHEN d.lon IS NOT NULL THEN 'routing_key' ELSE 'county' END AS method,
  round(CASE WHEN p.precision <= 2 THEN p.lon WHEN o.lon IS NOT NULL THEN o.lon ELSE coalesce(d.lon, c.lon) END, 6) AS lon, round(CASE WHEN p.precision <= 2 THEN p.lat WHEN o.lon IS NOT NULL THEN o.lat ELSE coalesce(d.lat, c.lat) END, 6) AS lat
FROM property p LEFT JOIN o USING (property_id) LEFT JOIN d USING (routing_key) LEFT JOIN c USING (county)""",
    "property",
)
def placement_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own place, unique name, routing key's median, county's point."""
    places = B.properties(spark, sf_dir)
    counties = places.groupBy("county").agg(F.round(F.avg("lon"), 3).alias("lon"), F.round(F.avg("lat"), 3).alias("lat"))
    found = G.fallbacks(places, uniquely_named(spark, sf_dir), S.median_points(precise(spark, sf_dir), "routing_key", least=3), counties)
    return found.select("property_id", "method", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(
    f"""WITH {_LOCAL}, k AS ({_MEDIANS}),
t AS (SELECT lower(r_name) AS county, arg_min(clon, n) AS lon, arg_min(clat, n) AS lat FROM centre JOIN region ON r_regionkey = r WHERE r < 4 GROUP BY ALL),
c AS (SELECT county, round(avg(lon), 3) AS lon, round(avg(lat), 3) AS lat FROM property GROUP BY ALL)
SELECT property_id, CASE WHEN p.precision <= 2 THEN 'own' WHEN l.lon IS NOT NULL THEN 'local' WHEN o.lon IS NOT NULL THEN 'unique_name' WHEN k.lon IS NOT NULL THEN 'routing_key' WHEN t.lon IS NOT NULL THEN 'county_town' ELSE 'county' END AS method,
  round(CASE WHEN p.precision <= 2 THEN p.lon WHEN l.lon IS NOT NULL THEN l.lon WHEN o.lon IS NOT NULL THEN o.lon ELSE coalesce(k.lon, t.lon, c.lon) END, 6) AS lon,
  round(CASE WHEN p.precision <= 2 THEN p.lat WHEN l.lon IS NOT NULL THEN l.lat WHEN o.lon IS NOT NULL THEN o.lat ELSE coalesce(k.lat, t.lat, c.lat) END, 6) AS lat
FROM property p LEFT JOIN local_place l USING (property_id) LEFT JOIN (SELECT property_id, clon AS lon, clat AS lat FROM property JOIN centre ON n = settlement_id - 100 WHERE property_id % 4 = 0) o USING (property_id) LEFT JOIN k USING (routing_key) LEFT JOIN t USING (county) LEFT JOIN c USING (county)""",
    "property",
)
def placement_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own place, local gazetteer, unique name, routing key's median, county town, county's point."""
    held = B.properties(spark, sf_dir)
    local = G.local_match(asked_parts(spark, sf_dir), gazetteer_features(spark, sf_dir))
    named = uniquely_named(spark, sf_dir)
    towns = centres(spark, sf_dir).filter("r < 4").groupBy("county").agg(F.min_by("clon", "n").alias("lon"), F.min_by("clat", "n").alias("lat"))
    counties = held.groupBy("county").agg(F.round(F.avg("lon"), 3).alias("lon"), F.round(F.avg("lat"), 3).alias("lat"))
    keys = S.median_points(precise(spark, sf_dir), "routing_key", least=3)
    found = G.cascade(held, ("local", local, "property_id"), ("unique_name", named, "property_id"), ("routing_key", keys, "routing_key"), ("county_town", towns, "county"), ("county", counties, "county"))
    return found.select("property_id", "method", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


#: Addresses whose "Co." is left out for every sixth property; the query that placed each: the town, the county's name, or the street and town.
_ATTEMPTS = """tried AS (SELECT property_id, county, precision <= 1 AS is_street, CASE property_id % 5 WHEN 0 THEN 'church' WHEN 1 THEN NULL WHEN 2 THEN 'train_station' WHEN 3 THEN 'house' ELSE 'apartments' END AS building, property_id % 13 = 0 AS locked,
  string_split(address, ', ')[-2] AS town, string_split(address, ', ')[-1][5:] AS region, property_id % 6 = 5 AS bare FROM property)"""


@query(
    f"""WITH {_ATTEMPTS}, q AS (SELECT *, CASE property_id % 4 WHEN 0 THEN town WHEN 1 THEN region ELSE 'x ' || town END AS query FROM tried)
SELECT property_id, reason FROM (SELECT property_id, CASE WHEN building NOT IN ('house', 'apartments') THEN 'type' WHEN query = town OR (bare AND query = region) THEN 'town' END AS reason FROM q WHERE is_street AND NOT locked AND building IS NOT NULL) WHERE reason IS NOT NULL""",
    "property",
)
def placement_rechecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements on buildings that the rules refuse today; of two accepted attempts the later one counts."""
    p = B.properties(spark, sf_dir)
    i, cut = F.col("property_id"), F.split("address", ", ")
    town, region = F.element_at(cut, -2), F.substring(F.element_at(cut, -1), 5, 99)
    building = F.when(i % 5 == 0, "church").when(i % 5 == 2, "train_station").when(i % 5 == 3, "house").when(i % 5 == 4, "apartments")
    address = F.when(i % 6 == 5, F.regexp_replace("address", ", Co\\. ", ", ")).otherwise(F.col("address"))
    placed = p.select("property_id", address.alias("address"), "county", F.when(F.col("precision") <= 1, F.lit(G.STREET)).otherwise(F.lit(G.LOCALITY)).alias("level"), building.alias("building"), (i % 13 == 0).alias("locked"))
    query = F.when(i % 4 == 0, town).when(i % 4 == 1, region).otherwise(F.concat(F.lit("x "), town))
    tries = F.array(F.struct(F.lit(1).alias("attempt_id"), town.alias("query"), F.lit(True).alias("accepted")), F.struct(F.lit(2).alias("attempt_id"), query.alias("query"), F.lit(True).alias("accepted")), F.struct(F.lit(3).alias("attempt_id"), town.alias("query"), F.lit(False).alias("accepted")))
    return G.rechecked(placed, p.select("property_id", F.explode(tries).alias("t")).select("property_id", "t.*"))


@query(
    f"""WITH {_ATTEMPTS} SELECT property_id, CASE WHEN bare THEN town || '|' || region ELSE town END AS towns FROM tried""",
    "property",
)
def town_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each address that may name its town."""
    address = F.when(F.col("property_id") % 6 == 5, F.regexp_replace("address", ", Co\\. ", ", ")).otherwise(F.col("address"))
    return B.properties(spark, sf_dir).select("property_id", F.array_join(G.town_parts(G.query_parts(address, F.col("county")), F.col("county")), "|").alias("towns"))


@query("SELECT CASE precision WHEN 0 THEN 'exact' WHEN 1 THEN 'street' WHEN 2 THEN 'locality' WHEN 3 THEN 'routing_key' WHEN 4 THEN 'county' ELSE 'unmatched' END AS confidence, count(*) AS n FROM property GROUP BY ALL", "property")
def confidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, B.PRECISIONS)), F.col("precision") + 1)
    return B.properties(spark, sf_dir).groupBy(name.alias("confidence")).agg(F.count("*").alias("n"))


_STRIPS = """strip AS (SELECT kind, CAST(start + (area_id - 100) * per + k AS BIGINT) AS area_id, x0 + k * 13000 AS x0, x0 + (k + 1) * 13000 AS x1, y0, y1 FROM b, range(4) r(k), (VALUES ('electoral_division', 1000, 8), ('small_area', 10000, 32), ('townland', 100000, 16)) t(kind, start, per)
  UNION ALL SELECT 'settlement', CAST(area_id AS BIGINT), x0, x1, y0, y1 FROM b)"""


@query(
    f"""WITH m AS (SELECT property_id, {geo.to_metres_sql('lon', 'lat')} FROM property), b AS ({_BOX}), {_STRIPS},
hit AS (SELECT property_id, kind, min(area_id) AS area_id FROM m JOIN strip ON x + 5000 BETWEEN x0 AND x1 AND y - 3000 BETWEEN y0 AND y1 GROUP BY ALL)
SELECT property_id, max(area_id) FILTER (kind = 'small_area' AND property_id % 2 = 1) AS small_area_id, max(area_id) FILTER (kind = 'electoral_division' AND property_id % 2 = 1) AS electoral_division_id,
  max(area_id) FILTER (kind = 'townland') AS townland_id, max(area_id) FILTER (kind = 'settlement') AS settlement_id FROM m LEFT JOIN hit USING (property_id) GROUP BY ALL""",
    "property",
)
def manual_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties moved by hand join their areas anew; the small kinds only where the new place is precise."""
    x, y = geo.to_metres(F.col("lon"), F.col("lat"))
    moved = B.properties(spark, sf_dir).select("property_id", (x + 5000).cast("double").alias("x"), (y - 3000).cast("double").alias("y"), (F.col("property_id") % 2 == 1).alias("precise"))
    n = F.col("n_nationkey").cast("long")
    x0, y0 = n % 5 * 50_000 - 140_000, F.floor(n / 5) * 80_000 - 220_000

    def box(left, width):
        corner = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
        return F.array(corner(left, y0), corner(left + width, y0), corner(left + width, y0 + 70_000), corner(left, y0 + 70_000), corner(left, y0))

    nations = B.read(spark, sf_dir, "nation")
    cut = nations.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    polygons = nations.select((n + 100).alias("area_id"), F.lit("settlement").alias("kind"), box(x0, 52_000).alias("ring"))
    for kind, start, per in (("electoral_division", 1000, 8), ("small_area", 10_000, 32), ("townland", 100_000, 16)):
        polygons = polygons.unionByName(cut.select((n * per + F.col("k") + start).alias("area_id"), F.lit(kind).alias("kind"), box(x0 + F.col("k") * 13_000, 13_000).alias("ring")))
    return G.rejoined(moved, polygons, 30_000)


@query(
    """WITH l AS (SELECT property_id, unnest([small_area_id, ed_id, townland_id, settlement_id]) AS area_id FROM property UNION ALL SELECT property_id, county_id FROM property)
SELECT property_id, kind, name FROM l JOIN all_area USING (area_id)""",
    "property all_area",
)
def area_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas of each property and, after them, its county."""
    held, areas = B.properties(spark, sf_dir), B.all_areas(spark, sf_dir)
    own = held.select("property_id", F.explode(F.array_compact(F.array("small_area_id", "ed_id", "townland_id", "settlement_id"))).alias("area_id"))
    county = held.select("property_id", F.col("county_id").alias("area_id"))
    return own.unionByName(county).join(areas, "area_id").select("property_id", "kind", "name")


_PART = "lower(trim(unnest(string_split(address, ','))))"


@query(
    f"""WITH a AS (SELECT property_id, {_PART} AS part FROM property)
SELECT property_id, part FROM a WHERE regexp_matches(part, '(street|road|st|rd[.])$') OR NOT EXISTS (SELECT 1 FROM area WHERE kind = 'settlement' AND area.name = a.part)""",
    "property area",
)
def telling_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of addresses that hold a street word or are no settlement's name: EXISTS next to another condition."""
    parts = B.properties(spark, sf_dir).select("property_id", F.explode(F.split(F.lower("address"), ",")).alias("part")).select("property_id", F.trim("part").alias("part"))
    towns = B.areas(spark, sf_dir).filter("kind = 'settlement'").select("name")
    return parts.where(F.col("part").rlike("(street|road|st|rd[.])$") | ~towns.where(F.col("name") == F.col("part").outer()).exists())


@query(
    """SELECT property_id, to_json({'confidence': CASE WHEN property_id % 4 = 1 THEN 'exact' ELSE CAST(precision AS VARCHAR) END, 'areas': {'county': county, 'settlement': settlement_id}}) AS payload,
  county, settlement_id FROM property""",
    "property",
)
def patched_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads with one field replaced where a place was corrected; two paths are read back, one with a cast."""
    payload = F.struct(F.col("precision").cast("string").alias("confidence"), F.struct("county", F.col("settlement_id").alias("settlement")).alias("areas"))
    held = B.properties(spark, sf_dir).select("property_id", payload.alias("payload"))
    patched = F.when(F.col("property_id") % 4 == 1, F.col("payload").withField("confidence", F.lit("exact"))).otherwise(F.col("payload"))
    held = held.select("property_id", F.to_json(patched).alias("payload"))
    path = lambda p: F.get_json_object("payload", p)
    return held.select("property_id", "payload", path("$.areas.county").alias("county"), path("$.areas.settlement").cast("long").alias("settlement_id"))


@query(
    """WITH a AS (SELECT c_custkey AS property_id, c_custkey % 60 AS h, c_custkey % 4 AS v FROM customer)
SELECT property_id, CASE v WHEN 0 THEN h || '|' || (h + 2) WHEN 1 THEN h || 'b' WHEN 2 THEN h || '-' || (h + 4) ELSE '' END AS numbers FROM a""",
)
def house_number_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """House numbers as map features hold them: lists, blanks within, ranges, none."""
    h, key = (F.col("c_custkey") % 60).cast("long"), F.col("c_custkey")
    raw = F.when(key % 4 == 0, F.concat(h.cast("string"), F.lit("; "), (h + 2).cast("string"), F.lit(";"))).when(key % 4 == 1, F.concat(h.cast("string"), F.lit(" B"))).when(key % 4 == 2, F.concat_ws("-", h.cast("string"), (h + 4).cast("string")))
    return B.read(spark, sf_dir, "customer").select(key.alias("property_id"), F.array_join(G.house_numbers(raw), "|").alias("numbers"))


@query(
    """SELECT area_id, CASE kind WHEN 'county' THEN regexp_replace(name, '[^a-z0-9]+', '-', 'g') WHEN 'small_area' THEN 'sa-' || regexp_replace(name, '[^a-z0-9]+', '-', 'g')
  ELSE CASE kind WHEN 'electoral_division' THEN 'ed-' WHEN 'townland' THEN 'townland-' ELSE '' END || regexp_replace(name, '[^a-z0-9]+', '-', 'g') || '-' || substr(sha1(CAST(area_id AS VARCHAR)), 1, 6) END AS slug
FROM all_area WHERE kind <> 'country'""",
    "all_area",
)
def area_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as paths: those that may repeat end in a short digest of their code."""
    code = F.when(F.col("kind") == "county", text.slug(F.col("name"))).otherwise(F.col("area_id").cast("string"))
    return B.all_areas(spark, sf_dir).filter("kind <> 'country'").select("area_id", text.area_slug(F.col("kind"), code, F.col("name")).alias("slug"))


@query("SELECT l_orderkey AS feature_id, l_partkey AS place, CAST(l_shipdate AS DATE) AS day FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate) = 1")
def distinct_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that overlap on one point, each once as first seen, newest first."""
    seen = B.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("feature_id"), "l_linenumber", F.col("l_partkey").alias("place"), F.col("l_shipdate").cast("date").alias("day"))
    first = seen.groupBy("feature_id").agg(F.min(F.struct("l_linenumber", "place", "day")).alias("f"))
    return first.select("feature_id", "f.place", "f.day").orderBy(F.desc("day"), "feature_id")
