"""Queries over positions: nearest places, distances, polygons, clusters, names and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import geo, text
from lintel.operators import geocode as G
from lintel.operators import spatial as S
from lintel.operators.blocks import counts_within
from lintel.sources import binding as B

from .registry import query

_PRECISE = "SELECT * FROM property WHERE precision <= 1"


def precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.properties(spark, sf_dir).filter("precision <= 1")


def vicinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """property_id and the distance in metres to (and key of) the nearest stop, rail stop, primary and post-primary school."""
    here, pois = precise(spark, sf_dir), B.places_of_interest(spark, sf_dir)
    grouped = pois.withColumn("group", F.explode(F.when(F.col("kind") == "rail", F.array(F.lit("stop"), F.lit("rail"))).otherwise(F.array("kind"))))
    names = ("stop", "rail", "primary", "post_primary")
    found = S.nearest(here, grouped, "property_id", "poi_id", groups=names)
    of = lambda name, c: F.min(F.when(F.col("group") == name, F.col(c)))  # noqa: E731  one row a group
    wide = found.groupBy("property_id").agg(*(of(n, c).alias(f"{n}_{short}") for n in names for c, short in (("poi_id", "id"), ("m", "m"))))
    return here.select("property_id").join(wide, "property_id", "left")


def _nearest_sql(name: str, kinds: str) -> str:
    m = geo.metres_sql(geo.distance_sql("p.lon", "p.lat", "t.lon", "t.lat"))
    return f"{name} AS (SELECT property_id, min({{'m': {m}, 'id': poi_id}}) AS b FROM h p, poi t WHERE t.kind IN ({kinds}) GROUP BY ALL)"


_VICINITY = (
    f"WITH h AS ({_PRECISE}), "
    + ", ".join(_nearest_sql(n, k) for n, k in (("stop", "'stop', 'rail'"), ("rail", "'rail'"), ("prim", "'primary'"), ("post", "'post_primary'")))
    + """ SELECT property_id, stop.b.id AS stop_id, stop.b.m AS stop_m, rail.b.id AS rail_id, rail.b.m AS rail_m, prim.b.id AS primary_id, prim.b.m AS primary_m, post.b.id AS post_primary_id, post.b.m AS post_primary_m
FROM h LEFT JOIN stop USING (property_id) LEFT JOIN rail USING (property_id) LEFT JOIN prim USING (property_id) LEFT JOIN post USING (property_id)"""
)
query(_VICINITY, "property poi")(vicinity)


@query(
    f"""WITH h AS ({_PRECISE}), n AS (SELECT p.property_id, t.kind, count(*) AS n FROM h p, poi t WHERE {geo.metres_sql(geo.distance_sql('p.lon', 'p.lat', 't.lon', 't.lat'))} <= 20000 GROUP BY ALL)
SELECT property_id, string_agg(kind || ':' || CAST(n AS VARCHAR), ',' ORDER BY kind) AS amenities FROM n GROUP BY ALL""",
    "property poi",
)
def amenities_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind within 20 km."""
    counts = counts_within(precise(spark, sf_dir), B.places_of_interest(spark, sf_dir), "property_id", "kind", 20_000)
    return counts.groupBy("property_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", F.col("n").cast("string")))), ",").alias("amenities"))


@query(
    f"""WITH h AS ({_PRECISE}), n AS (SELECT p.property_id, t.kind, count(*) AS n FROM h p, poi t WHERE {geo.metres_sql(geo.distance_sql('p.lon', 'p.lat', 't.lon', 't.lat'))} <= 10000 GROUP BY ALL)
SELECT property_id, '{{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}}' AS amenities FROM n GROUP BY ALL""",
    "property poi",
)
def amenity_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind within 10 km as a JSON object."""
    return S.counts_object(counts_within(precise(spark, sf_dir), B.places_of_interest(spark, sf_dir), "property_id", "kind", 10_000), "property_id")


@query("SELECT user_id AS property_id, arg_max(event_type, (n, -least)) AS reason, max(n) AS n FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS least FROM events GROUP BY ALL) GROUP BY user_id")
def usual_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reason most given for each property; of several, the one given first."""
    attempts = B.read(spark, sf_dir, "events").select(F.col("user_id").alias("property_id"), F.col("event_id").alias("attempt_id"), F.col("event_type").alias("reason"))
    return G.usual_reason(attempts)


#: Properties drawn together towards the middle of their county, so that they crowd there.
_CROWD = "SELECT property_id, county, -8.0::DOUBLE + county_id * 0.2::DOUBLE + (lon + 8) * (lon + 8) * (lon + 8) / 200 AS lon, 53.0::DOUBLE + (lat - 53.4) * (lat - 53.4) * (lat - 53.4) / 200 AS lat FROM property"


@query(
    f"""WITH t AS ({_CROWD}), d AS (SELECT p.property_id AS p, t.county, t.property_id AS t, {geo.metres_sql(geo.distance_sql('p.lon', 'p.lat', 't.lon', 't.lat'))} AS m FROM property p, t)
SELECT p AS property_id, county, min({{'m': m, 't': t}}).t AS nearest_id, min({{'m': m, 't': t}}).m AS m FROM d GROUP BY p, county""",
    "property",
)
def nearest_in_crowds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest place of each county for every property, by a quadtree of the places."""
    p = B.properties(spark, sf_dir)
    cube = lambda c, o: (F.col(c) - o) * (F.col(c) - o) * (F.col(c) - o) / 200
    crowd = p.select(F.col("property_id").alias("nearest_id"), "county", (F.lit(-8.0) + F.col("county_id") * 0.2 + cube("lon", -8)).alias("lon"), (F.lit(53.0) + cube("lat", 53.4)).alias("lat"))
    return S.nearest_by_density(p.select("property_id", "lon", "lat"), crowd, "property_id", "nearest_id", "county", most=16)


#: A rectangle for each nation, overlapping its neighbours; metres in the local frame.
_BOX = "SELECT 100 + n_nationkey AS area_id, (n_nationkey % 5) * 50000 - 140000 AS x0, (n_nationkey // 5) * 80000 - 220000 AS y0, (n_nationkey % 5) * 50000 - 140000 + 52000 AS x1, (n_nationkey // 5) * 80000 - 220000 + 70000 AS y1 FROM nation"


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    x0, y0 = (n % 5) * 50_000 - 140_000, F.floor(n / 5) * 80_000 - 220_000
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    ring = F.array(corner(x0, y0), corner(x0 + 52_000, y0), corner(x0 + 52_000, y0 + 70_000), corner(x0, y0 + 70_000), corner(x0, y0))
    return B.read(spark, sf_dir, "nation").select((n + 100).alias("area_id"), ring.alias("ring"))


def metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.to_metres(F.col("lon"), F.col("lat"))
    return B.properties(spark, sf_dir).select("property_id", x.cast("double").alias("x"), y.cast("double").alias("y"))


_METRIC = f"m AS (SELECT property_id, {geo.to_metres_sql('lon', 'lat')} FROM property), b AS ({_BOX})"


@query(f"WITH {_METRIC} SELECT property_id, CAST(min(area_id) AS BIGINT) AS area_id FROM m, b WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL", "property")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.inside(metric(spark, sf_dir), rectangles(spark, sf_dir), "property_id", "area_id", 30_000)


@query(
    f"""WITH {_METRIC}, d AS (SELECT property_id, area_id, sqrt(power(greatest(x0 - x, 0, x - x1), 2) + power(greatest(y0 - y, 0, y - y1), 2)) AS away FROM m, b)
SELECT property_id, CAST(min({{'d': away, 'a': area_id}}).a AS BIGINT) AS area_id, CAST(floor(min({{'d': away, 'a': area_id}}).d + 0.5) AS BIGINT) AS away FROM d WHERE away <= 2000 GROUP BY ALL""",
    "property",
)
def nearest_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygon that holds a point, else the nearest within 2 km."""
    found = S.near_polygon(metric(spark, sf_dir), rectangles(spark, sf_dir), "property_id", "area_id", 30_000, 2_000)
    return found.select("property_id", "area_id", F.floor(F.col("away") + 0.5).cast("long").alias("away"))


@query(
    f"""WITH RECURSIVE_placeholder AS (SELECT 1), l AS (SELECT a.poi_id AS a, b.poi_id AS b FROM poi a JOIN poi b ON a.kind = b.kind AND {geo.distance_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} * 1000 <= 30000),
r AS (SELECT poi_id AS a, poi_id AS b FROM poi UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT a AS poi_id, min(b) AS cluster FROM r GROUP BY ALL""".replace("RECURSIVE_placeholder AS (SELECT 1), ", ""),
    "poi",
)
def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of one kind merged where they lie within 30 km of each other, over any number of steps."""
    return S.clusters(B.places_of_interest(spark, sf_dir), "kind", "poi_id", 30_000)


_MEDIANS = "SELECT routing_key, quantile_cont(lon, 0.5) AS lon, quantile_cont(lat, 0.5) AS lat, count(*) AS n FROM property WHERE precision <= 1 GROUP BY ALL HAVING count(*) >= 2"


@query(f"WITH d AS ({_MEDIANS}) SELECT routing_key, round(lon, 6) AS lon, round(lat, 6) AS lat, n FROM d", "property")
def routing_key_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.median_points(precise(spark, sf_dir), "routing_key", least=2)
    return found.select("routing_key", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "n")


_AWAY = geo.metres_sql(geo.distance_sql("p.lon", "p.lat", "d.lon", "d.lat"))


@query(f"WITH d AS ({_MEDIANS}) SELECT property_id, {_AWAY} AS away_m FROM property p JOIN d USING (routing_key) WHERE p.precision <= 2 AND {_AWAY} > 150000", "property")
def routing_key_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties far from the median of their routing key: for review, neither side is trusted."""
    medians = S.median_points(precise(spark, sf_dir), "routing_key", least=2).select("routing_key", F.col("lon").alias("klon"), F.col("lat").alias("klat"))
    met = B.properties(spark, sf_dir).filter("precision <= 2").join(medians, "routing_key")
    away = geo.metres(geo.distance_km(F.col("lon"), F.col("lat"), F.col("klon"), F.col("klat")))
    return met.select("property_id", away.alias("away_m")).filter("away_m > 150000")


@query(
    """WITH t AS (SELECT DISTINCT p_partkey, p_brand AS county, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS k FROM part),
u AS (SELECT county, k, min(p_partkey) AS feature_id FROM t GROUP BY ALL HAVING count(DISTINCT p_partkey) = 1)
SELECT t.p_partkey AS wanted_id, u.feature_id FROM t JOIN u USING (county, k)""",
)
def unique_name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that one feature of the county has, word order aside."""
    part = B.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_brand").alias("county"), F.col("p_name").alias("name"))
    return G.unique_names(part, part.withColumnRenamed("feature_id", "wanted_id"))


_STREET_LIST = ", ".join(f"'{w}'" for w in G.PLAIN_STREET_WORDS)


@query(
    f"""WITH n AS (SELECT DISTINCT p_brand AS county, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS k FROM part),
w AS (SELECT p_partkey AS wanted_id, p_brand AS county, list_sort(list_distinct(string_split(lower(p_name)[1:-2], ' '))) AS k FROM part),
m AS (SELECT wanted_id, n.k, list_filter(w.k, lambda x: NOT list_contains(n.k, x)) AS x, list_filter(n.k, lambda x: NOT list_contains(w.k, x)) AS y FROM w JOIN n USING (county) WHERE len(w.k) >= 2 AND len(n.k) = len(w.k))
SELECT wanted_id, array_to_string(min(k), ' ') AS tokens FROM m WHERE len(x) = 1 AND len(y) = 1 AND levenshtein(x[1], y[1]) = 1 AND greatest(length(x[1]), length(y[1])) >= 6 AND x[1] NOT IN ({_STREET_LIST}) AND y[1] NOT IN ({_STREET_LIST})
GROUP BY wanted_id HAVING count(DISTINCT k) = 1""",
)
def one_edit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt names (the last letter is cut off) against the county's names: one edit in one long word, unique."""
    part = B.read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("county"), F.col("p_name").alias("name"))
    wanted = part.select(F.col("p_partkey").alias("wanted_id"), "county", F.expr("substring(name, 1, length(name) - 1)").alias("name"))
    return G.one_edit_names(part.select("county", "name"), wanted)


_CANDIDATES = """
c AS (SELECT property_id, i, lon + i * 0.02::DOUBLE AS lon, lat, (property_id + i) % 5 AS kind, (property_id + i) % 3 <> 0 AS named, (property_id + i) % 7 = 0 AS house, 16 + (property_id % 3) * 4 AS rank, property_id % 4 <> 0 AS town,
  lon + 0.03::DOUBLE AS tlon, property_id % 8 = 1 AS tcity FROM property, range(3) r(i)),
l AS (SELECT *, CASE WHEN house THEN CASE WHEN named THEN 0 END WHEN NOT named THEN NULL WHEN kind IN (0, 1) THEN 1 WHEN kind = 2 THEN 2 WHEN kind = 3 AND rank >= 20 THEN 2 END AS level,
  CASE WHEN house THEN CASE WHEN NOT named THEN 'house_number_other_street' END WHEN NOT named THEN 'name_mismatch' WHEN kind IN (0, 1, 2) THEN NULL WHEN kind = 3 THEN CASE WHEN rank < 20 THEN 'too_coarse' END ELSE 'too_coarse' END AS reason FROM c)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three answers for each property's query, of different kinds, names and places."""
    i, p = F.col("i"), F.col("property_id")
    rows = B.properties(spark, sf_dir).select("property_id", "lon", "lat", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), ((p + i) % 5 + 1).cast("int"))
    named = (p + i) % 3 != 0
    return rows.select(
        p.alias("query_id"),
        i.alias("candidate_id"),
        F.lit("12 Mill Avenue").alias("part"),
        pick("highway", "building", "place", "boundary", "place").alias("category"),
        pick("residential", "yes", "village", "administrative", "city").alias("type"),
        (p % 3 * 4 + 16).cast("int").alias("rank"),
        F.array(F.when(named, "Mill Ave").otherwise("Bridge St")).alias("names"),
        F.when((p + i) % 7 == 0, "12").alias("house_number"),
        F.array(F.when(named, "The Mill Ave.").otherwise("Bridge St")).alias("streets"),
        F.lit(False).alias("town_part"),
        (F.col("lon") + i * 0.02).alias("lon"),
        "lat",
        F.when(p % 4 != 0, F.col("lon") + 0.03).alias("tlon"),
        F.when(p % 4 != 0, F.col("lat")).alias("tlat"),
        F.when(p % 4 != 0, p % 8 == 1).alias("tcity"),
    )


@query(f"WITH {_CANDIDATES} SELECT property_id AS query_id, CAST(i AS INTEGER) AS candidate_id, CAST(level AS INTEGER) AS level, reason FROM l", "property")
def candidate_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.level(candidates(spark, sf_dir)).select("query_id", "candidate_id", F.col("level").cast("int").alias("level"), "reason")


@query(f"WITH {_CANDIDATES} SELECT reason, count(*) AS n FROM l WHERE reason IS NOT NULL GROUP BY ALL", "property")
def candidate_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.level(candidates(spark, sf_dir)).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


_TOWN = geo.distance_sql("lon", "lat", "tlon", "lat")


@query(
    f"""WITH {_CANDIDATES}, a AS (SELECT *, {_TOWN} AS km FROM l WHERE level IS NOT NULL),
k AS (SELECT * FROM a WHERE NOT town OR km <= CASE WHEN level = 2 THEN 20 WHEN tcity THEN 15 ELSE 5 END),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY level, kind NOT IN (2, 4), i) = 1)
SELECT property_id AS query_id, CAST(i AS INTEGER) AS candidate_id, CAST(level AS INTEGER) AS level FROM b WHERE town OR (SELECT max({geo.distance_sql('b.lon', 'b.lat', 'k.lon', 'k.lat')}) FROM k WHERE k.property_id = b.property_id AND k.level = b.level) <= CASE WHEN level = 2 THEN 15 ELSE 3 END""",
    "property",
)
def candidate_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pick(candidates(spark, sf_dir)).select("query_id", "candidate_id", F.col("level").cast("int").alias("level"))


@query(
    r"""WITH b AS (SELECT property_id, replace(regexp_replace(regexp_replace(regexp_replace(address, '^Apt [0-9]+, ', ''), ', Co\. .*$', ''), '\s+', ' ', 'g'), 'Rd.,', 'Rd,') AS whole FROM property)
SELECT property_id, 0 AS step, whole AS query, string_split(whole, ', ')[1] AS part FROM b UNION ALL SELECT property_id, 1, string_split(whole, ', ')[2], string_split(whole, ', ')[2] FROM b""",
    "property",
)
def query_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries asked for each address, from whole to town; unit tests hold the other rules."""
    parts = B.properties(spark, sf_dir).select("property_id", "county", G.query_parts(F.col("address"), F.col("county")).alias("parts"))
    steps = parts.select("property_id", F.posexplode(G.ladder(F.col("parts"), F.col("county"))).alias("step", "s"))
    return steps.select("property_id", "step", "s.query", "s.part")


@query(
    f"SELECT c_custkey AS property_id, {geo.metres_sql(geo.distance_sql('p.lon', 'p.lat', '-8.0', '53.5'))} AS away_m, CAST(round(radians(lon) * 6378137.0::DOUBLE) AS BIGINT) AS mx, CAST(round(ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137.0::DOUBLE) AS BIGINT) AS my FROM customer JOIN property p ON p.property_id = c_custkey",
    "property",
)
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the origin and web-Mercator metres; the national grid is held to known points by a test."""
    mx, my = geo.web_mercator(F.col("lon"), F.col("lat"))
    away = geo.metres(geo.distance_km(F.col("lon"), F.col("lat"), F.lit(-8.0), F.lit(53.5)))
    return B.properties(spark, sf_dir).select("property_id", away.alias("away_m"), F.round(mx).cast("long").alias("mx"), F.round(my).cast("long").alias("my"))


@query(
    r"""WITH s AS (SELECT property_id, lower(address) AS a FROM property), p AS (SELECT property_id, string_split(a, ',') AS ps FROM s),
u AS (SELECT property_id, list_transform(ps[1:-2], lambda x: trim(regexp_replace(x, '^\s*((apt|apartment|unit|flat|no)\.?\s*)?[0-9][0-9a-z/-]*\s*', ''))) AS ps FROM p)
SELECT property_id, array_to_string(list_filter(ps, lambda x: x <> '' AND NOT regexp_matches(x, '^([0-9]|(co\.?|county) )')), '|') AS streets FROM u""",
    "property",
)
def street_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.properties(spark, sf_dir).select("property_id", F.array_join(text.street_parts(F.lower("address")), "|").alias("streets"))
