"""Queries over search, price changes, autocomplete and map tiles."""

from __future__ import annotations

import uuid
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import text as X
from lintel.functions.geo import distance_sql, tile_box
from lintel.operators import market as M
from lintel.operators import search as S
from lintel.operators import tiles as T
from lintel.operators import vector_tiles as V
from lintel.operators.trigram import TrigramIndex
from lintel.sources import binding as B
from lintel.sources.scratch import root_of

from .places import _VICINITY, vicinity
from .registry import query

#: The usual filters: market sales of properties placed at a locality or better.
_PLACED = "NOT suppressed AND precision <= 2"
_SHOWN = "NOT withdrawn AND NOT possible_duplicate"
_MATCH = f"SELECT s.*, p.county_id, p.settlement_id, p.precision, p.lon, p.lat, p.address FROM sale s JOIN property p USING (property_id) WHERE {_PLACED} AND {_SHOWN}"
_LATEST = "QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY sale_date DESC, sale_id DESC) = 1"
_USUAL = f"{_MATCH} AND NOT not_full_market AND bulk_group_id IS NULL {_LATEST}"
_COUNTS = f"SELECT property_id, count(*) AS n_sales FROM sale WHERE {_SHOWN} GROUP BY ALL"


def matches(spark: SparkSession, sf_dir: str, f: S.SalesFilter | None = None, near: DataFrame | None = None) -> DataFrame:
    return S.matching_sales(B.sales(spark, sf_dir), B.properties(spark, sf_dir), f or S.SalesFilter(), B.all_areas(spark, sf_dir), near)


@query(f"WITH m AS ({_USUAL}), c AS ({_COUNTS}) SELECT property_id, sale_id, sale_date, cents, is_new, precision, n_sales FROM m JOIN c USING (property_id)", "sale property")
def matching_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest matching sale of each property under the usual filters, and how many sales it has in all."""
    return S.with_counts(matches(spark, sf_dir), B.sales(spark, sf_dir)).select("property_id", "sale_id", "sale_date", "cents", "is_new", "precision", "n_sales")


FILTERED = S.SalesFilter(price_min=5_000_000, price_max=30_000_000, date_from=date(1995, 1, 1), date_to=date(2001, 6, 30), type="second_hand", exclude_bulk=False, min_confidence="county", vat="inclusive", area=("asia", "nation_3"), near=(-8.0, 53.4), radius_m=20_000, box=(-10.5, 51.0, -6.0, 55.5))


@query(
    f"""SELECT s.sale_id, property_id, s.sale_date, s.cents FROM sale s JOIN property p USING (property_id)
WHERE NOT suppressed AND precision <= 4 AND {_SHOWN} AND NOT not_full_market AND cents BETWEEN 5000000 AND 30000000 AND sale_date BETWEEN '1995-01-01' AND '2001-06-30'
  AND NOT is_new AND NOT vat_exclusive AND (county_id IN (SELECT area_id FROM area WHERE name IN ('asia', 'nation_3')) OR settlement_id IN (SELECT area_id FROM area WHERE name IN ('asia', 'nation_3')))
  AND {distance_sql('lon', 'lat', '-8.0', '53.4')} * 1000 <= 20000 {_LATEST}""",
    "sale property area",
)
def matching_sales_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, days, type, confidence, tax, areas, a circle and a box at once: few match."""
    return matches(spark, sf_dir, FILTERED).select("sale_id", "property_id", "sale_date", "cents")


KEYS = tuple(f"{c}{n:02d}" for c in "ACDEFHKN" for n in range(1, 24))
WIDE = S.SalesFilter(price_min=2_000_000, price_max=35_000_000, date_from=date(1992, 6, 1), date_to=date(1998, 6, 30), type="second_hand", exclude_non_market=False, exclude_bulk=False, min_confidence="street", vat="inclusive", county=("Asia", "Europe", "Africa", "America"), area=("asia", "europe", "division 4", "townland 20", "small area 11", "nation_3"), routing_key=KEYS, max_stop_m=40_000, max_school_m=30_000)


@query(
    f"""WITH v AS ({_VICINITY}), n AS (SELECT area_id FROM all_area WHERE name IN ('asia', 'europe', 'division 4', 'townland 20', 'small area 11', 'nation_3'))
SELECT s.sale_id, property_id, s.sale_date, s.cents FROM sale s JOIN property p USING (property_id) JOIN v USING (property_id)
WHERE NOT suppressed AND precision <= 1 AND {_SHOWN} AND cents BETWEEN 2000000 AND 35000000 AND sale_date BETWEEN '1992-06-01' AND '1998-06-30' AND NOT is_new AND NOT vat_exclusive
  AND county IN ('asia', 'europe', 'africa', 'america') AND routing_key IN {KEYS} AND stop_m <= 40000 AND least(primary_m, post_primary_m) <= 30000
  AND (county_id IN (FROM n) OR settlement_id IN (FROM n) OR coalesce(ed_id, -1) IN (FROM n) OR coalesce(small_area_id, -1) IN (FROM n) OR coalesce(townland_id, -1) IN (FROM n)) {_LATEST}""",
    "sale property area all_area poi",
)
def matching_sales_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All filters but the circle and the box, areas of five kinds and distances to stops and schools among them: many match."""
    return matches(spark, sf_dir, WIDE, vicinity(spark, sf_dir)).select("sale_id", "property_id", "sale_date", "cents")


_PREVIOUS = f"""
SELECT s.sale_id, b.sale_date AS prev_date, b.cents AS prev_cents, {M.change_sql('s.cents', 'b.cents')} AS change
FROM sale s LEFT JOIN plain b ON b.property_id = s.property_id AND b.sale_date < s.sale_date AND NOT (s.withdrawn OR s.not_full_market OR s.vat_exclusive OR s.possible_duplicate) AND s.bulk_group_id IS NULL
QUALIFY row_number() OVER (PARTITION BY s.sale_id ORDER BY b.sale_date DESC NULLS LAST, b.sale_id DESC) = 1"""


@query(_PREVIOUS, "sale market plain")
def previous_sale_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of: the latest plain sale of an earlier day, for plain sales, and the change since."""
    found = M.previous_plain(B.sales(spark, sf_dir))
    return found.select("sale_id", "prev_date", "prev_cents", M.change_permille(F.col("cents"), F.col("prev_cents")).alias("change"))


@query(
    """WITH l AS (SELECT *, NOT (withdrawn OR not_full_market OR vat_exclusive OR possible_duplicate) AND bulk_group_id IS NULL AS plain FROM sale)
SELECT sale_id, CASE WHEN plain AND lead(plain) OVER w THEN lead(cents) OVER w END AS older_cents FROM l WINDOW w AS (PARTITION BY property_id ORDER BY sale_date DESC, sale_id DESC)""",
    "sale",
)
def listed_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The property page's change: against the row just below, if both are plain."""
    return M.listed_change(B.sales(spark, sf_dir)).select("sale_id", "older_cents")


def _search_sql(order: str, page: int = 1) -> str:
    return f"""WITH m AS ({_USUAL}), v AS ({_PREVIOUS}), c AS ({_COUNTS})
SELECT m.property_id, m.sale_id, m.sale_date, m.cents, v.prev_date, v.prev_cents, v.change, c.n_sales, m.address FROM m JOIN v USING (sale_id) JOIN c USING (property_id)
ORDER BY {order}, property_id LIMIT 20 OFFSET {20 * (page - 1)}"""


def _search(spark: SparkSession, sf_dir: str, sort: str, page: int = 1) -> DataFrame:
    sales, places = B.sales(spark, sf_dir), B.properties(spark, sf_dir)
    found = S.search(S.matching_sales(sales, places, S.SalesFilter()), sales, places, sort, page)
    return found.select("property_id", "sale_id", "sale_date", "cents", "prev_date", "prev_cents", "change", "n_sales", "address")


_SEARCH_USES = "sale property market plain"


@query(_search_sql("sale_date DESC"), _SEARCH_USES)
def search_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "-date")


@query(_search_sql("sale_date", 3), _SEARCH_USES)
def search_oldest_third_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "date", 3)


@query(_search_sql("cents DESC"), _SEARCH_USES)
def search_dearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "-price")


@query(_search_sql("cents"), _SEARCH_USES)
def search_cheapest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "price")


@query(_search_sql("change DESC NULLS LAST"), _SEARCH_USES)
def search_most_risen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "-change")


@query(_search_sql("change NULLS LAST"), _SEARCH_USES)
def search_most_fallen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "change")


@query(
    f"""WITH m AS ({_USUAL}), v AS ({_PREVIOUS}), c AS ({_COUNTS})
SELECT m.property_id, m.sale_id, m.cents, v.change, c.n_sales, count(*) OVER () AS total, min(lon) OVER () AS west, min(lat) OVER () AS south, max(lon) OVER () AS east, max(lat) OVER () AS north
FROM m JOIN v USING (sale_id) JOIN c USING (property_id) ORDER BY cents DESC, property_id LIMIT 20 OFFSET 20""",
    _SEARCH_USES,
)
def search_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the dearest with the total and the extent of all matches."""
    sales, places = B.sales(spark, sf_dir), B.properties(spark, sf_dir)
    found = S.answer(S.matching_sales(sales, places, S.SalesFilter()), sales, places, "-price", 2)
    return found.select("property_id", "sale_id", "cents", "change", "n_sales", "total", "west", "south", "east", "north")


@query(f"WITH m AS ({_USUAL}) SELECT count(*) AS total, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM m", "sale property")
def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.totals(matches(spark, sf_dir))


#: What each property's search asks for: its county, its settlement (one that isn't there for some), its routing key, a circle and a map.
_ASKS = """asks AS (SELECT property_id AS ask_id, CASE WHEN property_id % 2 = 0 THEN county_id END AS county, CASE WHEN property_id % 3 = 0 THEN settlement_id WHEN property_id % 31 = 1 THEN 999 WHEN property_id % 11 = 1 THEN county_id END AS area,
  CASE WHEN property_id % 5 < 2 THEN routing_key END AS routing_key, CASE WHEN property_id % 4 = 1 THEN lon END AS lon, CASE WHEN property_id % 4 = 1 THEN lat END AS lat, property_id % 20 * 1000 + 1000 AS radius_m,
  CASE WHEN property_id % 7 = 0 THEN lon - 0.3::DOUBLE END AS west, CASE WHEN property_id % 7 = 0 THEN lat - 0.2::DOUBLE END AS south, CASE WHEN property_id % 7 = 0 THEN lon + 0.1::DOUBLE END AS east, CASE WHEN property_id % 7 = 0 THEN lat + 0.2::DOUBLE END AS north FROM property)"""
_EXTENT = "min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n"
_DY = "radius_m / 111000.0::DOUBLE"
_DX = f"least({_DY} / cos(radians(least(abs(lat) + {_DY}, 89.9::DOUBLE))), 180.0)"
_SIDE = lambda side, sign, d: f"a.{side[1]}, c.{side[0]} {sign} 0.05::DOUBLE, x.{side[0]} {sign} x.by, k.{side[0]}, {d}"


@query(
    f"""WITH {_ASKS}, area_box AS (SELECT county_id AS id, 0.05::DOUBLE AS by, {_EXTENT} FROM property GROUP BY ALL UNION ALL SELECT settlement_id, 0.01::DOUBLE, {_EXTENT} FROM property GROUP BY ALL),
key_box AS (SELECT routing_key, {_EXTENT} FROM property WHERE precision <= 2 GROUP BY ALL),
cut AS (SELECT ask_id, greatest(-11.0::DOUBLE, {_SIDE('w west'.split(), '-', f'lon - {_DX}')}) AS west, greatest(51.0::DOUBLE, {_SIDE('s south'.split(), '-', f'lat - {_DY}')}) AS south,
  least(-5.0::DOUBLE, {_SIDE('e east'.split(), '+', f'lon + {_DX}')}) AS east, least(56.0::DOUBLE, {_SIDE('n north'.split(), '+', f'lat + {_DY}')}) AS north
  FROM asks a LEFT JOIN area_box c ON c.id = a.county LEFT JOIN area_box x ON x.id = a.area LEFT JOIN key_box k ON k.routing_key = a.routing_key
  WHERE (a.county IS NULL OR c.id IS NOT NULL) AND (a.area IS NULL OR x.id IS NOT NULL) AND (a.routing_key IS NULL OR k.routing_key IS NOT NULL))
SELECT ask_id, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north FROM cut WHERE west <= east AND south <= north""",
    "property",
)
def search_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the search of each property's surroundings has to look; no row where its filters can't meet."""
    places = B.properties(spark, sf_dir)
    pick = lambda c, v: F.when(c, v)
    i, lon, lat = F.col("property_id"), F.col("lon"), F.col("lat")
    area = F.when(i % 3 == 0, F.col("settlement_id")).when(i % 31 == 1, F.lit(999)).when(i % 11 == 1, F.col("county_id"))
    asked = places.select(
        i.alias("ask_id"), pick(i % 2 == 0, F.col("county_id")).alias("county"), area.alias("area"), pick(i % 5 < 2, F.col("routing_key")).alias("routing_key"), pick(i % 4 == 1, lon).alias("lon"), pick(i % 4 == 1, lat).alias("lat"),
        (i % 20 * 1000 + 1000).alias("radius_m"), pick(i % 7 == 0, lon - 0.3).alias("west"), pick(i % 7 == 0, lat - 0.2).alias("south"), pick(i % 7 == 0, lon + 0.1).alias("east"), pick(i % 7 == 0, lat + 0.2).alias("north"),
    )
    boxes = lambda key, kind: S.box_of(places.groupBy(F.col(key).alias("area_id"))).withColumn("kind", F.lit(kind))
    keys = S.box_of(places.filter("precision <= 2").groupBy("routing_key"))
    found = S.envelopes(asked, boxes("county_id", "county").unionByName(boxes("settlement_id", "settlement")), keys)
    return found.select("ask_id", *(F.round(s, 6).alias(s) for s in S.SIDES))


@query(
    """WITH b AS (SELECT a.sale_id, arg_max(b.sale_date, (b.sale_date, b.sale_id)) AS prev_date, arg_max(b.cents, (b.sale_date, b.sale_id)) AS prev_cents FROM sale a JOIN plain b ON b.property_id = a.property_id AND b.sale_date < a.sale_date
  WHERE NOT a.not_full_market AND NOT a.vat_exclusive AND a.bulk_group_id IS NULL GROUP BY ALL)
SELECT sale_id, prev_date, prev_cents FROM sale LEFT JOIN b USING (sale_id) WHERE NOT withdrawn AND NOT possible_duplicate""",
    "sale market plain",
)
def shown_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sale that is shown, with the plain sale before it; for sales that are not plain none is looked up."""
    sale = B.sales(spark, sf_dir)
    shown = sale.filter("not withdrawn and not possible_duplicate").select("sale_id", "property_id", "sale_date", "not_full_market", "vat_exclusive", F.col("bulk_group_id").isNotNull().alias("bulk"))
    return M.previous_where(shown, sale, ~(F.col("not_full_market") | F.col("vat_exclusive") | F.col("bulk"))).select("sale_id", "prev_date", "prev_cents")


@query("SELECT kind, name FROM area WHERE starts_with(name, 'nation_1') OR contains(name, ' nation_1') ORDER BY name = 'nation_1' DESC, starts_with(name, 'nation_1') DESC, length(name), name LIMIT 8", "area")
def autocomplete_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.autocomplete_areas(B.areas(spark, sf_dir), "Nation_1").select("kind", "name")


def trigrams_sql(text: str) -> str:
    word = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({word}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


_SIMILAR = "CAST(floor(len(list_intersect(a, b)) * 1000000 / (len(a) + len(b) - len(list_intersect(a, b)))) AS BIGINT)"


@query(
    f"""WITH t AS (SELECT property_id, lower(address) AS normalised, {trigrams_sql('address')} AS a, {trigrams_sql("'church nation_2 asia'")} AS b FROM property WHERE NOT suppressed)
SELECT property_id, normalised, {_SIMILAR} AS score FROM t WHERE contains(normalised, 'church') AND contains(normalised, 'nation_2') AND contains(normalised, 'asia') ORDER BY score DESC, normalised, property_id LIMIT 8""",
    "property",
)
def autocomplete_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top addresses by trigram similarity among those that hold each word."""
    places = B.properties(spark, sf_dir).filter("not suppressed").select("property_id", F.lower("address").alias("normalised"))
    return S.autocomplete_addresses(places, "Church, Nation_2 Co. Asia")


#: Texts for the index: common words, short forms, an underscore that means itself, and one that no address has.
TYPED = ("Church, Nation_2 Co. Asia", "abbey tce", "12 main st", "brígid pk", "tion_1", "no such place")


def _typed_sql(text: str) -> str:
    words = S.query_words(text)
    held = " AND ".join(f"contains(n, '{w}')" for w in words)
    return f"""SELECT * FROM (SELECT '{text}' AS typed, property_id, n AS normalised, {_SIMILAR} AS score FROM (
  SELECT property_id, lower(address) AS n, {trigrams_sql('lower(address)')} AS a, {trigrams_sql(chr(39) + ' '.join(words) + chr(39))} AS b FROM property) WHERE {held} ORDER BY score DESC, normalised, property_id LIMIT 8)"""


@query("WITH " + ", ".join(f"t{i} AS ({_typed_sql(t)})" for i, t in enumerate(TYPED)) + " " + " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(len(TYPED))), "property")
def indexed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses that the trigram index finds for texts that people type, the eight most similar of each."""
    places = B.properties(spark, sf_dir).select("property_id", F.lower("address").alias("normalised"))
    index = TrigramIndex.build(places, f"{root_of(spark)}/trigrams-{uuid.uuid4().hex}")
    found = [index.lookup(t).select(F.lit(t).alias("typed"), "property_id", "normalised", "score") for t in TYPED]
    return reduce(DataFrame.unionByName, found)


@query("WITH k AS (SELECT routing_key, lon, lat FROM property WHERE precision <= 2) SELECT routing_key, count(*) AS n, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM k GROUP BY ALL", "property")
def autocomplete_routing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and centre of each routing key's well placed properties."""
    placed = B.properties(spark, sf_dir).filter("precision <= 2")
    return placed.groupBy("routing_key").agg(F.count("*").alias("n"), F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"))


#: What people type for a routing key, by property: the key as it is, in small letters, within blanks, and districts of Dublin in four ways.
_ASKED = """CASE property_id % 7 WHEN 0 THEN routing_key WHEN 1 THEN lower(routing_key) WHEN 2 THEN ' ' || routing_key || ' ' WHEN 3 THEN 'Dublin ' || property_id % 30
  WHEN 4 THEN 'd' || property_id % 130 WHEN 5 THEN 'dublin  6w' ELSE address END"""


@query(
    rf"""WITH a AS (SELECT {_ASKED} AS q FROM property), t AS (SELECT q, count(*) AS n, lower(trim(regexp_replace(q, '\s+', ' ', 'g'))) AS t FROM a GROUP BY q), d AS (SELECT *, regexp_extract(t, '^(?:dublin|d)\s*([0-9]{{1,2}}|6w)$', 1) AS d FROM t)
SELECT q, n, CASE WHEN regexp_full_match(t, '[acdefhknprtvwxy][0-9][0-9]') OR t = 'd6w' THEN upper(t) WHEN d = '6w' THEN 'D6W' WHEN d <> '' THEN 'D' || lpad(d, 2, '0') END AS routing_key FROM d""",
    "property",
)
def routing_keys_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct text, how often it is asked, and the key that it names."""
    asked = B.properties(spark, sf_dir).select(F.expr(_ASKED).alias("q")).groupBy("q").agg(F.count("*").alias("n"))
    return asked.select("q", "n", S.routing_key_of(F.col("q")).alias("routing_key"))


@query(
    f"""WITH k AS (SELECT DISTINCT 0 AS part, 1 AS place, 'routing_key' AS kind, routing_key AS name FROM property WHERE routing_key = 'D04'),
t AS (SELECT lower(address) AS normalised, property_id, {trigrams_sql('address')} AS a, {trigrams_sql("'d4'")} AS b FROM property WHERE NOT suppressed) SELECT 1 AS rank, kind, name FROM k""",
    "property",
)
def autocomplete_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'d4' names a key; it is too short for addresses and begins no area's name."""
    return _autocomplete(spark, sf_dir, "d4")


@query(
    f"""WITH n AS (SELECT 1 AS part, row_number() OVER (ORDER BY name = 'nation_2' DESC, starts_with(name, 'nation_2') DESC, length(name), name) AS place, kind, name FROM area WHERE starts_with(name, 'nation_2') OR contains(name, ' nation_2')),
t AS (SELECT lower(address) AS normalised, property_id, {trigrams_sql('address')} AS a, {trigrams_sql("'nation_2'")} AS b FROM property WHERE NOT suppressed AND contains(lower(address), 'nation_2')),
s AS (SELECT 2 AS part, row_number() OVER (ORDER BY {_SIMILAR} DESC, normalised, property_id) AS place, 'address' AS kind, normalised AS name FROM t),
u AS (SELECT * FROM n UNION ALL SELECT * FROM s) SELECT CAST(row_number() OVER (ORDER BY part, place) AS INTEGER) AS rank, kind, name FROM u ORDER BY part, place LIMIT 8""",
    "area property",
)
def autocomplete_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas before addresses; the underscore means itself and not any letter."""
    return _autocomplete(spark, sf_dir, "Nation_2")


def _autocomplete(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    places = B.properties(spark, sf_dir)
    keys = places.groupBy("routing_key").agg(F.count("*").alias("n"))
    return S.autocomplete(B.areas(spark, sf_dir), places.filter("not suppressed").select("property_id", F.lower("address").alias("normalised")), keys, text)


#: Parameters as URLs hold them, good and bad, made of each event's columns. ``k`` is the number in its props.
_GIVEN = """CASE event_id % 12 WHEN 0 THEN CAST(k AS VARCHAR(9)) || '.5' WHEN 1 THEN '-' || CAST(user_id AS VARCHAR(9)) WHEN 2 THEN CAST(k AS VARCHAR(9)) || 'e3' WHEN 3 THEN d WHEN 4 THEN substr(d, 1, 8) || CAST(k AS VARCHAR(9))
  WHEN 5 THEN CASE WHEN k % 3 = 0 THEN 'true' WHEN k % 3 = 1 THEN 'FALSE' ELSE 'maybe' END WHEN 6 THEN CASE WHEN k % 3 = 0 THEN 'street' WHEN k % 3 = 1 THEN 'Street' ELSE 'unmatched' END
  WHEN 7 THEN event_type || ', ' || d || ' ,' WHEN 8 THEN ' , ' WHEN 9 THEN '-' || CAST(k * 2 AS VARCHAR(9)) || '.26,' || CAST(k AS VARCHAR(9)) || '.35' WHEN 10 THEN CAST(k * 3 AS VARCHAR(9)) || ', ' || CAST(k AS VARCHAR(9)) ELSE '' END"""


@query(
    f"WITH e AS (SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d') AS d FROM events), g AS (SELECT event_id, {_GIVEN} AS x FROM e)"
    + r"""
SELECT event_id, x, CASE WHEN regexp_full_match(x, '-?[0-9]+(\.[0-9]+)?') THEN CAST(x AS DOUBLE) END AS number, CASE WHEN regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(x AS DATE) END AS day,
  CASE lower(x) WHEN 'true' THEN true WHEN 'false' THEN false ELSE true END AS flag, CASE WHEN x IN ('exact', 'street', 'locality', 'routing_key', 'county') THEN x ELSE 'locality' END AS confidence,
  nullif(array_to_string(list_filter(list_transform(string_split(x, ','), lambda w: trim(w)), lambda w: w <> ''), '|'), '') AS words,
  CASE WHEN regexp_full_match(x, '-?[0-9]{1,3}(\.[0-9]+)?,-?[0-9]{1,2}(\.[0-9]+)?') AND abs(TRY_CAST(split_part(x, ',', 1) AS DOUBLE)) <= 180 AND abs(TRY_CAST(split_part(x, ',', 2) AS DOUBLE)) <= 90 THEN CAST(split_part(x, ',', 1) AS DOUBLE) END AS lon
FROM g"""
)
def lenient_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every parser of search parameters over the texts of every event: what doesn't parse falls back to null or the default."""
    events = B.read(spark, sf_dir, "events").withColumns({"k": F.get_json_object("props", "$.k").cast("long"), "d": F.date_format("ts", "yyyy-MM-dd")})
    given, x = events.select("event_id", F.expr(_GIVEN).alias("x")), F.col("x")
    words = F.array_join(X.lenient_list(x), "|")
    return given.select("event_id", "x", X.lenient_number(x).alias("number"), X.lenient_date(x).alias("day"), X.lenient_flag(x, True).alias("flag"), X.lenient_confidence(x).alias("confidence"), words.alias("words"), X.lenient_point(x)["lon"].alias("lon"))


TILE = (6, 30, 20)


def _cells_sql() -> str:
    west, south, east, north = tile_box(*TILE)
    size = (east - west) / T.SIDE
    return f"""WITH m AS ({_USUAL}), p AS (SELECT cents, radians(lon) * 6378137.0::DOUBLE AS px, ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137.0::DOUBLE AS py FROM m),
b AS (SELECT *, CAST(floor((px - ({west!r})::DOUBLE) / {size!r}::DOUBLE) AS INTEGER) AS i, CAST(floor((py - ({south!r})::DOUBLE) / {size!r}::DOUBLE) AS INTEGER) AS j FROM p)
SELECT i, j, count(*) AS n, CASE WHEN count(*) >= 5 THEN CAST(floor(quantile_cont(cents, 0.5) / 100 + 0.5) AS BIGINT) END AS median, CAST(round(avg(px)) AS BIGINT) AS cx, CAST(round(avg(py)) AS BIGINT) AS cy
FROM b WHERE i BETWEEN 0 AND 15 AND j BETWEEN 0 AND 15 GROUP BY ALL"""


@query(_cells_sql(), "sale property")
def sales_tile_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cells(matches(spark, sf_dir), *TILE)


@query(f"WITH m AS ({_USUAL}) SELECT property_id, CAST(floor(cents / 100 + 0.5) AS BIGINT) AS price, CAST(strftime(sale_date, '%Y%m%d') AS INTEGER) AS day, is_new, precision FROM m WHERE precision <= 1", "sale property")
def sales_tile_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.points(matches(spark, sf_dir))


@query(
    f"""WITH m AS ({_USUAL}), r AS (SELECT *, round(lon, 1) AS x, round(lat, 1) AS y FROM m WHERE precision > 1)
SELECT x AS lon, y AS lat, min(precision) AS precision, count(*) AS n, CASE WHEN count(*) >= 5 THEN CAST(floor(quantile_cont(cents, 0.5) / 100 + 0.5) AS BIGINT) END AS median FROM r GROUP BY x, y""",
    "sale property",
)
def sales_tile_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse points, here rounded to a tenth of a degree so that some coincide."""
    return T.stacks(matches(spark, sf_dir).withColumn("lon", F.round("lon", 1)).withColumn("lat", F.round("lat", 1)))


def _varint_sql(n: str) -> str:
    byte = lambda i: f"lpad(to_hex(((({n})::BIGINT >> {7 * i}) & 127) + CASE WHEN {n} >= {1 << 7 * (i + 1)} THEN 128 ELSE 0 END), 2, '0')"
    return f"concat({byte(0)}, " + ", ".join(f"CASE WHEN {n} >= {1 << 7 * i} THEN {byte(i)} END" for i in range(1, 5)) + ")"


def _held_sql(number: int, wire: int, body: str) -> str:
    key = f"{number << 3 | wire:02X}"
    return f"('{key}' || {_varint_sql(f'(length({body}) // 2)')} || {body})" if wire == 2 else f"('{key}' || {body})"


TILES = (8, ("price", "day", "precision"))


def _tiles_sql() -> str:
    z, names = TILES
    size = 2 * V.HALF / 2**z
    tags = " || ".join(f"{_varint_sql(str(i))} || {_varint_sql(f'(nth * {len(names)} + {i})')}" for i in range(len(names)))
    values = " || ".join(_held_sql(4, 2, _held_sql(5, 0, _varint_sql(c))) for c in names)
    text = lambda t: "'" + t.encode().hex().upper() + "'"
    keys = " || ".join(_held_sql(3, 2, text(n)) for n in names)
    return f"""WITH m AS ({_USUAL}), p AS (SELECT property_id, CAST(floor(cents / 100 + 0.5) AS BIGINT) AS price, CAST(strftime(sale_date, '%Y%m%d') AS INTEGER) AS day, precision,
  (radians(lon) * 6378137.0::DOUBLE + {V.HALF!r}::DOUBLE) / {size!r}::DOUBLE AS a, ({V.HALF!r}::DOUBLE - ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137.0::DOUBLE) / {size!r}::DOUBLE AS d FROM m WHERE precision <= 1),
t AS (SELECT *, CAST(floor(a) AS INTEGER) AS x, CAST(floor(d) AS INTEGER) AS y FROM p), u AS (SELECT *, CAST(floor((a - x) * 4096) AS BIGINT) AS u, CAST(floor((d - y) * 4096) AS BIGINT) AS v, row_number() OVER (PARTITION BY x, y ORDER BY property_id) - 1 AS nth FROM t),
g AS (SELECT *, {tags} AS tags, '09' || {_varint_sql('(u * 2)')} || {_varint_sql('(v * 2)')} AS moved FROM u),
f AS (SELECT x, y, nth, {_held_sql(1, 0, _varint_sql('property_id'))} || {_held_sql(2, 2, 'tags')} || '1801' || {_held_sql(4, 2, 'moved')} AS feature, {values} AS vals FROM g),
h AS (SELECT x, y, nth, {_held_sql(2, 2, 'feature')} AS feature, vals FROM f),
b AS (SELECT x, y, count(*) AS n, '7802' || {_held_sql(1, 2, text('sales'))} || string_agg(feature, '' ORDER BY nth) || {keys} || string_agg(vals, '' ORDER BY nth) || '28' || {_varint_sql('4096')} AS body FROM h GROUP BY x, y)
SELECT {z} AS z, x, y, n, sha256(unhex({_held_sql(3, 2, 'body')})) AS tile_sha256 FROM b"""


@query(_tiles_sql(), "sale property")
def sales_vector_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector tiles at zoom 8 of all precisely placed sales that match."""
    z, names = TILES
    found = matches(spark, sf_dir).filter("precision <= 1").select("property_id", "lon", "lat", F.floor(F.col("cents") / 100 + 0.5).cast("long").alias("price"), F.date_format("sale_date", "yyyyMMdd").cast("int").alias("day"), "precision")
    return V.tiles(found, z, "sales", "property_id", names).select("z", "x", "y", "n", F.sha2("tile", 256).alias("tile_sha256"))
