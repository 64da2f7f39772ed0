"""Queries over the register: parsing, repeats, staging, merging and portfolio sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import text as X
from lintel.operators import bulk
from lintel.operators import register as R
from lintel.sources import binding as B

from .registry import query

COUNTIES = ("africa", "america", "asia", "europe", "middle east")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parse(B.register_rows(spark, sf_dir), COUNTIES)


@query("SELECT line_no, sale_date, county, cents, is_new, raw_nfmp = 'Yes' AS not_full_market, raw_vat = 'Yes' AS vat_exclusive, nullif(band, '') AS size_band FROM parsed WHERE error IS NULL", "sale property register parsed")
def register_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir).filter("error is null").select("line_no", "sale_date", "county", "cents", "is_new", "not_full_market", "vat_exclusive", "size_band")


@query("SELECT line_no, concat_ws(',', raw_date, raw_address, raw_county, raw_eircode, raw_price, raw_nfmp, raw_vat, raw_description, raw_size) AS raw_line, error FROM parsed WHERE error IS NOT NULL", "sale property register parsed")
def register_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quarantined(parsed(spark, sf_dir))


@query("SELECT error, count(*) AS n FROM parsed WHERE error IS NOT NULL GROUP BY ALL", "sale property register parsed")
def register_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quarantined(parsed(spark, sf_dir)).groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT line_no, CAST(occurrence AS INTEGER) AS occurrence, possible_duplicate, row_hash FROM filed", "sale property register parsed filed")
def register_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.with_repeats(parsed(spark, sf_dir)).select("line_no", "occurrence", "possible_duplicate", "row_hash")


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stage(R.with_repeats(parsed(spark, sf_dir)), COUNTIES)


#: The addresses of the test tables need only some of the rules; unit tests cover the rest.
_STAGED = r"""
e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(address),
  'co\. ', 'co '), 'rd\.', 'road'), '\brd\b', 'road'), '\bave\b', 'avenue'), '\btce\b', 'terrace'), 'st\. bríg', 'saint bríg'), '\bpk\b', 'park'), '\bst\b', 'street'), '\bapt\b', 'apartment') AS normalised FROM filed),
u AS (SELECT *, nullif(regexp_extract(normalised, '^(apartment [0-9]+), ', 1), '') AS unit, regexp_replace(regexp_replace(normalised, '^apartment [0-9]+, ', ''), ', co [a-z ]+$', '') AS rest FROM e),
k AS (SELECT *, regexp_extract(rest, '^[0-9]+') AS house_number, regexp_replace(regexp_replace(strip_accents(rest), '([0-9])[^a-z0-9]+([0-9])', '\1#\2', 'g'), '[^a-z0-9#]+', '', 'g') AS key,
  CASE WHEN regexp_full_match(upper(regexp_replace(raw_eircode, '\s+', '', 'g')), '([AC-FHKNPRTV-Y][0-9]{2}|D6W)[0-9AC-FHKNPRTV-Y]{4}') THEN upper(regexp_replace(raw_eircode, '\s+', '', 'g')) END AS eircode FROM u)"""


@query(f"WITH {_STAGED} SELECT line_no, replace(address, 'Rd.,', 'Rd,') AS display, normalised, unit, house_number, replace(key, '#', '-') AS key, eircode FROM k", "sale property register parsed filed")
def register_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir).select("line_no", "display", "normalised", "unit", "house_number", "key", "eircode")


@query(
    f"""WITH {_STAGED} SELECT county, replace(key, '#', '-') AS key, unit, arg_max(replace(address, 'Rd.,', 'Rd,'), (sale_date, line_no)) AS display, arg_max(house_number, (sale_date, line_no)) AS house_number,
  arg_max(eircode, (sale_date, line_no)) FILTER (WHERE eircode IS NOT NULL) AS eircode FROM k GROUP BY ALL""",
    "sale property register parsed filed",
)
def register_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.properties_filed(parsed(spark, sf_dir), COUNTIES).select("county", "key", "unit", "display", "house_number", "eircode")


@query(
    f"""WITH {_STAGED}, d AS (SELECT DISTINCT county, replace(key, '#', '-') AS key, unit FROM k), v AS (SELECT *, CAST('0x' || left(sha256(county || '|' || key || '|' || coalesce(unit, '')), 15) AS BIGINT) AS v FROM d)
SELECT county, key, unit, array_to_string(list_transform(range(12), lambda i: substr('abcdefghijklmnopqrstuvwxyz234567', CAST(((v >> CAST(55 - 5 * i AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS public_id FROM v""",
    "sale property register parsed filed",
)
def public_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base-32 identifiers of properties."""
    return R.properties_filed(parsed(spark, sf_dir), COUNTIES).select("county", "key", "unit", "public_id")


_HELD = "SELECT property_id, CAST(property_id % 40 + 1 AS VARCHAR) || ' ' || county AS name, CASE WHEN property_id % 3 = 0 THEN NULL ELSE routing_key END AS code FROM property WHERE property_id % 10 <> 9"
_NEW = "SELECT property_id, CAST(property_id % 40 + 1 AS VARCHAR) || ' ' || county AS name, CASE WHEN property_id % 6 = 0 THEN routing_key WHEN property_id % 3 = 0 THEN NULL ELSE routing_key END AS code FROM property WHERE property_id % 10 <> 0"


@query(
    f"""WITH a AS ({_HELD}), b AS ({_NEW})
SELECT coalesce(a.property_id, b.property_id) AS property_id, CASE WHEN b.property_id IS NOT NULL THEN b.name ELSE a.name END AS name, CASE WHEN b.property_id IS NOT NULL THEN b.code ELSE a.code END AS code,
  CASE WHEN b.property_id IS NULL THEN 'kept' WHEN a.property_id IS NULL THEN 'inserted' WHEN (a.name, a.code) IS DISTINCT FROM (b.name, b.code) THEN 'updated' ELSE 'unchanged' END AS action
FROM a FULL JOIN b ON a.property_id = b.property_id""",
    "property",
)
def register_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of properties: one lacks every tenth, the other lacks other ones and knows more codes."""
    p, i = B.properties(spark, sf_dir), F.col("property_id")
    name = F.concat((i % 40 + 1).cast("string"), F.lit(" "), "county").alias("name")
    held = p.filter(i % 10 != 9).select("property_id", name, F.when(i % 3 != 0, F.col("routing_key")).alias("code"))
    new = p.filter(i % 10 != 0).select("property_id", name, F.when((i % 6 == 0) | (i % 3 != 0), F.col("routing_key")).alias("code"))
    return R.upserted(held, new, ["property_id"])


@query(
    """WITH h AS (SELECT row_hash, 1 AS first_seen, 2 AS last_seen, CASE WHEN line_no % 17 = 0 THEN 2 END AS withdrawn_in FROM filed WHERE line_no % 19 <> 0), f AS (SELECT row_hash FROM filed WHERE line_no % 23 <> 0)
SELECT coalesce(h.row_hash, f.row_hash) AS row_hash, coalesce(first_seen, 3) AS first_seen, CASE WHEN f.row_hash IS NOT NULL THEN 3 ELSE last_seen END AS last_seen,
  CASE WHEN f.row_hash IS NULL THEN coalesce(withdrawn_in, 3) END AS withdrawn_in FROM h FULL JOIN f ON h.row_hash = f.row_hash""",
    "sale property register parsed filed",
)
def register_refile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held sales against a new full file: seen again, withdrawn or new."""
    rows, line = R.with_repeats(parsed(spark, sf_dir)), F.col("line_no")
    held = rows.filter(line % 19 != 0).select("row_hash", F.lit(1).alias("first_seen"), F.lit(2).alias("last_seen"), F.when(line % 17 == 0, 2).alias("withdrawn_in"))
    return R.refiled(held, rows.filter(line % 23 != 0), 3)


def _rekeyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Held sales, and a file in which some customers' sales have another property identifier."""
    sale = B.sales(spark, sf_dir)
    i, own = F.col("property_id"), F.col("property_id").cast("string")
    name = F.sha2(F.col("sale_id").cast("string"), 256).alias("row_hash")
    new = F.when(i % 7 == 0, F.concat(own, F.lit("n"))).when((i % 7 == 1) & (F.col("sale_id") % 2 == 0), F.concat((i + 1).cast("string"))).otherwise(own)
    return sale.filter("sale_id % 11 <> 0").select(name, "sale_date", own.alias("public_id")), sale.select(name, "sale_date", new.alias("public_id"))


_REKEYED = """
h AS (SELECT sha256(CAST(sale_id AS VARCHAR)) AS row_hash, sale_date, CAST(property_id AS VARCHAR) AS public_id FROM sale WHERE sale_id % 11 <> 0),
s AS (SELECT sha256(CAST(sale_id AS VARCHAR)) AS row_hash, CASE WHEN property_id % 7 = 0 THEN CAST(property_id AS VARCHAR) || 'n' WHEN property_id % 7 = 1 AND sale_id % 2 = 0 THEN CAST(property_id + 1 AS VARCHAR) ELSE CAST(property_id AS VARCHAR) END AS new_id FROM sale),
m AS (SELECT h.row_hash, h.sale_date, h.public_id AS old_id, s.new_id FROM h JOIN s USING (row_hash) WHERE h.public_id <> s.new_id)"""


@query(f"WITH {_REKEYED} SELECT old_id, new_id, count(*) AS n FROM m GROUP BY ALL", "sale")
def register_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.moved(*_rekeyed(spark, sf_dir)).groupBy("old_id", "new_id").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_REKEYED}, a AS (SELECT coalesce(m.new_id, h.public_id) AS place, CASE WHEN m.new_id IS NOT NULL THEN h.public_id END AS was FROM h LEFT JOIN m USING (row_hash)),
i AS (SELECT old_id, arg_max(new_id, (sale_date, row_hash)) AS new_id FROM m WHERE old_id NOT IN (SELECT place FROM a) GROUP BY ALL),
o AS (SELECT place, was FROM a UNION ALL SELECT new_id, NULL FROM s WHERE row_hash NOT IN (SELECT row_hash FROM h))
SELECT old_id, new_id, NOT EXISTS (SELECT 1 FROM o WHERE o.place = i.new_id AND o.was IS DISTINCT FROM i.old_id) AS inherits FROM i""",
    "sale",
)
def register_retired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties that a change of the key rules left without sales, and whether their successor inherits their place."""
    held, file = _rekeyed(spark, sf_dir)
    return R.retired(held, R.moved(held, file), file)


_RETIRED = """place AS (SELECT coalesce(m.new_id, h.public_id) AS spot FROM h LEFT JOIN m USING (row_hash)),
gone AS (SELECT old_id, arg_max(new_id, (sale_date, row_hash)) AS new_id FROM m WHERE old_id NOT IN (SELECT spot FROM place) GROUP BY ALL)"""


@query(
    f"""WITH {_REKEYED}, k AS (SELECT DISTINCT public_id FROM h UNION SELECT DISTINCT new_id FROM s), p AS (SELECT public_id, coalesce(TRY_CAST(public_id AS BIGINT) % 3 = 0, false) AS suppressed FROM k)
SELECT public_id, suppressed OR public_id IN (SELECT new_id FROM m JOIN p o ON o.public_id = m.old_id WHERE o.suppressed) AS suppressed FROM p""",
    "sale",
)
def register_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Homes hidden on request after a change of the key rules: whatever takes their sales is hidden too."""
    held, file = _rekeyed(spark, sf_dir)
    known = held.select("public_id").union(file.select("public_id")).distinct()
    places = known.select("public_id", F.coalesce(F.expr("try_cast(public_id as bigint) % 3 = 0"), F.lit(False)).alias("suppressed"))
    return R.hidden_after(places, R.moved(held, file))


@query(
    f"""WITH {_REKEYED}, {_RETIRED}, i AS (SELECT DISTINCT user_id, CAST(n AS VARCHAR) AS public_id FROM (SELECT user_id, unnest([event_id % 150 + 1, event_id % 140 + 2]) AS n FROM events)),
t AS (SELECT user_id, public_id AS was, coalesce(new_id, public_id) AS public_id, new_id IS NOT NULL AS moved FROM i LEFT JOIN gone ON public_id = old_id)
SELECT user_id, public_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id, public_id ORDER BY moved, was) AS nth FROM t) WHERE NOT moved OR nth = 1 GROUP BY ALL""",
    "sale",
)
def register_saved_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved homes of each user after homes went into others: they follow, once for each user."""
    held, file = _rekeyed(spark, sf_dir)
    numbers = F.array(*((F.col("event_id") % n + a).cast("string") for n, a in ((150, 1), (140, 2))))
    items = B.read(spark, sf_dir, "events").select("user_id", F.explode(numbers).alias("public_id")).distinct()
    return R.repointed(items, R.retired(held, R.moved(held, file), file), "user_id").groupBy("user_id", "public_id").agg(F.count("*").alias("n"))


_BULK = """
a AS (SELECT s.sale_id, property_id, sale_date, cents - cents % 2500000 AS cents, county, string_split(lower(address), ', ')[-2] AS locality FROM sale s JOIN property USING (property_id) WHERE NOT withdrawn),
big AS (SELECT sale_date, cents FROM a WHERE cents > 40000000 GROUP BY ALL HAVING count(DISTINCT property_id) >= 2),
loc AS (SELECT sale_date, cents, county, locality, count(DISTINCT property_id) AS k FROM a GROUP BY ALL),
cty AS (SELECT sale_date, cents, county FROM a GROUP BY ALL HAVING count(DISTINCT property_id) >= 3),
ok AS (SELECT c.* FROM cty c WHERE cents % 5000000 <> 0 OR (SELECT max(k) FROM loc WHERE loc.sale_date = c.sale_date AND loc.cents = c.cents AND loc.county = c.county) >= 2),
m AS (SELECT sale_id, sale_date, cents, '*' AS scope FROM a JOIN big USING (sale_date, cents)
  UNION ALL SELECT sale_id, sale_date, cents, county FROM a JOIN ok USING (sale_date, cents, county) WHERE NOT EXISTS (SELECT 1 FROM big WHERE big.sale_date = a.sale_date AND big.cents = a.cents))"""


@query(
    f"""WITH {_BULK} SELECT sale_id, CAST(('0x' || left(md5(CAST(sale_date AS VARCHAR) || '|' || CAST(cents AS VARCHAR) || '|' || scope), 15)) AS BIGINT) AS group_id,
count(*) OVER (PARTITION BY sale_date, cents, scope) AS group_size FROM m""",
    "sale property",
)
def bulk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolio sales over bucketed prices, with thresholds that the test tables reach."""
    return bulk.bulk_groups(B.sales_by_place(spark, sf_dir), big=40_000_000, same=2, whole=5_000_000)


@query(
    """WITH t AS (SELECT p_partkey, lower(p_name) AS name FROM part), k AS (SELECT name, count(*) AS n, min(p_partkey) AS least FROM t GROUP BY ALL)
SELECT name, n, least, sha256(name) AS digest, md5(name) AS short, regexp_replace(name, '[^a-z0-9]+', '-', 'g') AS slug FROM k""",
)
def name_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes and slugs of the distinct part names."""
    names = B.read(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name")).groupBy("name").agg(F.count("*").alias("n"), F.min("p_partkey").alias("least"))
    return names.select("name", "n", "least", F.sha2("name", 256).alias("digest"), F.md5("name").alias("short"), X.slug(F.col("name")).alias("slug"))
