"""Queries over account records, exports, summaries and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions.quantiles import stats_sql
from lintel.operators import records as R
from lintel.operators import statistics as S
from lintel.sources import binding as B

from .places import _VICINITY, vicinity
from .registry import query
from .searching import _USUAL, matches
from .statistics import _LAST, fanned

_NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def now() -> object:
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


VIEWS_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT user_id, event_type, rn, event_id, us AS last, true AS kept FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.event_type, e.rn, e.event_id, CASE WHEN e.us - w.last > 21600000000 THEN e.us ELSE w.last END, e.us - w.last > 21600000000 FROM w JOIN e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.rn = w.rn + 1)
SELECT event_id AS view_id, kept FROM w"""


@query(VIEWS_SQL)
def view_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a user and kind of page, kept if none that counts lies within six hours before: sequential, so the twin recurses row by row."""
    return R.kept_views(events(spark, sf_dir).select(F.col("event_id").alias("view_id"), "user_id", F.col("event_type").alias("item"), "ts"), gap_s=6 * 3600)


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT user_id, rn, event_id, us, us AS begun, 1 AS n FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.rn, e.event_id, e.us, CASE WHEN e.us - w.begun >= 86400000000 THEN e.us ELSE w.begun END, CASE WHEN e.us - w.begun >= 86400000000 THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
SELECT event_id AS call_id, n > 5 AS refused, CASE WHEN n > 5 THEN greatest(1, 86400 - (us - begun) // 1000000) ELSE 0 END AS retry_s FROM w"""
)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls refused in windows that begin with a user's first call; sequential too."""
    return R.limited(events(spark, sf_dir).select(F.col("event_id").alias("call_id"), "user_id", "ts"), most=5, window_s=24 * 3600)


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def newest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.newest(events(spark, sf_dir), "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id")


@query(f"SELECT event_type, count(*) AS n FROM events WHERE ts >= {_NOW} - INTERVAL 20 DAY GROUP BY ALL")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retained(events(spark, sf_dir), now(), 20).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    f"""WITH s AS (SELECT event_id AS session_id, user_id, ts AS last_seen, ts + INTERVAL 25 DAY AS expires_at FROM events), r AS (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS roles FROM events GROUP BY ALL)
SELECT session_id, user_id, coalesce(roles, '') AS roles, last_seen < {_NOW} - INTERVAL 5 MINUTE AS touch FROM s LEFT JOIN r USING (user_id) WHERE expires_at > {_NOW} AND last_seen > {_NOW} - INTERVAL 14 DAY""",
)
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    sessions = e.select(F.col("event_id").alias("session_id"), "user_id", F.col("ts").alias("last_seen"), (F.col("ts") + F.make_dt_interval(F.lit(25))).alias("expires_at"))
    return R.live_sessions(sessions, e.select("user_id", F.col("event_type").alias("role")), now())


@query(
    """WITH s AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 'near=here&type=' || event_type ELSE 'type=' || event_type END AS params, ts FROM events)
SELECT user_id, params, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, count(*) AS times FROM s GROUP BY ALL""",
)
def private_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("near="), F.round(F.col("value"), 2).cast("string"), F.lit(",-6.2&"))).otherwise("")
    searches = events(spark, sf_dir).select("user_id", F.concat(near, F.lit("type="), "event_type").alias("params"), "ts")
    return R.private_history(searches).select("user_id", "params", F.unix_micros("ts").alias("last_us"), "times")


@query(
    f"""WITH m AS ({_USUAL}), q AS (SELECT n_nationkey AS search_id, 100 + n_nationkey AS settlement_id, n_nationkey % 5 <> 4 AS active, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey % 7 END AS through FROM nation),
s AS (SELECT *, CAST(sale_id % 9 AS INTEGER) AS first_seen FROM sale WHERE NOT withdrawn AND NOT possible_duplicate)
SELECT DISTINCT search_id, m.property_id, m.sale_date, m.cents FROM m JOIN q USING (settlement_id) JOIN s ON s.property_id = m.property_id AND s.sale_date = m.sale_date AND s.cents = m.cents
WHERE active AND coalesce(through, 0) < 7 AND search_id % 11 <> 5 AND first_seen > coalesce(through, 0) AND first_seen <= 7""",
    "sale property",
)
def alert_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One saved search a settlement: its matches first seen since it was last told, unless already delivered."""
    key = F.col("n_nationkey")
    nations = B.read(spark, sf_dir, "nation")
    searches = nations.select(key.alias("search_id"), (key % 5 != 4).alias("active"), F.when(key % 3 != 0, key % 7).alias("through"))
    delivered = nations.filter(key % 11 == 5).select(key.alias("search_id"), F.lit(7).alias("version"))
    found = matches(spark, sf_dir).withColumn("search_id", (F.col("settlement_id") - 100).cast("int"))
    return R.new_matches(found, B.sales(spark, sf_dir).withColumn("first_seen", (F.col("sale_id") % 9).cast("int")), searches, delivered, 7)


@query(
    """WITH l AS (SELECT property_id, max(sale_date) AS last, count(*) AS n FROM sale GROUP BY ALL) SELECT property_id, precision, last, coalesce(n, 0) AS n FROM property LEFT JOIN l USING (property_id)
WHERE NOT suppressed AND precision >= 2 ORDER BY last DESC NULLS LAST, property_id LIMIT 25 OFFSET 25""",
    "sale property",
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarsely placed properties, last sold first: second page."""
    last = B.sales(spark, sf_dir).groupBy("property_id").agg(F.max("sale_date").alias("last"), F.count("*").alias("n"))
    queue = B.properties(spark, sf_dir).filter("not suppressed and precision >= 2").select("property_id", "precision").join(last, "property_id", "left").na.fill(0, ["n"])
    return queue.orderBy(F.desc_nulls_last("last"), "property_id").offset(25).limit(25)


WANTED = (41, 7, 23, 99)


@query(
    """WITH w AS (SELECT unnest([41, 7, 23, 99]) AS property_id, unnest([0, 1, 2, 3]) AS pos), l AS (SELECT * FROM sale WHERE NOT withdrawn AND NOT possible_duplicate QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY sale_date DESC, sale_id DESC) = 1)
SELECT CAST(pos AS INTEGER) AS pos, CAST(property_id AS BIGINT) AS property_id, sale_date, cents FROM w LEFT JOIN l USING (property_id)""",
    "sale",
)
def compare_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four wished-for properties with their latest price, in the order given."""
    from lintel.operators.market import latest

    wanted = spark.range(1).select(F.posexplode(F.array(*(F.lit(w).cast("long") for w in WANTED))).alias("pos", "property_id"))
    shown = B.sales(spark, sf_dir).filter("not withdrawn and not possible_duplicate").join(F.broadcast(wanted), "property_id", "left_semi")
    last = latest(shown.select("property_id", "sale_date", "sale_id", "cents"), "property_id", "sale_date", "sale_id")
    return wanted.join(last, "property_id", "left").orderBy("pos").select("pos", "property_id", "sale_date", "cents")


@query(
    r'''SELECT concat_ws(',', CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 4 = 0 THEN chr(39) || '=' || c_mktsegment ELSE c_mktsegment END, '"' || c_name || ', ""x"""', 'Licence A') AS line FROM customer ORDER BY c_custkey LIMIT 500'''
)
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export lines: quoted where needed, formulas disarmed, capped by role."""
    segment = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("="), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    rows = B.read(spark, sf_dir, "customer").select("c_custkey", segment.alias("segment"), F.concat("c_name", F.lit(', "x"')).alias("name"))
    return R.export(rows, 500, "Licence A", "c_custkey")


#: The property page: its sales newest first, the area whose median is published, and the nearest stop and schools of precisely placed properties.
_SUMMARY = f"""
y AS (SELECT area_id, n, median FROM (SELECT area_id, {stats_sql()} FROM sale_area WHERE detail AND segment = 'all' AND sale_date >= {_LAST} - INTERVAL 11 MONTH GROUP BY area_id) WHERE median IS NOT NULL),
shown AS (SELECT * FROM sale WHERE NOT withdrawn AND NOT possible_duplicate), near AS ({_VICINITY}),
page AS (SELECT p.property_id, p.address, coalesce(a.name, b.name) AS area, coalesce(a.kind, b.kind) AS kind, coalesce(y.median, z.median) AS median, coalesce(y.n, z.n) AS area_n, stop_m, primary_m, post_primary_m
  FROM property p LEFT JOIN y ON y.area_id = p.settlement_id LEFT JOIN area a ON a.area_id = y.area_id LEFT JOIN y z ON z.area_id = p.county_id LEFT JOIN area b ON b.area_id = z.area_id LEFT JOIN near ON near.property_id = p.property_id)"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = S.rolling_last(fanned(spark, sf_dir), B.sales(spark, sf_dir))
    return R.summaries(B.properties(spark, sf_dir), B.sales(spark, sf_dir), stats, B.areas(spark, sf_dir), vicinity(spark, sf_dir))


@query(
    f"""WITH {_SUMMARY}, s AS (SELECT property_id, count(*) AS n, arg_max(cents, (sale_date, sale_id)) AS cents FROM shown GROUP BY ALL)
SELECT property_id, address, CAST(coalesce(s.n, 0) AS INTEGER) AS n, s.cents, area, median, stop_m, primary_m, post_primary_m FROM page LEFT JOIN s USING (property_id)""",
    "sale property area sale_area poi",
)
def property_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON payload of every property, read back."""
    read = F.from_json("payload", "address string, latestSale struct<cents: long>, previousSales array<struct<cents: long>>, area struct<name: string, median: long>, vicinity struct<stop_m: long, primary_m: long, post_primary_m: long>")
    pages = summaries(spark, sf_dir).select("property_id", read.alias("p"))
    n = F.size("p.previousSales") + F.col("p.latestSale").isNotNull().cast("int")
    return pages.select("property_id", "p.address", n.alias("n"), "p.latestSale.cents", F.col("p.area.name").alias("area"), "p.area.median", "p.vicinity.*")


_FLAG = lambda c: f"CASE WHEN {c} THEN 'true' ELSE 'false' END"
_SALE = f"""'{{"date":"' || strftime(sale_date, '%Y-%m-%d') || '","cents":' || cents || ',"flags":{{"notFullMarketPrice":' || {_FLAG('not_full_market')} || ',"vatExclusive":' || {_FLAG('vat_exclusive')} || ',"bulk":' || {_FLAG('bulk_group_id IS NOT NULL')} || '}}}}'"""


@query(
    f"""WITH {_SUMMARY}, s AS (SELECT property_id, list({_SALE} ORDER BY sale_date DESC, sale_id DESC) AS l FROM shown GROUP BY property_id)
SELECT property_id, '{{' || concat_ws(',', '"id":' || property_id, '"address":"' || address || '"', '"latestSale":' || l[1], '"previousSales":[' || coalesce(array_to_string(l[2:], ','), '') || ']',
  '"area":{{"name":"' || area || '","kind":"' || kind || '","median":' || median || ',"n":' || area_n || '}}',
  '"vicinity":{{' || concat_ws(',', '"stop_m":' || stop_m, '"primary_m":' || primary_m, '"post_primary_m":' || post_primary_m) || '}}') || '}}' AS payload
FROM page LEFT JOIN s USING (property_id)""",
    "sale property area sale_area poi",
)
def property_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload as JSON text; absent values are left out."""
    return summaries(spark, sf_dir)


@query(
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, count(*) FILTER (WHERE c IS NULL) AS missing, count(DISTINCT c) AS "distinct", min(c) AS least, max(c) AS most,
  CAST(floor(quantile_cont(c, 0.01) + 0.5) AS BIGINT) AS p1, CAST(floor(quantile_cont(c, 0.5) + 0.5) AS BIGINT) AS p50, CAST(floor(quantile_cont(c, 0.99) + 0.5) AS BIGINT) AS p99
FROM (SELECT o_orderdate, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) END AS c FROM orders) GROUP BY ALL"""
)
def data_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, missing values and quantiles by year; every tenth price is blanked."""
    rows = B.sales(spark, sf_dir).select(F.year("sale_date").alias("year"), F.when(F.col("sale_id") % 10 != 0, F.col("cents")).alias("cents"))
    return R.profile(rows, "cents", "year")


@query("SELECT o_orderstatus AS status, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low, count(*) AS n FROM orders GROUP BY ALL")
def data_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = B.read(spark, sf_dir, "orders")
    urgent, low = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    return orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count_if(urgent).alias("urgent"), F.count_if(low).alias("low"), F.count("*").alias("n"))


@query(
    """SELECT area, key, value, text FROM (SELECT n_name AS area, unnest(['relative_index', 'absolute_index', 'category']) AS key, unnest([CAST(n_nationkey AS DOUBLE) / 2, CAST(n_regionkey AS DOUBLE), CAST(n_nationkey % 8 AS DOUBLE)]) AS value,
  unnest([NULL, NULL, 'band ' || CAST(n_nationkey % 8 AS VARCHAR)]) AS text FROM nation)"""
)
def deprivation_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row an area to three long ones."""
    key = F.col("n_nationkey")
    one = lambda k, v, t=F.lit(None).cast("string"): F.struct(F.lit(k).alias("key"), v.cast("double").alias("value"), t.alias("text"))
    rows = F.array(one("relative_index", key / 2), one("absolute_index", F.col("n_regionkey")), one("category", key % 8, F.concat(F.lit("band "), (key % 8).cast("string"))))
    return B.read(spark, sf_dir, "nation").select(F.col("n_name").alias("area"), F.explode(rows).alias("r")).select("area", "r.*")
