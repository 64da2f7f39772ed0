"""Queries over the price index, estimates, comparable sales and calculators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import finance, geo
from lintel.operators import estimate as E
from lintel.sources import binding as B

from .registry import query

_PLACED = "SELECT property_id, CAST(county_id - 1 AS INTEGER) AS series FROM property WHERE precision <= 1 AND NOT suppressed"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.properties(spark, sf_dir).filter("precision <= 1 and not suppressed").select("property_id", (F.col("county_id") - 1).cast("int").alias("series"))


@query("SELECT series, period, value FROM price_index", "price_index")
def price_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.price_index(spark, sf_dir)


_PAIRS = f"""
z AS ({_PLACED}), r AS (SELECT p.*, z.series FROM plain p JOIN z USING (property_id) WHERE cents >= 1000000),
q AS (SELECT property_id, series, lag(CAST(date_trunc('month', sale_date) AS DATE)) OVER w AS m1, lag(cents) OVER w AS cents1, CAST(date_trunc('month', sale_date) AS DATE) AS m2, cents AS cents2 FROM r WINDOW w AS (PARTITION BY property_id ORDER BY sale_date, sale_id)),
pairs AS (SELECT * FROM q WHERE m2 >= m1 + INTERVAL 6 MONTH)"""
_USES = "sale property market plain price_index"


@query(f"WITH {_PAIRS} SELECT * FROM pairs", _USES)
def repeat_sale_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.repeat_pairs(B.sales(spark, sf_dir), series(spark, sf_dir))


_CALIBRATION = f"""
{_PAIRS}, e AS (SELECT p.series, CASE WHEN m2 - m1 < 3 * 365.25 THEN '0-3y' WHEN m2 - m1 < 7 * 365.25 THEN '3-7y' ELSE '7y+' END AS band,
  CAST(round(ln(cents2 / (cents1 * (b.value / a.value))) * 1000000) AS BIGINT) AS e FROM pairs p JOIN price_index a ON a.series = p.series AND a.period = m1 JOIN price_index b ON b.series = p.series AND b.period = m2),
g AS (SELECT CAST(series AS VARCHAR) AS series, band, e FROM e UNION ALL SELECT 'all', band, e FROM e),
c AS (SELECT series, band, count(*) AS n, CAST(floor(quantile_cont(e, 0.1) + 0.5) AS BIGINT) AS p10, CAST(floor(quantile_cont(e, 0.5) + 0.5) AS BIGINT) AS p50, CAST(floor(quantile_cont(e, 0.9) + 0.5) AS BIGINT) AS p90 FROM g GROUP BY ALL)"""


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = B.price_index(spark, sf_dir)
    return E.calibrate(E.index_errors(E.repeat_pairs(B.sales(spark, sf_dir), series(spark, sf_dir)), index))


@query(f"WITH {_CALIBRATION} SELECT * FROM c", _USES)
def index_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration(spark, sf_dir)


@query(
    f"""WITH {_CALIBRATION}, l AS (SELECT * FROM plain QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY sale_date DESC, sale_id DESC) = 1),
s AS (SELECT series, min(period) AS first, max(period) AS last FROM price_index GROUP BY ALL),
m AS (SELECT p.property_id, p.precision, l.sale_id, l.cents, CAST(date_trunc('month', l.sale_date) AS DATE) AS sold, s.first, s.last, i.value AS then_value, j.value AS now_value, s.series,
  (year(s.last) - year(l.sale_date)) * 12 + month(s.last) - month(l.sale_date) AS months FROM property p LEFT JOIN l USING (property_id) LEFT JOIN s ON s.series = p.county_id - 1
  LEFT JOIN price_index i ON i.series = s.series AND i.period = date_trunc('month', l.sale_date) LEFT JOIN price_index j ON j.series = s.series AND j.period = s.last),
b AS (SELECT m.*, CASE WHEN months < 36 THEN '0-3y' WHEN months < 84 THEN '3-7y' ELSE '7y+' END AS band FROM m),
f AS (SELECT b.*, o.n IS NULL AS pooled, coalesce(o.p10, a.p10) AS p10, coalesce(o.p90, a.p90) AS p90, cents::DOUBLE / 100 * now_value / then_value AS mid,
  CASE WHEN precision > 1 THEN 'location' WHEN sale_id IS NULL THEN 'no_market_sale' WHEN first IS NULL THEN 'no_index' WHEN sold < first THEN 'before_index' WHEN months < 6 THEN 'recent' WHEN then_value IS NULL OR coalesce(o.p10, a.p10) IS NULL THEN 'no_index' END AS reason
  FROM b LEFT JOIN c o ON o.series = CAST(b.series AS VARCHAR) AND o.band = b.band AND o.n >= 150 LEFT JOIN c a ON a.series = 'all' AND a.band = b.band)
SELECT property_id, reason, CASE WHEN reason IS NULL THEN CAST(round_even(mid * exp(p10::DOUBLE / 1000000) / 1000, 0) AS BIGINT) * 1000 END AS low, CASE WHEN reason IS NULL THEN CAST(round_even(mid / 1000, 0) AS BIGINT) * 1000 END AS mid,
  CASE WHEN reason IS NULL THEN CAST(round_even(mid * exp(p90::DOUBLE / 1000000) / 1000, 0) AS BIGINT) * 1000 END AS high, CASE WHEN reason IS NULL THEN pooled END AS pooled FROM f""",
    _USES,
)
def price_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An estimate, or the first reason for none, for every property."""
    places = B.properties(spark, sf_dir).select("property_id", "precision", (F.col("county_id") - 1).cast("int").alias("series"))
    return E.estimates(places, B.sales(spark, sf_dir), B.price_index(spark, sf_dir), calibration(spark, sf_dir))


_AWAY = geo.metres_sql(geo.distance_sql("a.lon", "a.lat", "b.lon", "b.lat"))
_STREET = r"regexp_extract(lower({x}.address), '[0-9]+ ([^,]+),', 1)"


@query(
    f"""WITH p AS (SELECT property_id, lon, lat, trim({_STREET.format(x='property')}) AS street, county, address FROM property WHERE precision <= 1 AND NOT suppressed),
l AS (SELECT * FROM market WHERE sale_date > DATE '1996-01-01' QUALIFY row_number() OVER (PARTITION BY property_id ORDER BY sale_date DESC, sale_id DESC) = 1),
n AS (SELECT a.property_id, b.property_id AS other_id, {_AWAY} AS distance_m, a.street = b.street AS same_street, l.sale_date, l.cents, l.vat_exclusive FROM p a, p b JOIN l ON l.property_id = b.property_id WHERE a.property_id <> b.property_id AND {_AWAY} <= 40000),
s AS (SELECT property_id, count(*) AS total, count(*) FILTER (WHERE NOT vat_exclusive) AS median_n, CAST(floor(quantile_cont(cents, 0.5) FILTER (WHERE NOT vat_exclusive) + 0.5) AS BIGINT) AS m FROM n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY same_street DESC, distance_m, sale_date DESC, other_id) AS place FROM n)
SELECT property_id, CAST(place AS INTEGER) AS place, other_id, distance_m, same_street, sale_date, cents, total, median_n, CASE WHEN median_n >= 5 THEN m END AS median FROM r JOIN s USING (property_id) WHERE place <= 20""",
    "sale property market",
)
def comparable_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparables of every precisely placed property (radius 40 km: the test points are sparse)."""
    places = B.properties(spark, sf_dir).filter("precision <= 1 and not suppressed").select("property_id", "lon", "lat", "address")
    return E.comparables(places, places, B.sales(spark, sf_dir), B.areas(spark, sf_dir), F.lit("1996-01-01").cast("date"), radius_m=40_000)


_RATES = "CASE WHEN sale_date BETWEEN DATE '2025-10-08' AND DATE '2030-12-31' AND dwelling = 'qualifying_apartment' THEN 900 WHEN sale_date >= DATE '2003-01-01' THEN 1350 END"


@query(
    f"""WITH d AS (SELECT sale_id AS row_id, sale_date + CAST((sale_id % 4) * 3652 AS INTEGER) AS sale_date, CASE WHEN sale_id % 3 = 0 THEN 'qualifying_apartment' ELSE 'any' END AS dwelling, cents FROM sale),
r AS (SELECT *, {_RATES} AS rate FROM d)
SELECT row_id, rate, (cents * (10000 + rate) + 5000) // 10000 AS with_tax, cents * 10000 // (10000 + rate) AS without_tax FROM r""",
    "sale",
)
def vat_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tax in force on a sale's day (days spread over forty years), added and taken out."""
    day = F.date_add("sale_date", ((F.col("sale_id") % 4) * 3652).cast("int"))
    rows = B.sales(spark, sf_dir).select(F.col("sale_id").alias("row_id"), day.alias("sale_date"), F.when(F.col("sale_id") % 3 == 0, "qualifying_apartment").otherwise("any").alias("dwelling"), "cents")
    found = finance.with_vat_rate(rows, spark)
    return found.select("row_id", (F.col("rate") * 10_000).cast("int").alias("rate"), finance.with_tax(F.col("cents"), F.col("rate")).alias("with_tax"), finance.without_tax(F.col("cents"), F.col("rate")).alias("without_tax"))


@query(f"SELECT sale_id, {finance.duty_sql('cents * 5')} AS duty, CASE WHEN cents * 5 >= 50000000 THEN 3 WHEN cents * 5 >= 35000000 THEN 2 WHEN cents * 5 >= 20000000 THEN 1 ELSE 0 END AS band FROM sale", "sale")
def stamp_duty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duty on five times the price, so that every band is reached, and the price band."""
    price = F.col("cents") * 5
    return B.sales(spark, sf_dir).select("sale_id", finance.duty(price).alias("duty"), finance.price_band(price / 100).alias("band"))


@query(
    """WITH b AS (SELECT c_custkey, CAST(floor(abs(c_acctbal) * 10) AS BIGINT) AS income, CAST(floor(abs(c_acctbal) * 4) + c_custkey AS BIGINT) AS deposit FROM customer),
p AS (SELECT *, deposit * 10 AS by_deposit, income * 4 + deposit AS by_income FROM b), l AS (SELECT *, least(by_deposit, by_income) AS price, CASE WHEN by_income < by_deposit THEN 'income' ELSE 'deposit' END AS limited_by FROM p)
SELECT c_custkey, price, limited_by, CASE WHEN price - deposit <= 0 THEN 0.0::DOUBLE ELSE round((price - deposit) * (4.0::DOUBLE / 1200) / (1 - power(1 + 4.0::DOUBLE / 1200, -360)), 2) END AS monthly FROM l""",
)
def affordability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a first-time buyer may borrow, and the monthly payment over thirty years at 4 %."""
    balance = F.abs("c_acctbal")
    rows = B.read(spark, sf_dir, "customer").select("c_custkey", F.floor(balance * 10).cast("long").alias("income"), (F.floor(balance * 4) + F.col("c_custkey")).cast("long").alias("deposit"))
    price, limit = finance.affordability(F.col("income"), F.col("deposit"), "first_time_buyer")
    rows = rows.withColumn("price", price).withColumn("limited_by", limit)
    return rows.select("c_custkey", "price", "limited_by", finance.repayment((F.col("price") - F.col("deposit")).cast("double"), F.lit(4.0), F.lit(30)).alias("monthly"))
