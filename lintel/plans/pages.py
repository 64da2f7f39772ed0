"""Queries behind pages: areas, properties, sources and permissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import finance
from lintel.operators import market as M
from lintel.operators import pages as P
from lintel.operators import statistics as S
from lintel.sources import binding as B

from .registry import query
from .statistics import _LAST, _ROLLING, monthly


@query(
    f"""WITH r AS ({_ROLLING}), e AS (SELECT CAST({_LAST} - INTERVAL 2 MONTH AS DATE) AS p), a AS (SELECT * FROM r WHERE segment = 'all'),
i AS (SELECT CAST(series + 1 AS BIGINT) AS area_id, period, value FROM price_index), l AS (SELECT area_id, max(period) AS period FROM i GROUP BY ALL),
m AS (SELECT n.area_id, {M.change_sql('n.value', 'b.value')} AS index_change FROM l JOIN i n USING (area_id, period) JOIN i b ON b.area_id = n.area_id AND b.period = l.period - INTERVAL 12 MONTH)
SELECT z.area_id, z.kind, z.name, CASE WHEN n.n IS NOT NULL THEN CAST(e.p + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) END AS window_end, n.n, n.median, (SELECT median FROM a JOIN e ON a.period = e.p WHERE area_id = 0) AS national,
  {M.change_sql('n.median', 'b.median')} AS change, m.index_change FROM area z CROSS JOIN e LEFT JOIN a n ON n.area_id = z.area_id AND n.period = e.p LEFT JOIN a b ON b.area_id = z.area_id AND b.period = e.p - INTERVAL 12 MONTH LEFT JOIN m ON m.area_id = z.area_id""",
    "sale sale_area area price_index",
)
def area_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = B.price_index(spark, sf_dir).select((F.col("series").cast("long") + 1).alias("area_id"), "period", "value")
    return P.headlines(S.rolling(monthly(spark, sf_dir).filter("segment = 'all'"), B.sales(spark, sf_dir), lags=P.HEADLINE_LAGS), B.sales(spark, sf_dir), B.areas(spark, sf_dir), index)


@query(f"WITH r AS ({_ROLLING}) SELECT * FROM r WHERE period >= DATE '1996-01-01'", "sale sale_area")
def area_rolling_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling figures from a first full year on (the test register begins earlier than the real one)."""
    return P.since_start(S.rolling(monthly(spark, sf_dir), B.sales(spark, sf_dir)), "1996-01-01")


@query(
    f"""WITH f AS (SELECT property_id, bool_or(vat_exclusive) AS vat, bool_or(not_full_market) AS market, bool_or(bulk_group_id IS NOT NULL) AS bulk, bool_or(sale_date >= {_LAST} - INTERVAL 1 MONTH) AS late FROM sale WHERE NOT withdrawn GROUP BY ALL)
SELECT property_id, concat_ws(',', CASE WHEN precision = 5 THEN 'unplaced' WHEN precision > 1 THEN 'approximate' END, CASE WHEN vat THEN 'without_vat' END, CASE WHEN market THEN 'not_market' END, CASE WHEN bulk THEN 'bulk' END, CASE WHEN late THEN 'provisional' END) AS caveats FROM property LEFT JOIN f USING (property_id)""",
    "sale property",
)
def property_caveats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.caveats(B.properties(spark, sf_dir), B.sales(spark, sf_dir))


@query(
    """SELECT property_id, sale_id, sale_date, cents, CASE WHEN vat_exclusive AND sale_date >= DATE '2003-01-01' THEN (cents * 11350 + 5000) // 10000 END AS with_vat,
  CAST(row_number() OVER (PARTITION BY property_id ORDER BY sale_date DESC, sale_id DESC) AS INTEGER) AS place FROM sale WHERE NOT withdrawn""",
    "sale",
)
def property_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sale of a property, newest first, with the tax added back where the price lacks it."""
    from pyspark.sql import Window as W

    shown = B.sales(spark, sf_dir).filter("not withdrawn").select("property_id", "sale_id", "sale_date", "cents", "vat_exclusive", F.lit("any").alias("dwelling"))
    rated = finance.with_vat_rate(shown, spark)
    place = F.row_number().over(W.partitionBy("property_id").orderBy(F.desc("sale_date"), F.desc("sale_id")))
    return rated.select("property_id", "sale_id", "sale_date", "cents", F.when(F.col("vat_exclusive"), finance.with_tax(F.col("cents"), F.col("rate"))).alias("with_vat"), place.alias("place"))


@query("SELECT p_brand AS source, CASE WHEN p_size % 3 = 0 THEN 'not_used' WHEN p_size % 2 = 0 THEN 'in_use' ELSE 'planned' END AS listed, count(*) AS n FROM part GROUP BY ALL")
def source_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.read(spark, sf_dir, "part").select(F.col("p_brand").alias("source"), (F.col("p_size") % 3 != 0).alias("use"), (F.col("p_size") % 2 == 0).alias("loaded"))
    return P.catalogue(rows).groupBy("source", "listed").agg(F.count("*").alias("n"))


_ROLE = "user_id AS role, event_type || ':' || CAST(length(props) AS VARCHAR(9)) AS permission"


@query(
    f"""WITH h AS (SELECT DISTINCT {_ROLE} FROM events WHERE event_id % 2 = 0), w AS (SELECT DISTINCT {_ROLE} FROM events WHERE event_id % 2 = 1)
SELECT role, permission, 'add' AS action FROM (SELECT * FROM w EXCEPT SELECT * FROM h) UNION ALL SELECT role, permission, 'remove' FROM (SELECT * FROM h EXCEPT SELECT * FROM w)"""
)
def permission_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs to add and to remove so that a held matrix becomes the wanted one: even events are what is held, odd ones what is wanted."""
    pairs = lambda c: B.read(spark, sf_dir, "events").filter(c).selectExpr(*_ROLE.split(", ")).distinct()
    return P.to_sync(pairs("event_id % 2 = 0"), pairs("event_id % 2 = 1"))
