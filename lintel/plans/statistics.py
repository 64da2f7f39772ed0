"""Queries over area statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions.geo import to_metres, to_metres_sql
from lintel.functions.quantiles import stats_sql
from lintel.operators import market as M
from lintel.operators import statistics as S
from lintel.sources import binding as B
from lintel.sources.scratch import kept

from .registry import query


def fanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fan_out(B.sales(spark, sf_dir), B.properties(spark, sf_dir))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.spread_counts(kept(M.own_counts(B.sales(spark, sf_dir), B.properties(spark, sf_dir)), "own"))


_LAST = "(SELECT date_trunc('month', max(sale_date)) FROM sale)"


def _stats_sql(span: str) -> str:
    return f"""
SELECT area_id, segment, CAST(date_trunc('{span}', sale_date) AS DATE) AS period, {stats_sql()},
  CAST(date_trunc('{span}', sale_date) AS DATE) + INTERVAL {S.SPANS[span]} MONTH - INTERVAL 1 DAY >= {_LAST} - INTERVAL 1 MONTH AS provisional
FROM sale_area {'WHERE detail' if span == 'month' else ''} GROUP BY ALL"""


@query(_stats_sql("month"), "sale sale_area")
def area_stats_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.area_stats(fanned(spark, sf_dir), B.sales(spark, sf_dir), "month")


@query(_stats_sql("quarter"), "sale sale_area")
def area_stats_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.area_stats(fanned(spark, sf_dir), B.sales(spark, sf_dir), "quarter")


@query(_stats_sql("year"), "sale sale_area")
def area_stats_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.area_stats(fanned(spark, sf_dir), B.sales(spark, sf_dir), "year")


_ROLLING = f"""
SELECT area_id, segment, period, {stats_sql()}, period + INTERVAL 1 MONTH - INTERVAL 1 DAY >= {_LAST} - INTERVAL 1 MONTH AS provisional
FROM (SELECT area_id, segment, cents, CAST(date_trunc('month', sale_date) + to_months(CAST(i AS INTEGER)) AS DATE) AS period FROM sale_area, range(12) r(i) WHERE detail)
WHERE period <= {_LAST} GROUP BY ALL"""


@query(_ROLLING, "sale sale_area")
def area_stats_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rolling(monthly(spark, sf_dir), B.sales(spark, sf_dir))


@query(
    f"""
WITH y AS ({_stats_sql('year')})
SELECT y.area_id, y.segment, y.period, y.n, y.median, b.n AS n_before, b.median AS median_before, {M.change_sql('y.median', 'b.median')} AS change
FROM y LEFT JOIN y b ON b.area_id = y.area_id AND b.segment = y.segment AND b.period + INTERVAL 12 MONTH = y.period""",
    "sale sale_area",
)
def area_year_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.year_before(S.area_stats(fanned(spark, sf_dir), B.sales(spark, sf_dir), "year"), "n", "median")
    return found.select("area_id", "segment", "period", "n", "median", "n_before", "median_before", M.change_permille(F.col("median"), F.col("median_before")).alias("change"))


@query(
    f"""
WITH y AS ({_stats_sql('year')}), last AS (SELECT max(period) AS period FROM y WHERE NOT provisional),
c AS (SELECT a.parent_id, a.area_id, a.name, y.n, y.median, row_number() OVER (PARTITION BY a.parent_id ORDER BY y.n DESC, a.name) AS place
  FROM y JOIN last USING (period) JOIN area a USING (area_id) WHERE y.segment = 'all' AND a.parent_id IS NOT NULL)
SELECT parent_id, area_id, name, n, median FROM c WHERE place <= 30""",
    "sale sale_area area",
)
def area_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty children of each area with most sales in the last complete year."""
    from pyspark.sql import Window as W

    stats = S.area_stats(fanned(spark, sf_dir).filter("segment = 'all'"), B.sales(spark, sf_dir), "year")
    last = stats.filter("not provisional").agg(F.max("period").alias("period"))
    children = stats.join(F.broadcast(last), "period").join(B.areas(spark, sf_dir), "area_id").filter("parent_id is not null")
    place = F.row_number().over(W.partitionBy("parent_id").orderBy(F.desc("n"), "name"))
    return children.withColumn("place", place).filter("place <= 30").select("parent_id", "area_id", "name", "n", "median")


@query(
    """
WITH up AS (SELECT area_id, area_id AS at, 0 AS depth FROM all_area UNION ALL SELECT up.area_id, a.parent_id, depth + 1 FROM up JOIN all_area a ON a.area_id = up.at WHERE a.parent_id IS NOT NULL)
SELECT up.area_id, up.depth, a.kind, a.name FROM up JOIN all_area a ON a.area_id = up.at""".replace("WITH RECURSIVE", "WITH"),
    "area all_area",
)
def area_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An area of any of the six kinds and those above it, level by level."""
    areas = B.all_areas(spark, sf_dir)
    return S.ancestors(areas).join(areas.select(F.col("area_id").alias("at"), "kind", "name"), "at").drop("at")


@query(
    f"""
WITH s AS ({_stats_sql('month')}), b AS (SELECT area_id, segment, min(period) AS a, max(period) AS z FROM s GROUP BY ALL),
m AS (SELECT area_id, segment, CAST(unnest(range(a, z + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE) AS period FROM b),
f AS (SELECT m.*, coalesce(n, 0) AS n, median, median IS NOT NULL AND NOT coalesce(provisional, false) AS shown FROM m LEFT JOIN s USING (area_id, segment, period)),
g AS (SELECT *, shown AND NOT coalesce(lag(shown) OVER w, false) AS begins FROM f WINDOW w AS (PARTITION BY area_id, segment ORDER BY period))
SELECT area_id, segment, period, n, median, CASE WHEN shown THEN CAST(sum(CAST(begins AS BIGINT)) OVER (PARTITION BY area_id, segment ORDER BY period) AS BIGINT) END AS run FROM g""",
    "sale sale_area",
)
def area_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.complete_series(S.area_stats(fanned(spark, sf_dir), B.sales(spark, sf_dir), "month"))


_BANDS = f"""
c AS (SELECT area_id, CAST(greatest(len(list_filter({list(S.BIN_EDGES)}, lambda e: cents / 100 >= e)) - 1, 0) AS INTEGER) AS band, count(*) AS n FROM sale_area WHERE segment = 'all' GROUP BY ALL),
k AS (SELECT area_id, CAST(i AS INTEGER) AS band FROM (SELECT DISTINCT area_id FROM c), range({len(S.BIN_EDGES)}) r(i)),
d AS (SELECT k.area_id, k.band, coalesce(c.n, 0) AS n FROM k LEFT JOIN c USING (area_id, band)),
t AS (SELECT band, n, sum(n) OVER () AS total FROM d WHERE area_id = 0)"""


@query(f"WITH {_BANDS} SELECT d.area_id, d.band, d.n, CAST((20000 * t.n + total) // (2 * total) AS BIGINT) AS national_share FROM d JOIN t USING (band)", "sale_area")
def area_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distribution(fanned(spark, sf_dir))


@query(
    f"""
WITH {_BANDS}, r AS (SELECT d.*, n < 5 AS low, max(CASE WHEN n BETWEEN 1 AND 4 THEN 1 ELSE 0 END) OVER (PARTITION BY area_id) = 1 AS any_few FROM d),
s AS (SELECT *, coalesce(sum(n) OVER w, 0) AS held, count(*) OVER w AS bands FROM r
  WINDOW w AS (PARTITION BY area_id ORDER BY low DESC, n, band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT area_id, band, CASE WHEN any_few AND (low OR held < 5 OR bands < 2) THEN NULL ELSE n END AS shown_n FROM s""",
    "sale_area",
)
def area_distribution_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.suppressed(S.distribution(fanned(spark, sf_dir))).select("area_id", "band", "shown_n")


@query(
    f"""
WITH s AS ({_stats_sql('month')}), r AS (SELECT * FROM s WHERE area_id = 0 AND segment = 'all' AND period > (SELECT max(period) FROM s WHERE area_id = 0) - INTERVAL 24 MONTH),
e AS (SELECT max(period) AS p FROM r WHERE NOT provisional)
SELECT period, n, median, provisional, (SELECT CAST(sum(n) AS BIGINT) FROM r, e WHERE NOT provisional AND period > p - INTERVAL 12 MONTH) AS last_12_n,
  (SELECT period FROM r ORDER BY n DESC, period LIMIT 1) AS busiest FROM r""",
    "sale sale_area",
)
def national_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.overview(fanned(spark, sf_dir), B.sales(spark, sf_dir))


@query(
    f"""WITH e AS (SELECT {_LAST} - INTERVAL 1 MONTH AS until), s AS (SELECT area_id, {stats_sql()} FROM sale_area, e WHERE segment = 'all' AND sale_date < until AND sale_date >= until - INTERVAL 12 MONTH GROUP BY area_id),
c AS (SELECT county_id AS area_id, CAST(floor(avg(x) + 0.5) AS BIGINT) AS x, CAST(floor(avg(y) + 0.5) AS BIGINT) AS y FROM (SELECT county_id, {to_metres_sql('lon', 'lat')} FROM property) GROUP BY ALL)
SELECT area_id, name, n, median, x, y, CAST(row_number() OVER (ORDER BY n DESC, name) AS INTEGER) AS place FROM s JOIN area USING (area_id) LEFT JOIN c USING (area_id) WHERE kind = 'county'""",
    "sale sale_area area property",
)
def overview_counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counties of the overview by their latest twelve months that are complete, with a point to label them at."""
    places = B.properties(spark, sf_dir).select(F.col("county_id").alias("area_id"), *to_metres(F.col("lon"), F.col("lat")))
    whole = lambda c: F.floor(F.avg(c) + 0.5).cast("long").alias(c)
    return S.county_table(fanned(spark, sf_dir), B.sales(spark, sf_dir), B.areas(spark, sf_dir), places.groupBy("area_id").agg(whole("x"), whole("y")))


@query(
    f"""WITH r AS (SELECT max(event_id) AS run_id FROM events WHERE event_type = 'purchase' AND user_id % 3 <> 0), s AS (SELECT max(sale_date) AS last_sale FROM sale WHERE NOT withdrawn)
SELECT last_sale, CAST(date_trunc('month', last_sale) - INTERVAL 1 MONTH AS DATE) AS provisional_from, strftime(last_sale, '%Y-%m-%d') || '.r' || run_id || '.a18' AS version FROM r, s""",
    "sale",
)
def register_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register's dates and version; every event stands for a run."""
    status = F.when(F.col("user_id") % 3 != 0, "succeeded").otherwise("failed")
    runs = B.read(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.when(F.col("event_type") == "purchase", "register").otherwise("other").alias("kind"), status.alias("status"))
    return S.register_version(B.sales(spark, sf_dir), runs, 18)


@query(
    f"""WITH e AS (SELECT CAST({_LAST} - INTERVAL 1 MONTH AS DATE) AS open), d AS (SELECT DISTINCT area_id, detail FROM sale_area),
w AS (SELECT a.area_id, a.kind, CASE WHEN coalesce(d.detail, false) THEN CAST(open - INTERVAL 1 DAY AS DATE) ELSE CAST(date_trunc('year', open) - INTERVAL 1 DAY AS DATE) END AS until FROM all_area a LEFT JOIN d USING (area_id) CROSS JOIN e),
x AS (SELECT *, CAST(until + INTERVAL 1 DAY - INTERVAL 12 MONTH AS DATE) AS since FROM w),
s AS (SELECT area_id, {stats_sql()} FROM sale_area JOIN x USING (area_id) WHERE segment = 'all' AND sale_date BETWEEN since AND until GROUP BY area_id)
SELECT area_id, kind, since, until, coalesce(n, 0) AS n, median FROM x LEFT JOIN s USING (area_id)""",
    "sale sale_area area all_area",
)
def complete_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window that heads each area's page, of all six kinds."""
    return S.complete_windows(fanned(spark, sf_dir), B.sales(spark, sf_dir), B.all_areas(spark, sf_dir))


_GRID = f"""
WITH l AS (SELECT m.*, {to_metres_sql('lon', 'lat')} FROM market m JOIN property p USING (property_id) WHERE p.precision <= 1),
c AS (SELECT s.size, CAST(floor(x / s.size) AS BIGINT) AS i, CAST(floor(y / s.size) AS BIGINT) AS j, w."window", g.segment, cents
  FROM l, (VALUES (2000), (8000), (32000)) s(size), (VALUES (12), (36)) w("window"), LATERAL (VALUES ('all'), (CASE WHEN is_new THEN 'new' ELSE 'second_hand' END)) g(segment)
  WHERE date_trunc('month', sale_date) > {_LAST} - to_months(w."window"))
SELECT size, i, j, "window", segment, {stats_sql()} FROM c GROUP BY ALL"""


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market sales of precisely placed properties with positions in metres."""
    places = B.properties(spark, sf_dir).filter("precision <= 1").select("property_id", *to_metres(F.col("lon"), F.col("lat")))
    return B.sales(spark, sf_dir).filter(M.is_market()).join(places, "property_id")


@query(_GRID, "sale market property")
def price_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.grid_stats(located(spark, sf_dir), B.sales(spark, sf_dir))


@query(
    f"""WITH g AS ({_GRID}) SELECT z.zoom, g.i, g.j, g.n, g.median FROM g JOIN (VALUES (6, 32000), (9, 8000), (12, 2000)) z(zoom, size) USING (size)
WHERE g."window" = 12 AND g.segment = 'all' AND g.i BETWEEN -8 * 32000 // g.size AND 8 * 32000 // g.size""",
    "sale market property",
)
def price_grid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that a map shows at a zoom: coarse below 8, middle below 10, else fine; within a box."""
    zooms = F.array(*(F.struct(F.lit(z).alias("zoom"), F.lit(32_000 if z < 8 else 8_000 if z < 10 else 2_000).alias("shown")) for z in (6, 9, 12)))
    cells = price_grid(spark, sf_dir).filter("window = 12 and segment = 'all'").withColumn("z", F.explode(zooms)).filter("z.shown = size")
    edge = F.expr("8 * 32000 div size")
    return cells.filter(F.col("i").between(-edge, edge)).select("z.zoom", "i", "j", "n", "median")


@query("SELECT a.area_id, a.kind, a.name, c.name AS county FROM all_area a LEFT JOIN all_area u ON u.area_id = a.parent_id LEFT JOIN all_area c ON c.area_id = CASE WHEN a.kind = 'county' THEN a.area_id WHEN u.kind = 'county' THEN u.area_id ELSE u.parent_id END AND c.kind = 'county'", "area all_area")
def area_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every area with the county that it is or lies in."""
    areas = B.all_areas(spark, sf_dir)
    counties = areas.filter("kind = 'county'").select(F.col("area_id").alias("at"), F.col("name").alias("county"))
    within = S.ancestors(areas).join(counties, "at").select("area_id", "county")
    return areas.join(within, "area_id", "left").select("area_id", "kind", "name", "county")
