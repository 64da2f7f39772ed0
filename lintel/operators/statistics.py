"""Area statistics: periods, rolling windows, year-on-year, children, distributions, series and grid cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintel.functions.quantiles import group_stats, window_stats
from lintel.sources.scratch import kept

#: Upper bounds of price bands in whole currency units; the last band is open.
BIN_EDGES = tuple(range(0, 500_000, 50_000))
SPANS = {"month": 1, "quarter": 3, "year": 12}


def register_end(sales: DataFrame) -> DataFrame:
    """One row: the first day of the month of the latest sale."""
    return sales.agg(F.trunc(F.max("sale_date"), "MM").alias("last_month"))


def area_stats(fanned: DataFrame, sales: DataFrame, span: str) -> DataFrame:
    """Figures by area, segment and period; periods that reach into the last two months are provisional. Months are for areas with ``detail``."""
    fanned = fanned.filter("detail") if span == "month" else fanned
    # a country's year may have more distinct prices than a task should hold
    stats = group_stats(fanned.withColumn("period", F.trunc("sale_date", span)), ["area_id", "segment", "period"], wide=span != "month")
    ends = F.date_sub(F.add_months("period", SPANS[span]), 1)
    return stats.join(F.broadcast(register_end(sales))).withColumn("provisional", ends >= F.add_months("last_month", -1)).drop("last_month")


def rolling(monthly: DataFrame, sales: DataFrame, months: int = 12, lags: tuple[int, ...] | None = None) -> DataFrame:
    """Figures over the ``months`` months up to each month, for areas with ``detail``. A window is named by its last month, and provisional if that month is.

    ``monthly`` (``market.spread_counts`` or ``monthly_counts``) is read several times. Counts of ranges of prices go to the windows, and prices only where
    a window looks into their range. With ``lags``, only the windows that end so many months before the latest one are worked out, and counts outside them are left.
    """
    end = F.broadcast(kept(register_end(sales), "end"))

    def windows(rows: DataFrame) -> DataFrame:
        if lags is None:
            wide = rows.withColumn("period", F.explode(F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda i: F.add_months("m", i))))
            return wide.join(end, F.col("period") <= F.col("last_month")).drop("last_month", "m")
        ends = [F.add_months("last_month", -lag) for lag in lags]
        held = lambda w: F.when((F.col("m") <= w) & (F.col("m") > F.add_months(w, -months)), w)
        return rows.join(end).withColumn("period", F.explode(F.array_compact(F.array(*map(held, ends))))).drop("last_month", "m")

    if lags is not None:
        inside = lambda lag: (F.col("m") <= F.add_months("last_month", -lag)) & (F.col("m") > F.add_months("last_month", -lag - months))
        monthly = monthly.join(end, reduce(Column.__or__, map(inside, lags))).drop("last_month")
    stats = window_stats(monthly.withColumnRenamed("c", "k"), ["area_id", "segment"], windows).join(end)
    return stats.withColumn("provisional", F.date_sub(F.add_months("period", 1), 1) >= F.add_months("last_month", -1)).drop("last_month")


def rolling_last(fanned: DataFrame, sales: DataFrame, months: int = 12) -> DataFrame:
    """(area_id, segment, period, n, median, p25, p75, mean) of the one window that ends with the latest month: only its sales are counted, once."""
    end = register_end(sales)
    rows = fanned.filter("detail").join(F.broadcast(end)).filter(F.col("sale_date") >= F.add_months("last_month", 1 - months))
    return group_stats(rows, ["area_id", "segment"]).join(F.broadcast(end)).withColumnRenamed("last_month", "period")


def register_version(sales: DataFrame, runs: DataFrame, run: int) -> DataFrame:
    """One row: the latest sale, the first provisional day, and a version that names the register (its latest sale and the run that read it) and this run
    of the statistics, so that new figures of an old register have a version of their own. ``runs``: run_id, kind, status. No sales: an error."""
    last = sales.filter(~F.col("withdrawn")).agg(F.max("sale_date").alias("last_sale"))
    read = runs.filter("kind = 'register' and status = 'succeeded'").agg(F.max("run_id").alias("run_id"))
    known = F.when(F.col("last_sale").isNull(), F.raise_error(F.lit("no sales are loaded"))).otherwise(F.col("last_sale")).alias("last_sale")
    version = F.concat(F.date_format("last_sale", "yyyy-MM-dd"), F.lit(".r"), F.coalesce(F.col("run_id").cast("string"), F.lit("none")), F.lit(f".a{run}"))
    return last.select(known).join(F.broadcast(read)).select("last_sale", F.add_months(F.trunc("last_sale", "MM"), -1).alias("provisional_from"), version.alias("version"))


def complete_windows(fanned: DataFrame, sales: DataFrame, areas: DataFrame) -> DataFrame:
    """(area_id, kind, since, until, n, median): figures of each area's latest complete window, twelve months for kinds with ``detail``, else a calendar year.

    Complete means without a provisional month: the last two are. Areas without a sale in their window have n = 0.
    """
    ends = register_end(sales).select(F.add_months("last_month", -1).alias("open"))  # the first provisional month
    kinds = fanned.select("area_id", "detail").distinct()
    until = F.when(F.coalesce("detail", F.lit(False)), F.date_sub("open", 1)).otherwise(F.date_sub(F.trunc("open", "YEAR"), 1))
    asked = areas.join(kinds, "area_id", "left").join(F.broadcast(ends)).select("area_id", "kind", F.add_months(F.date_add(until, 1), -12).alias("since"), until.alias("until"))
    rows = fanned.filter("segment = 'all'").join(asked, "area_id").filter(F.col("sale_date").between(F.col("since"), F.col("until")))
    found = group_stats(rows, ["area_id"]).select("area_id", "n", "median")
    return asked.join(found, "area_id", "left").na.fill(0, ["n"])


def county_table(fanned: DataFrame, sales: DataFrame, areas: DataFrame, centres: DataFrame, months: int = 12) -> DataFrame:
    """(area_id, name, n, median, x, y, place): each county's figures over its latest window without a provisional month, most sales first. ``centres``: area_id, x, y.

    The last two months are provisional, so the window ends with the month before them.
    """
    end = register_end(sales).select(F.add_months("last_month", -1).alias("until"))
    rows = fanned.filter("segment = 'all'").join(F.broadcast(areas.filter("kind = 'county'").select("area_id")), "area_id", "left_semi").join(F.broadcast(end))
    rows = rows.filter((F.col("sale_date") < F.col("until")) & (F.col("sale_date") >= F.add_months("until", -months)))
    found = group_stats(rows, ["area_id"]).join(areas.select("area_id", "name"), "area_id").join(centres, "area_id", "left")
    # counties are few: one window without a key numbers them
    return found.select("area_id", "name", "n", "median", "x", "y", F.row_number().over(W.orderBy(F.desc("n"), "name")).alias("place"))


def ancestors(areas: DataFrame) -> DataFrame:
    """(area_id, at, depth): every area with itself and all areas above it, however deep the hierarchy is.

    Each round walks one level up and is written to the shared folder; the walk ends when no row has a parent. An area above itself raises an error.
    """
    up = areas.select(F.col("area_id").alias("at"), F.col("parent_id").alias("up"))
    step = areas.select("area_id", F.col("area_id").alias("at"), F.lit(0).alias("depth"))
    out, depth = step, 0
    while True:
        depth += 1
        step = kept(step.join(up, "at").filter("up is not null").select("area_id", F.col("up").alias("at"), F.lit(depth).alias("depth")), "ancestors")
        if step.isEmpty():
            return out
        if not step.filter("area_id = at").isEmpty():
            raise ValueError("an area lies above itself")
        out = out.unionByName(step)


def year_before(stats: DataFrame, *values: str) -> DataFrame:
    """Adds the values of the period twelve months earlier, met by key: periods may be missing, so a lag would be wrong."""
    before = stats.select("area_id", "segment", F.add_months("period", 12).alias("period"), *(F.col(v).alias(f"{v}_before") for v in values))
    return stats.join(before, ["area_id", "segment", "period"], "left")


def complete_series(stats: DataFrame) -> DataFrame:
    """Every month between an area's first and last one, missing ones with n = 0, and runs of months that are shown without a gap."""
    bounds = stats.groupBy("area_id", "segment").agg(F.min("period").alias("a"), F.max("period").alias("b"))
    months = bounds.select("area_id", "segment", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("period"))
    full = months.join(stats, ["area_id", "segment", "period"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    shown = F.col("median").isNotNull() & ~F.coalesce("provisional", F.lit(False))
    w = W.partitionBy("area_id", "segment").orderBy("period")
    begins = shown & ~F.coalesce(F.lag(shown).over(w), F.lit(False))
    numbered = full.withColumn("run", F.sum(begins.cast("long")).over(w))
    return numbered.select("area_id", "segment", "period", "n", "median", F.when(shown, F.col("run")).alias("run"))


def band_of(price: Column, edges: tuple[int, ...] = BIN_EDGES) -> Column:
    """Index of the price band, 0 first: how many edges the price reaches, less one."""
    return F.greatest(sum((price >= e).cast("int") for e in edges) - 1, F.lit(0))


def distribution(fanned: DataFrame) -> DataFrame:
    """Sales by area and price band, empty bands too, with the share of the country's sales in that band."""
    held = fanned.filter("segment = 'all'")
    counted = held.groupBy("area_id", band_of(F.col("cents") / 100).alias("band")).agg(F.count("*").alias("n"))
    bands = counted.select("area_id").distinct().withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(len(BIN_EDGES) - 1))))
    full = bands.join(counted, ["area_id", "band"], "left").na.fill(0, ["n"])
    national = full.filter("area_id = 0").select("band", F.col("n").alias("national_n"))
    total = national.agg(F.sum("national_n").alias("total"))
    rate = F.expr("(20000 * national_n + total) div (2 * total)").alias("national_share")
    return full.join(F.broadcast(national.join(F.broadcast(total)).select("band", rate)), "band")


def suppressed(bands: DataFrame, least: int = 5) -> DataFrame:
    """Complementary suppression: n is withheld so that no hidden band can be worked out from the total.

    Where some band holds 1 to least - 1 sales, those and the empty bands are hidden, then the smallest others until the hidden ones hold
    ``least`` sales or more in two bands or more. An area has a fixed number of bands, so running sums over an area's bands say
    which ones that takes: a band is hidden if what is hidden before it isn't enough.
    """
    few = F.col("n").between(1, least - 1)
    rank = F.when(F.col("n") < least, 0).otherwise(1)
    group, before = W.partitionBy("area_id"), W.partitionBy("area_id").orderBy("_rank", "n", "band").rowsBetween(W.unboundedPreceding, -1)
    rows = bands.withColumn("_rank", rank).withColumn("_any", F.max(few.cast("int")).over(group) == 1)
    rows = rows.withColumn("_sum", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("_count", F.count("*").over(before))
    hidden = F.col("_any") & ((F.col("_rank") == 0) | (F.col("_sum") < least) | (F.col("_count") < 2))
    return rows.withColumn("shown_n", F.when(~hidden, F.col("n"))).drop("_rank", "_any", "_sum", "_count")


def overview(fanned: DataFrame, sales: DataFrame, months: int = 24) -> DataFrame:
    """The country's last months: count, median, the count's total over the last twelve complete months, and the busiest month of all shown."""
    stats = area_stats(fanned.filter("area_id = 0 and segment = 'all'"), sales, "month")
    last = F.broadcast(stats.agg(F.max("period").alias("last")))
    recent = stats.join(last).filter(F.col("period") > F.add_months("last", -months)).drop("last")
    complete = recent.filter("not provisional")
    twelve = complete.join(F.broadcast(complete.agg(F.max("period").alias("end")))).filter(F.col("period") > F.add_months("end", -12))
    totals = twelve.agg(F.sum("n").alias("last_12_n"))
    busiest = recent.agg(F.max_by("period", F.struct("n", F.negative(F.unix_date("period")))).alias("busiest"))
    return recent.select("period", "n", "median", "provisional").join(F.broadcast(totals)).join(F.broadcast(busiest))


def grid_stats(located: DataFrame, sales: DataFrame, sizes: tuple[int, ...] = (2_000, 8_000, 32_000), windows: tuple[int, ...] = (12, 36)) -> DataFrame:
    """Figures by square cell (each level computed from the sales, not from the level below), window and segment. ``located``: x, y in metres."""
    levels = F.array(*(F.struct(F.lit(s).alias("size"), F.floor(F.col("x") / s).cast("long").alias("i"), F.floor(F.col("y") / s).cast("long").alias("j")) for s in sizes))
    segments = F.array(F.lit("all"), F.when(F.col("is_new"), "new").otherwise("second_hand"))
    recent = located.join(F.broadcast(register_end(sales))).withColumn("window", F.explode(F.array(*map(F.lit, windows))))
    recent = recent.filter(F.trunc("sale_date", "MM") > F.add_months("last_month", -F.col("window")))
    cells = recent.withColumn("c", F.explode(levels)).withColumn("segment", F.explode(segments))
    return group_stats(cells.select("c.*", "window", "segment", "cents"), ["size", "i", "j", "window", "segment"])
