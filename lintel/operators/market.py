"""Which sales count as market sales, and the fan-out of a sale to its areas and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintel.functions.quantiles import narrow_range_of

#: A property's areas below the country, and those of them that get months and rolling windows.
AREA_KEYS = ("county_id", "settlement_id", "ed_id", "small_area_id", "townland_id")
DETAILED = ("county_id", "settlement_id", "ed_id")


def is_market() -> Column:
    """Not withdrawn, at full market price, in no bulk group and no possible duplicate."""
    return ~F.col("withdrawn") & ~F.col("not_full_market") & F.col("bulk_group_id").isNull() & ~F.col("possible_duplicate")


def is_plain() -> Column:
    """A market sale whose price holds the tax."""
    return is_market() & ~F.col("vat_exclusive")


def fan_out(sales: DataFrame, properties: DataFrame) -> DataFrame:
    """Each market sale once for each of its areas, of six kinds, and segments: overlapping groups that grouping sets can't say.

    ``detail`` says whether an area's kind gets months and rolling windows: small areas and townlands have too few sales for them.
    Properties that are not placed precisely lie in no division, small area or townland.
    """
    located = sales.filter(is_market()).join(properties.select("property_id", *AREA_KEYS), "property_id")
    area = lambda c, detail: F.when(c.isNotNull(), F.struct(c.alias("area_id"), F.lit(detail).alias("detail")))
    areas = F.array_compact(F.array(area(F.lit(0).cast("long"), True), *(area(F.col(c), c in DETAILED) for c in AREA_KEYS)))
    segments = F.array(F.lit("all"), F.when(F.col("is_new"), "new").otherwise("second_hand"))
    return located.withColumn("a", F.explode(areas)).withColumn("segment", F.explode(segments)).select("*", "a.*").drop("a", *AREA_KEYS)


def monthly_counts(sales: DataFrame, properties: DataFrame) -> DataFrame:
    """(area_id, segment, m, cents, c): how many market sales an area with months has in a month at a price.

    Sales are counted by their own areas, month and price before the counts go to areas and segments: what is fanned out are counts, not rows.
    """
    return spread_counts(own_counts(sales, properties)).groupBy("area_id", "segment", "m", "cents").agg(F.sum("c").alias("c"))


def own_counts(sales: DataFrame, properties: DataFrame) -> DataFrame:
    """(county_id, settlement_id, ed_id, is_new, m, cents, c): how many market sales there are in a month at a price, by the areas they lie in.

    Like prices of a month lie together, so that tasks that count them by area, month and range of prices meet the same few ranges again and again.
    """
    located = sales.filter(is_market()).join(properties.select("property_id", *DETAILED), "property_id")
    rows = located.select(*DETAILED, "is_new", F.trunc("sale_date", "MM").alias("m"), narrow_range_of(F.col("cents"), F.lit(6)).alias("like"), "cents")
    return rows.repartition("m", "like").groupBy(*DETAILED, "is_new", "m", "like", "cents").agg(F.count("*").alias("c")).drop("like")


def spread_counts(own: DataFrame) -> DataFrame:
    """(area_id, segment, m, cents, c): each row of ``own_counts`` for each of its areas and segments; equal prices of an area stay apart."""
    areas = F.array_compact(F.array(F.lit(0).cast("long"), *DETAILED))
    segments = F.array(F.lit("all"), F.when(F.col("is_new"), "new").otherwise("second_hand"))
    return own.withColumn("area_id", F.explode(areas)).withColumn("segment", F.explode(segments)).select("area_id", "segment", "m", "cents", "c")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by ``order`` (which must decide ties), as an aggregate with partial maxima and no sort of the group."""
    rest = [c for c in rows.columns if c != key]
    ranked = F.struct(*order, *(c for c in rest if c not in order))
    return rows.groupBy(key).agg(F.max(ranked).alias("x")).select(key, *(F.col(f"x.{c}").alias(c) for c in rest))


def previous_plain(sales: DataFrame) -> DataFrame:
    """Adds prev_date, prev_cents, prev_sale_id: of a plain sale, the latest plain sale of the property on an earlier day."""
    day = F.datediff("sale_date", F.lit("1970-01-01").cast("date"))
    w = W.partitionBy("property_id").orderBy(day).rangeBetween(W.unboundedPreceding, -1)
    before = F.max(F.when(is_plain(), F.struct("sale_date", "sale_id", "cents"))).over(w)
    out = sales.withColumn("before", F.when(is_plain(), before))
    return out.select("*", F.col("before.sale_date").alias("prev_date"), F.col("before.cents").alias("prev_cents"), F.col("before.sale_id").alias("prev_sale_id")).drop("before")


def previous_where(rows: DataFrame, sales: DataFrame, condition: Column) -> DataFrame:
    """``rows`` (sale_id, property_id, sale_date, …) with prev_date and prev_cents: the latest plain sale of the property on an earlier day, looked up only for
    rows that meet ``condition``. The condition is part of the join, so that other rows stay without meeting any sale."""
    plain = sales.filter(is_plain()).select(F.col("property_id").alias("_p"), F.col("sale_date").alias("_d"), F.col("sale_id").alias("_s"), F.col("cents").alias("_c"))
    met = rows.join(plain, condition & (F.col("property_id") == F.col("_p")) & (F.col("_d") < F.col("sale_date")), "left")
    best = met.groupBy(*rows.columns).agg(F.max(F.when(F.col("_d").isNotNull(), F.struct("_d", "_s", "_c"))).alias("_b"))
    return best.select(*rows.columns, F.col("_b._d").alias("prev_date"), F.col("_b._c").alias("prev_cents"))


def listed_change(sales: DataFrame) -> DataFrame:
    """Adds older_cents: the price of the row just below in a property's list, newest first, if both rows are plain."""
    w = W.partitionBy("property_id").orderBy(F.desc("sale_date"), F.desc("sale_id"))
    older = F.lead(F.struct(is_plain().alias("plain"), "cents")).over(w)
    return sales.withColumn("older", older).withColumn("older_cents", F.when(is_plain() & F.col("older.plain"), F.col("older.cents"))).drop("older")


def change_permille(now: Column, before: Column) -> Column:
    """Tenths of a percent, half up, as a whole number: no rounding of doubles at ties."""
    top, low = (now - before) * 2000 + before, before * 2
    return F.when(before != 0, ((top - F.pmod(top, low)) / low).cast("long"))


def change_sql(now: str, before: str) -> str:
    top, low = f"(({now} - {before}) * 2000 + {before})", f"({before} * 2)"
    return f"CASE WHEN {before} <> 0 THEN CAST(({top} - ({top} % {low} + {low}) % {low}) // {low} AS BIGINT) END"
