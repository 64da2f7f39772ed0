"""Domain frames over the star-schema test tables: sales, properties, areas, places of interest and a price index.

A stand-in for a register: each order is a sale, each customer a property, nations and regions are its areas. Flags
and positions are fixed functions of the keys, so that SQL can state the same rows (``lintel.plans.views``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STREETS = ("Main St", "Church Rd.", "Mill  Ave", "Abbey Tce", "St. Brígid's Pk", "Bridge St Lower", "Tullow Rd")
PRECISIONS = ("exact", "street", "locality", "routing_key", "county", "unmatched")
POI_KINDS = ("stop", "rail", "primary", "post_primary")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: Column | str) -> Column:
    """Money as whole cents: sums and medians of them are exact."""
    return F.floor(F.col(amount) * 100 + 0.5 if isinstance(amount, str) else amount * 100 + 0.5).cast("long")


def _spread(key: Column, factor: int, size: int, start: float) -> Column:
    return ((key * factor) % size).cast("double") / 10000 + start


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        key.alias("sale_id"),
        F.col("o_custkey").alias("property_id"),
        F.col("o_orderdate").cast("date").alias("sale_date"),
        cents("o_totalprice").alias("cents"),
        (F.col("o_orderstatus") == "P").alias("not_full_market"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_new"),
        (F.col("o_orderpriority") == "5-LOW").alias("vat_exclusive"),
        F.when(key % 53 == 11, F.expr("o_orderkey div 53")).alias("bulk_group_id"),
        (key % 101 == 13).alias("possible_duplicate"),
        (key % 89 == 7).alias("withdrawn"),
    )


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas are two tables of fixed size (nations and regions); the rest is computed from the key."""
    places = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("c_custkey")
    text = lambda c: c.cast("string")
    street = F.element_at(F.array(*map(F.lit, STREETS)), (key * 13 % len(STREETS) + 1).cast("int"))
    precise, nation = key * 7 % 6 <= 1, F.col("n_nationkey").cast("long")
    division = nation * 8 + key * 5 % 8
    unit = F.when(key % 9 == 4, F.concat(F.lit("Apt "), text(key % 7 + 1), F.lit(", "))).otherwise("")
    return read(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("property_id"),
        (F.col("n_regionkey").cast("long") + 1).alias("county_id"),
        (F.col("n_nationkey").cast("long") + 100).alias("settlement_id"),
        F.when(precise, division + 1000).alias("ed_id"),
        F.when(precise, division * 4 + key % 4 + 10_000).alias("small_area_id"),
        F.when(precise & (key % 5 != 0), nation * 16 + key * 3 % 16 + 100_000).alias("townland_id"),
        F.lower("r_name").alias("county"),
        (key * 7 % 6).cast("int").alias("precision"),
        _spread(key, 7919, 40000, -10).alias("lon"),
        _spread(key, 104729, 38000, 51.5).alias("lat"),
        (key % 83 == 5).alias("suppressed"),
        F.concat(F.substring(F.lit("ACDEFHKNPR"), (key % 10 + 1).cast("int"), 1), F.lpad(text(key % 23 + 1), 2, "0")).alias("routing_key"),
        F.concat(unit, text(key % 60 + 1), F.lit(" "), street, F.lit(", "), F.col("n_name"), F.lit(", Co. "), F.col("r_name")).alias("address"),
    )


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(area_id, kind, name, parent_id): one country, its counties and their settlements."""
    country = spark.range(1).select(F.lit(0).cast("long").alias("area_id"), F.lit("country").alias("kind"), F.lit("country").alias("name"), F.lit(None).cast("long").alias("parent_id"))
    counties = read(spark, sf_dir, "region").select((F.col("r_regionkey").cast("long") + 1).alias("area_id"), F.lit("county").alias("kind"), F.lower("r_name").alias("name"), F.lit(0).cast("long").alias("parent_id"))
    settlements = read(spark, sf_dir, "nation").select((F.col("n_nationkey").cast("long") + 100).alias("area_id"), F.lit("settlement").alias("kind"), F.lower("n_name").alias("name"), (F.col("n_regionkey").cast("long") + 1).alias("parent_id"))
    return country.unionByName(counties).unionByName(settlements)


def fine_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Electoral divisions and townlands of a county, small areas of a division: only precisely placed properties lie in them."""
    nation, county = F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long") + 1
    nations = read(spark, sf_dir, "nation").select(nation.alias("k"), county.alias("county"))
    row = lambda df, start, n, kind, name, parent: df.select((F.col("k") * n + F.col("i") + start).alias("area_id"), F.lit(kind).alias("kind"), F.concat(F.lit(f"{name} "), (F.col("k") * n + F.col("i")).cast("string")).alias("name"), parent.cast("long").alias("parent_id"))
    spread = lambda n: nations.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    divisions = row(spread(8), 1000, 8, "electoral_division", "division", F.col("county"))
    small = row(spread(32), 10_000, 32, "small_area", "small area", F.expr("1000 + (k * 32 + i) div 4"))
    return divisions.unionByName(small).unionByName(row(spread(16), 100_000, 16, "townland", "townland", F.col("county")))


def all_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six kinds."""
    return areas(spark, sf_dir).unionByName(fine_areas(spark, sf_dir))


def places_of_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, POI_KINDS)), (key % 4 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select(key.alias("poi_id"), kind.alias("kind"), _spread(key, 3571, 40000, -10).alias("lon"), _spread(key, 7121, 38000, 51.5).alias("lat"))


def price_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, period, value): a month's mean line price by region, in whole cents. Lines of a supplier meet its region by key."""
    suppliers = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("period"), cents("l_extendedprice").alias("cents"))
    return lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("n_regionkey").alias("series"), "period").agg(F.expr("sum(cents) div count(*)").alias("value"))


def register_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_no and nine text fields as a register's file holds them; some are bad, and every 50th row is filed twice."""
    sale, places = sales(spark, sf_dir), properties(spark, sf_dir)
    euros, rest = F.expr("cents div 100"), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    key = F.col("sale_id")
    yes = lambda c: F.when(F.col(c), "Yes").otherwise("No")
    rows = sale.join(places, "property_id").select(
        (key + 2).alias("line_no"),
        F.when(key % 211 == 0, "31/02/2020").otherwise(F.date_format("sale_date", "dd/MM/yyyy")).alias("raw_date"),
        F.col("address").alias("raw_address"),
        F.when(key % 223 == 0, "Antrim").otherwise(F.upper("county")).alias("raw_county"),
        F.when(key % 5 == 0, "").otherwise(F.concat("routing_key", F.lit(" "), F.lpad((key % 9999).cast("string"), 4, "0"))).alias("raw_eircode"),
        F.when(key % 227 == 0, "100000").otherwise(F.concat(F.lit("€"), F.format_number(euros, 0), F.lit("."), rest)).alias("raw_price"),
        yes("not_full_market").alias("raw_nfmp"),
        F.when(key % 229 == 0, "Perhaps").otherwise(yes("vat_exclusive")).alias("raw_vat"),
        F.when(key % 233 == 0, "Castle").when(F.col("is_new"), F.when(key % 2 == 0, "New Dwelling house /Apartment").otherwise("Teach/Árasán Cónaithe Nua")).otherwise("Second-Hand Dwelling house /Apartment").alias("raw_description"),
        F.when(key % 239 == 0, "huge").when(key % 4 == 0, "less than 38 sq metres").when(key % 4 == 1, "greater than or equal to 38 sq metres and less than 125 sq metres").when(key % 4 == 2, "greater than 125 sq metres").otherwise("").alias("raw_size"),
    )
    again = F.array(F.lit(0), F.when((F.col("line_no") - 2) % 50 == 0, 10_000_000))
    return rows.withColumn("more", F.explode(F.array_compact(again))).withColumn("line_no", F.col("line_no") + F.col("more")).drop("more")


def sales_by_place(spark: SparkSession, sf_dir: str, bucket: int = 2_500_000) -> DataFrame:
    """Sales with county and locality; prices rounded down to a bucket (no two orders share day and exact price)."""
    places = properties(spark, sf_dir).select("property_id", "county", F.element_at(F.split(F.lower("address"), ", "), -2).alias("locality"))
    held = sales(spark, sf_dir).filter("not withdrawn").withColumn("cents", F.col("cents") - F.col("cents") % bucket)
    return held.join(places, "property_id").select("sale_id", "property_id", "sale_date", "cents", "county", "locality")
