"""Portfolio sales: several properties filed on one day at one price."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BIG_CENTS, LEAST_PROPERTIES, LEAST_SAME_LOCALITY, ROUND_CENTS = 500_000_000, 3, 3, 100_000


def bulk_groups(sales: DataFrame, big: int = BIG_CENTS, least: int = LEAST_PROPERTIES, same: int = LEAST_SAME_LOCALITY, whole: int = ROUND_CENTS) -> DataFrame:
    """(sale_id, group_id, group_size). ``sales``: sale_id, property_id, sale_date, cents, county, locality; withdrawn ones left out.

    Big prices group across counties from two properties on. Others group within a county from ``least`` properties on, if the price is no
    multiple of ``whole`` or ``same`` of the properties are in one locality. A property lies in one locality of one county, so properties are counted
    by day, price and locality once; counties and prices add those counts up within one shuffle by day and price, and only
    the few localities with a group meet the sales again.
    """
    price = ["sale_date", "cents"]
    places = sales.groupBy(*price, "county", "locality").agg(F.count_distinct("property_id").alias("n"), F.count("*").alias("k"))
    whole_price, county = W.partitionBy(*price), W.partitionBy(*price, "county")
    counted = places.select(*price, "county", "locality", *(f(c).over(w).alias(name) for f, c, w, name in ((F.sum, "n", whole_price, "n"), (F.sum, "k", whole_price, "k"), (F.sum, "n", county, "n_county"), (F.max, "n", county, "most"), (F.sum, "k", county, "k_county"))))
    large = (F.col("cents") > big) & (F.col("n") >= 2)
    local = (F.col("n_county") >= least) & ((F.col("cents") % whole != 0) | (F.col("most") >= same))
    scope = F.when(large, F.lit("*")).when(local, F.col("county"))
    groups = counted.select(F.col("sale_date").alias("_d"), F.col("cents").alias("_c"), F.col("county").alias("_p"), F.col("locality").alias("_l"), scope.alias("scope"), F.when(large, F.col("k")).otherwise(F.col("k_county")).alias("group_size")).filter("scope is not null")
    met = sales.join(groups, (F.col("sale_date") == F.col("_d")) & (F.col("cents") == F.col("_c")) & F.col("county").eqNullSafe(F.col("_p")) & F.col("locality").eqNullSafe(F.col("_l")))
    name = F.concat_ws("|", F.col("sale_date").cast("string"), F.col("cents").cast("string"), "scope")
    return met.select("sale_id", F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long").alias("group_id"), "group_size")
