"""Taxes and loans: dated tax rates, duty in bands, borrowing limits and repayments."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The dated rates, duty bands (up to, rate) and lending limits in force.
VAT_RATES = ((date(2003, 1, 1), None, "any", "0.135"), (date(2025, 10, 8), date(2030, 12, 31), "qualifying_apartment", "0.09"))
DUTY_BANDS = ((1_000_000, "0.01"), (1_500_000, "0.02"), (None, "0.06"))
INCOME_LIMIT = {"first_time_buyer": "4.0", "second_and_subsequent": "3.5", "buy_to_let": None}
VALUE_LIMIT = {"first_time_buyer": "0.90", "second_and_subsequent": "0.90", "buy_to_let": "0.70"}
#: Upper bounds of the price bands of a map.
PRICE_BANDS = (200_000, 350_000, 500_000)


def vat_table(spark: SparkSession) -> DataFrame:
    """(applies_from, applies_to, dwelling, rate): as many rows as there were rates."""
    rows = [F.struct(F.lit(a).alias("applies_from"), F.lit(b).cast("date").alias("applies_to"), F.lit(d).alias("dwelling"), F.lit(r).cast("decimal(5,4)").alias("rate")) for a, b, d, r in VAT_RATES]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


class RatesError(ValueError):
    """The file of rates is not what it should be: better no rate than a wrong one."""


DWELLINGS = ("any", "qualifying_apartment")


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """The table of rates from a file with a JSON object a line: applies_from, applies_to (null if open), dwelling and rate, and nothing else.

    A line with other fields, a day or rate that can't be read, an unknown dwelling, a rate outside 0 to 1, a range that ends before it begins, or a
    file without a general rate is an error that names the line.
    """
    names = ("applies_from", "applies_to", "dwelling", "rate")
    of = lambda c: F.get_json_object("value", f"$.{c}")
    rows = spark.read.text(path).filter("trim(value) <> ''")
    rows = rows.select("value", F.json_object_keys("value").alias("keys"), of("applies_from").try_cast("date").alias("applies_from"), of("applies_to").alias("to"), of("applies_to").try_cast("date").alias("applies_to"), of("dwelling").alias("dwelling"), of("rate").try_cast("decimal(5,4)").alias("rate"))
    known = F.coalesce(F.size(F.array_except("keys", F.array(*map(F.lit, names)))) == 0, F.lit(False)) & F.arrays_overlap("keys", F.array(F.lit("rate")))
    fits = F.col("applies_from").isNotNull() & (F.col("to").isNull() | (F.col("applies_to") >= F.col("applies_from"))) & F.col("dwelling").isin(*DWELLINGS) & F.col("rate").between(0, 1)
    bad = rows.filter(~(known & F.coalesce(fits, F.lit(False)))).select("value").first()
    if bad:
        raise RatesError(f"not a rate: {bad['value']}")
    if rows.filter("dwelling = 'any'").isEmpty():
        raise RatesError("no general rate")
    return rows.select(*names)


def with_vat_rate(sales: DataFrame, spark: SparkSession, rates: DataFrame | None = None) -> DataFrame:
    """Adds rate: that of the sale's day and dwelling; the dwelling's own before the general one, the latest if several apply. Needs row_id, sale_date,
    dwelling. ``rates``: those of ``read_rates``, else the ones in force here. They are a handful of rows by law, so they are sent to all."""
    live = (F.col("applies_from") <= F.col("sale_date")) & (F.col("applies_to").isNull() | (F.col("sale_date") <= F.col("applies_to")))
    rates = F.broadcast((vat_table(spark) if rates is None else rates).withColumnRenamed("dwelling", "for_dwelling"))
    met = sales.join(rates, live & F.col("for_dwelling").isin("any") | live & (F.col("for_dwelling") == F.col("dwelling")), "left")
    best = met.groupBy(*sales.columns).agg(F.max(F.struct((F.col("for_dwelling") != "any").alias("special"), "applies_from", "rate")).alias("b"))
    return best.select(*sales.columns, F.col("b.rate").alias("rate"))


def with_tax(cents: Column, rate: Column) -> Column:
    """The price with tax, half up to the cent."""
    return F.round(cents.cast("decimal(20,4)") * (rate + F.lit(1).cast("decimal(5,4)")), 0).cast("long")


def without_tax(cents: Column, rate: Column) -> Column:
    """The price without tax, cut off at the cent: whole numbers, so that nothing is rounded up."""
    per_10000 = (F.lit(1).cast("decimal(5,4)") + rate) * 10_000
    return F.floor((cents.cast("decimal(20,0)") * 10_000) / per_10000).cast("long")


def duty(cents: Column) -> Column:
    """Duty in cents, half up: each rate on its own slice of the price."""
    low, total = 0, F.lit(0).cast("decimal(24,4)")
    for top, rate in DUTY_BANDS:
        reached = cents if top is None else F.least(cents, F.lit(top * 100))
        total = total + F.greatest(reached - low * 100, F.lit(0)).cast("decimal(18,0)") * F.lit(rate).cast("decimal(5,4)")
        low = top or low
    return F.round(total, 0).cast("long")


def duty_sql(cents: str) -> str:
    low, parts = 0, []
    for top, rate in DUTY_BANDS:
        reached = cents if top is None else f"least({cents}, {top * 100})"
        parts.append(f"greatest({reached} - {low * 100}, 0) * {round(float(rate) * 100)}")
        low = top or low
    return f"(({' + '.join(parts)}) + 50) // 100"


def affordability(income: Column, deposit: Column, buyer: str) -> tuple[Column, Column]:
    """(highest price in whole units, what limits it): the lower of income limit plus deposit and deposit over the part that can't be lent."""
    own_share = F.lit(1).cast("decimal(6,4)") - F.lit(VALUE_LIMIT[buyer]).cast("decimal(6,4)")
    by_deposit = F.floor(deposit.cast("decimal(18,2)") / own_share).cast("long")
    if INCOME_LIMIT[buyer] is None:
        return by_deposit, F.lit("deposit")
    by_income = F.floor(income.cast("decimal(18,2)") * F.lit(INCOME_LIMIT[buyer]).cast("decimal(6,2)")).cast("long") + deposit
    return F.least(by_income, by_deposit), F.when(by_income < by_deposit, "income").otherwise("deposit")


def repayment(loan: Column, percent: Column, years: Column) -> Column:
    """Monthly payment of an annuity loan, rounded to the cent."""
    r, n = percent / 1200, years * 12
    return F.when(loan <= 0, 0.0).when(r == 0, F.round(loan / n, 2)).otherwise(F.round(loan * r / (1 - F.pow(1 + r, -n)), 2))


def price_band(price: Column) -> Column:
    """0 to 3: the step of the map's colours."""
    return sum((price >= b).cast("int") for b in PRICE_BANDS)
