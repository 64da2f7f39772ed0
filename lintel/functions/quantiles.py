"""Exact figures of groups: counts, quantiles and means of whole cents, withheld for groups too small to publish."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.sources.scratch import kept

LEAST = 5
QUANTILES = (0.25, 0.5, 0.75)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def group_stats(rows: DataFrame, keys: list[str], least: int = LEAST, value: str = "cents", wide: bool = False) -> DataFrame:
    """n, median, p25, p75 and mean of ``value`` by ``keys``; below ``least`` rows only n is given.

    Rows are first counted by key and value, with partial counts before the shuffle, so that what meets in a group is one row for each
    distinct value however many rows a hot key has; the quantiles then weigh each value by its count. ``wide``: a group may
    have more distinct values than a task should hold.
    """
    return counted_stats(rows.groupBy(*keys, value).agg(F.count("*").alias("k")), keys, least, value, wide)


def counted_stats(counted: DataFrame, keys: list[str], least: int = LEAST, value: str = "cents", wide: bool = False) -> DataFrame:
    """The same figures of values that come with their counts, k."""
    if wide:
        return figures(selected(counted, keys, QUANTILES, value), keys, least)
    stats = counted.groupBy(*keys).agg(F.sum("k").alias("n"), F.sum(F.col(value) * F.col("k")).alias("total"), F.expr(f"percentile({value}, array(0.25D, 0.5D, 0.75D), k)").alias("q"))
    return figures(stats, keys, least)


def window_stats(counted: DataFrame, keys: list[str], windows: Callable[[DataFrame], DataFrame], least: int = LEAST, value: str = "cents") -> DataFrame:
    """The same figures by ``keys`` and period, a window of months; see ``selected_windows``."""
    return figures(selected_windows(counted, keys, windows, QUANTILES, value), [*keys, "period"], least)


def figures(stats: DataFrame, keys: list[str], least: int) -> DataFrame:
    shown = lambda x: F.when(F.col("n") >= least, x)
    quantile = lambda i: shown(half_up(F.col("q")[i]))
    return stats.select(*keys, "n", quantile(1).alias("median"), quantile(0).alias("p25"), quantile(2).alias("p75"), shown(F.expr("(2 * total + n) div (2 * n)")).alias("mean"))


def range_of(value: Column) -> Column:
    """The least value of the range that a whole number lies in: single numbers up to 2^16, then 2^8, 2^16, ... numbers, so that there
    are at most 2^16 ranges for each factor of 2^8 and ranges of common prices hold at most 2^16 numbers."""
    width = F.lit(1 << 48).cast("long")
    for bits in range(40, -1, -8):
        width = F.when(F.abs(value) < F.lit(1 << bits + 16), F.lit(1 << bits).cast("long")).otherwise(width)
    return value - F.pmod(value, width)


def narrow_range_of(value: Column, bits: Column) -> Column:
    """The least value of the range that a whole number lies in, where each factor of 2 has 2^bits ranges of equal width."""
    size = F.greatest(F.abs(value), F.lit(1).cast("long"))
    # doubles tell whole numbers from powers of 2 up to 2^40 and beyond; larger ones are halved first
    power = F.when(size < 1 << 40, F.floor(F.log2(size))).otherwise(F.floor(F.log2(F.shiftright(size, 24))) + 24)
    return value - F.pmod(value, F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(power - bits, F.lit(0)).cast("int")))


def selected(counted: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUANTILES, value: str = "cents") -> DataFrame:
    """(keys, n, total, q) by distributed selection: ranges of values are counted first, and only the ranges that hold a wanted rank are looked into.

    No task holds the distinct values of a group: a group's ranges are summed in order, and so are the values of each range that
    holds a rank, both as sorted streams. Between two ranks, values are weighed as ``percentile`` does.
    """
    counted = counted.select(*keys, F.col(value).cast("long").alias("_v"), F.col("k").alias("_k")).withColumn("_range", range_of(F.col("_v")))
    return _picked(counted, _holding(counted.groupBy(*keys, "_range").agg(*_sums()), keys, quantiles), keys, quantiles)


#: Rows of a table that is broadcast: some 16 MB.
MOST_SENT = 200_000


def selected_windows(counted: DataFrame, keys: list[str], windows: Callable[[DataFrame], DataFrame], quantiles: tuple[float, ...] = QUANTILES, value: str = "cents") -> DataFrame:
    """(keys, period, n, total, q) by distributed selection in windows that overlap. ``counted`` has keys, a month m, values and their counts k (a value may come
    in several rows); ``windows`` copies rows to each window that holds their month, as period.

    Ranges of values are counted by month, and these counts are copied to the windows. Values are copied only where a window looks into their range:
    a group has ranges by the root of its size, so both grow slower than the values times the windows.
    """
    count = F.col("k").alias("_k")
    sizes = counted.groupBy(*keys).agg(F.sum("k").alias("_size"))
    bits = F.greatest(F.round((F.log2("_size") - 6) / 2), F.lit(1)).cast("int").alias("_bits")
    sizes = kept(sizes.select(*(F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)), bits), "sizes")
    rows = counted.select(*keys, "m", F.col(value).cast("long").alias("_v"), count)
    rows = rows.join(_sent(sizes), [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)]).withColumn("_range", narrow_range_of(F.col("_v"), F.col("_bits"))).select(*keys, "m", "_v", "_k", "_range")
    months = rows.groupBy(*keys, "m", "_range").agg(*_sums())
    # all months of a range lie in one partition, where the windows are summed without another shuffle
    ranges = windows(months.repartition(*keys, "_range")).groupBy(*keys, "period", "_range").agg(*(F.sum(c).alias(c) for c in ("_n", "_all", "_t")))
    wanted = kept(_holding(ranges, [*keys, "period"], quantiles), "wanted")
    asked = kept(wanted.select(*(f"_g{i}" for i in range(len(keys))), "_range").distinct(), "asked")
    same = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    met = rows.withColumnRenamed("_range", "_own").join(_sent(asked), [*same, F.col("_own").eqNullSafe(F.col("_range"))], "left_semi").withColumnRenamed("_own", "_range")
    return _picked(windows(met), wanted, [*keys, "period"], quantiles)


def _sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= MOST_SENT else table


def _sums() -> list[Column]:
    """Of a range: how many values, how many rows (a value may be missing), and their total."""
    return [F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_k"))), F.lit(0)).alias("_n"), F.sum("_k").alias("_all"), F.sum(F.col("_v") * F.col("_k")).alias("_t")]


def _ranks(quantiles: tuple[float, ...]) -> tuple[list[Column], list[Column]]:
    """Places of quantiles among a group's values, and the ranks below and above each."""
    place = [(F.col("_values") - 1) * F.lit(q) for q in quantiles]
    return place, [edge(p).cast("long") for p in place for edge in (F.floor, F.ceil)]


def _holds(n: str, ranks: list[Column]) -> Column:
    return reduce(Column.__or__, ((F.col("_before") <= r) & (r < F.col("_before") + F.col(n)) for r in ranks))


def _holding(ranges: DataFrame, keys: list[str], quantiles: tuple[float, ...]) -> DataFrame:
    """Of each group's ranges those that hold a rank, and that of missing values, with what comes before them. Keys are renamed to _g0, _g1..."""
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before")
    ranges = ranges.select(*keys, "_range", "_n", before, F.sum("_n").over(whole).alias("_values"), F.sum("_all").over(whole).alias("n"), F.sum("_t").over(whole).alias("total"))
    return ranges.filter(_holds("_n", _ranks(quantiles)[1]) | F.col("_range").isNull()).withColumnsRenamed({k: f"_g{i}" for i, k in enumerate(keys)}).drop("_n")


def _picked(counted: DataFrame, ranges: DataFrame, keys: list[str], quantiles: tuple[float, ...]) -> DataFrame:
    """The values at the ranks, from the rows of the ranges that hold them."""
    place, ranks = _ranks(quantiles)
    same = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    met = counted.withColumnRenamed("_range", "_own").join(ranges, [*same, F.col("_own").eqNullSafe(F.col("_range"))]).drop("_own")
    inner = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_k").over(inner), F.lit(0))).filter(_holds("_k", ranks) | F.col("_v").isNull())
    at = lambda r: F.max(F.when((F.col("_before") <= r) & (r < F.col("_before") + F.col("_k")), F.col("_v")))  # noqa: E731  one row has the rank
    found = met.groupBy(*keys, "n", "_values", "total").agg(*(at(r).alias(f"_r{i}") for i, r in enumerate(ranks)))
    between = lambda i: F.when(ranks[2 * i] == ranks[2 * i + 1], F.col(f"_r{2 * i}").cast("double")).otherwise((ranks[2 * i + 1] - place[i]) * F.col(f"_r{2 * i}") + (place[i] - ranks[2 * i]) * F.col(f"_r{2 * i + 1}"))
    return found.select(*keys, "n", "total", F.array(*map(between, range(len(quantiles)))).alias("q"))


def stats_sql(least: int = LEAST, value: str = "cents") -> str:
    """The same columns as a SELECT list for DuckDB."""
    shown = lambda x, name: f"CASE WHEN count(*) >= {least} THEN {x} END AS {name}"
    quantile = lambda p, name: shown(f"CAST(floor(quantile_cont({value}, {p}) + 0.5) AS BIGINT)", name)
    mean = shown(f"CAST((2 * sum({value}) + count(*)) // (2 * count(*)) AS BIGINT)", "mean")
    return ", ".join(["count(*) AS n", quantile(0.5, "median"), quantile(0.25, "p25"), quantile(0.75, "p75"), mean])
