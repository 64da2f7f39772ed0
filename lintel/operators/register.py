"""Register rows: typed parsing with quarantine, repeats, staging, and the merge of a new file into what is held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintel.functions import text as T
from lintel.sources.scratch import kept

RAW = ("raw_date", "raw_address", "raw_county", "raw_eircode", "raw_price", "raw_nfmp", "raw_vat", "raw_description", "raw_size")
SEPARATOR = "\u001f"
LEAST_SHARE = 0.9


def is_new(description: Column) -> Column:
    """English and Irish descriptions, wrongly decoded ones too; null where unknown."""
    t = F.lower(F.trim(description))
    used = t.contains("second-hand") | t.contains("athláimhe") | t.contains("atháimhe")
    return F.when(used, False).when(t.startswith("new ") | t.endswith(" nua"), True)


def size_band(size: Column) -> Column:
    """The official size band; empty for a blank, null where unknown. The order of the tests matters."""
    t = F.trim(size)
    return F.when(t == "", "").when(t.contains("38") & t.contains("125"), "38_to_125").when(t.contains("125"), "gte_125").when(t.contains("38"), "lt_38")


def parse(rows: DataFrame, counties: tuple[str, ...]) -> DataFrame:
    """Adds the typed fields and ``error``: null for a good row, else what is wrong first. ``rows``: line_no and the nine raw fields."""
    flag = lambda c: F.when(F.trim(c) == "Yes", True).when(F.trim(c) == "No", False)
    price = F.regexp_extract(F.trim("raw_price"), r"^€([0-9,]+\.[0-9]{2})$", 1)
    typed = rows.withColumns(
        {
            "sale_date": F.when(F.trim("raw_date").rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.try_to_date(F.trim("raw_date"), "d/M/yyyy")),
            "county": F.when(F.lower(F.trim("raw_county")).isin(*counties), F.lower(F.trim("raw_county"))),
            "cents": F.when(price != "", F.regexp_replace(price, "[,.]", "")).try_cast("long"),
            "not_full_market": flag("raw_nfmp"),
            "vat_exclusive": flag("raw_vat"),
            "is_new": is_new(F.col("raw_description")),
            "size_band": size_band(F.col("raw_size")),
        }
    )
    error = (
        F.when(F.col("sale_date").isNull(), "bad date")
        .when(F.col("county").isNull(), "unknown county")
        .when(F.col("cents").isNull(), "bad price")
        .when(F.col("not_full_market").isNull() | F.col("vat_exclusive").isNull(), "bad flag")
        .when(F.col("is_new").isNull(), "unknown description")
        .when(F.col("size_band").isNull(), "unknown size")
    )
    return typed.withColumn("error", error).withColumn("size_band", F.nullif("size_band", F.lit("")))


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.filter("error is not null").select("line_no", F.concat_ws(",", *RAW).alias("raw_line"), "error")


def with_repeats(parsed: DataFrame) -> DataFrame:
    """Good rows with row_hash (of the row and of how often it occurred before) and possible_duplicate (an earlier row is the same sale).

    Both windows share one exchange: equal rows are equal sales, so rows dealt by sale lie right for either.
    """
    good = parsed.filter("error is null")
    canon = [F.coalesce(T.squeeze(F.col(c)), F.lit("")) for c in RAW]
    rows = good.withColumn("_canon", F.concat_ws(SEPARATOR, *canon)).withColumn("_sale", F.sha2(F.concat_ws(SEPARATOR, canon[0], F.lower(canon[1]), canon[4]), 256))
    before = F.row_number().over(W.partitionBy("_sale", "_canon").orderBy("line_no")) - 1
    repeated = F.row_number().over(W.partitionBy("_sale").orderBy("line_no")) > 1
    rows = rows.withColumn("possible_duplicate", repeated).withColumn("occurrence", before)
    return rows.withColumn("row_hash", F.sha2(F.concat_ws(SEPARATOR, "_canon", F.col("occurrence").cast("string")), 256)).drop("_canon", "_sale")


def _addressed(rows: DataFrame, counties: tuple[str, ...]) -> DataFrame:
    """Adds what follows from raw_address and county alone: display, normalised, unit, house_number, _key, _vague (names no dwelling) and _city (the postal district that
    the address names). The expanded parts are worked out once, as a column."""
    raw, county, found = F.col("raw_address"), F.col("county"), F.col("_found")
    rows = rows.withColumn("_found", T.expanded(raw, counties))
    rows = rows.withColumns({"display": T.display(raw), "normalised": F.array_join(found, ", "), "unit": T.unit_of(found), "_rest": T.without_county(T.without_unit(found), county)})
    rows = rows.withColumns({"house_number": T.house_number(F.col("_rest")), "_key": T.key_of(F.col("_rest")), "_city": T.city_district(F.col("normalised"), county)})
    vague = (F.col("_key") == "") | (F.col("house_number").isNull() & F.col("unit").isNull())
    return rows.withColumn("_vague", F.coalesce(vague, F.lit(False))).drop("_found", "_rest")


def _marked() -> Column:
    """The key of an address without house number and unit, which names no dwelling: it gets the sale's own mark, so that only repeat filings of one sale share it."""
    mark = F.substring(F.sha2(F.concat_ws("|", T.squeeze(F.col("raw_date")), F.lower(T.squeeze(F.col("raw_address"))), T.squeeze(F.col("raw_price"))), 256), 1, 12)
    return F.concat_ws("~", "_key", mark)


def _district_by(code: Column) -> Column:
    return F.when(F.col("county") == "dublin", T.district_of_eircode(code))


def stage(rows: DataFrame, counties: tuple[str, ...]) -> DataFrame:
    """Adds display, normalised, key, unit, house_number, district, eircode and public_id."""
    rows = _addressed(rows, counties).withColumn("eircode", T.eircode(F.col("raw_eircode")))
    rows = rows.withColumn("key", F.when(F.col("_vague"), _marked()).otherwise(F.col("_key")))
    rows = rows.withColumn("district", F.coalesce("_city", _district_by(F.col("eircode"))))
    return rows.withColumn("public_id", T.public_id(F.col("county"), F.col("key"), F.col("unit"))).drop("_key", "_city", "_vague")


def _known(order: Column, value: Column) -> Column:
    """A value with its place in the order, null where there is none: the largest one is the latest known value."""
    return F.when(value.isNotNull(), F.struct(order.alias("at"), value.alias("is")))


def _latest(filed: DataFrame) -> DataFrame:
    """One row a property of rows with _order, the texts, and the known _district and _eircode. The identifier follows from the group, so it is worked out once."""
    texts = F.struct("display", "normalised", "house_number")
    found = filed.groupBy("county", "key", "unit").agg(F.max_by(texts, "_order").alias("_texts"), F.max("_district").alias("_district"), F.max("_eircode").alias("_eircode"))
    found = found.select("county", "key", "unit", "_texts.*", F.col("_district.is").alias("district"), F.col("_eircode.is").alias("eircode"))
    return found.withColumn("public_id", T.public_id(F.col("county"), F.col("key"), F.col("unit")))


def properties_of(staged: DataFrame) -> DataFrame:
    """One row a property (county, key, unit): display fields of the latest sale, the latest known eircode and district."""
    order = F.struct("sale_date", "line_no")
    return _latest(staged.withColumns({"_order": order, "_district": _known(order, F.col("district")), "_eircode": _known(order, F.col("eircode"))}))


def properties_filed(parsed: DataFrame, counties: tuple[str, ...]) -> DataFrame:
    """``properties_of`` of what ``stage`` makes of good rows, with the text of each address worked out once, after its sales were put together.

    Sales at addresses that name no dwelling are properties of their own: their rows are read again and meet the texts of their addresses.
    """
    order, code = F.struct("sale_date", "line_no"), T.eircode(F.col("raw_eircode"))
    # a filter on what parsing finds would be moved below it and parse every row twice
    rows = kept(parsed.select("error", "sale_date", "line_no", "county", "raw_address", "raw_eircode", "raw_date", "raw_price"), "parsed").filter("error is null")
    rows = rows.select("raw_address", "county", "raw_date", "raw_price", order.alias("_order"), _known(order, code).alias("_eircode"), _known(order, _district_by(code)).alias("_by_code"))
    latest = [F.max(c).alias(c) for c in ("_order", "_eircode", "_by_code")]
    texts = kept(_addressed(rows.groupBy("raw_address", "county").agg(*latest), counties), "addresses")
    # a table of its own, so that Spark knows how small it is
    vague = kept(texts.filter("_vague").drop("_order", "_eircode", "_by_code").withColumnsRenamed({"raw_address": "_raw", "county": "_in"}), "vague")
    single = rows.join(vague, F.col("raw_address").eqNullSafe(F.col("_raw")) & F.col("county").eqNullSafe(F.col("_in")))
    shape = lambda df, key: df.select("county", key.alias("key"), "unit", "display", "normalised", "house_number", "_order", F.coalesce(_known(F.col("_order"), F.col("_city")), "_by_code").alias("_district"), "_eircode")
    return _latest(shape(texts.filter("not _vague"), F.col("_key")).unionByName(shape(single, _marked())))


def upserted(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``held`` with ``new`` merged in by ``keys`` (null keys are equal), and ``action``: kept, inserted, updated or unchanged."""
    values = [c for c in held.columns if c not in keys]
    a, b = held.withColumn("_held", F.lit(True)), new.select(*keys, *values).withColumn("_new", F.lit(True))
    met = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    differ = ~F.struct(*(F.col(f"a.{v}") for v in values)).eqNullSafe(F.struct(*(F.col(f"b.{v}") for v in values)))
    action = F.when(F.col("_new").isNull(), "kept").when(F.col("_held").isNull(), "inserted").when(differ, "updated").otherwise("unchanged")
    pick = lambda c: F.when(F.col("_new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return met.select(*map(pick, held.columns), action.alias("action"))


def refiled(held: DataFrame, file: DataFrame, run: int) -> DataFrame:
    """Held sales after a full file: seen again (and no longer withdrawn), withdrawn since this run, or new. Both: row_hash, …; held also
    first_seen, last_seen, withdrawn_in."""
    met = held.alias("h").join(file.select("row_hash").distinct().withColumn("_in", F.lit(True)).alias("f"), "row_hash", "full")
    return met.select(
        "row_hash",
        F.coalesce("first_seen", F.lit(run)).alias("first_seen"),
        F.when(F.col("_in"), F.lit(run)).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(F.col("_in"), F.lit(None).cast("int")).otherwise(F.coalesce("withdrawn_in", F.lit(run))).alias("withdrawn_in"),
    )


def enough_rows(active: int, loaded: int) -> None:
    """A file far smaller than what is active is refused: it is cut off, not a mass withdrawal."""
    if active and loaded < LEAST_SHARE * active:
        raise ValueError(f"file has {loaded} rows but {active} sales are active; refusing to withdraw")


def moved(held: DataFrame, staged: DataFrame) -> DataFrame:
    """(row_hash, sale_date, old_id, new_id): held sales whose address now keys to another property."""
    now = staged.select("row_hash", F.col("public_id").alias("new_id"))
    return held.join(now, "row_hash").filter("public_id <> new_id").select("row_hash", "sale_date", F.col("public_id").alias("old_id"), "new_id")


def retired(held: DataFrame, moves: DataFrame, staged: DataFrame) -> DataFrame:
    """(old_id, new_id, inherits): properties left without sales go into the one that took their latest sale; it inherits their place
    if it holds no other sales than theirs."""
    after = held.join(moves.select("row_hash", "new_id"), "row_hash", "left").select(F.coalesce("new_id", "public_id").alias("at"), F.when(F.col("new_id").isNotNull(), F.col("public_id")).alias("was"))
    emptied = moves.join(after.select(F.col("at").alias("old_id")).distinct(), "old_id", "left_anti")
    into = emptied.groupBy("old_id").agg(F.max_by("new_id", F.struct("sale_date", "row_hash")).alias("new_id"))
    fresh = staged.select(F.col("public_id").alias("at"), "row_hash").join(held.select("row_hash"), "row_hash", "left_anti").select("at", F.lit(None).cast("string").alias("was"))
    origins = after.unionByName(fresh).groupBy("at").agg(F.count_distinct(F.coalesce("was", F.lit(""))).alias("origins"), F.min(F.coalesce("was", F.lit(""))).alias("origin"))
    met = into.join(origins, F.col("new_id") == F.col("at"))
    return met.select("old_id", "new_id", ((F.col("origins") == 1) & (F.col("origin") == F.col("old_id"))).alias("inherits"))


def hidden_after(properties: DataFrame, moves: DataFrame) -> DataFrame:
    """``properties`` (public_id, suppressed, …): a home hidden on request stays hidden wherever its sales go."""
    hidden = moves.join(properties.filter("suppressed").select(F.col("public_id").alias("old_id")), "old_id", "left_semi").select(F.col("new_id").alias("_to")).distinct()
    met = properties.join(hidden, F.col("public_id") == F.col("_to"), "left")
    return met.select(*((F.col("suppressed") | F.col("_to").isNotNull()).alias(c) if c == "suppressed" else F.col(c) for c in properties.columns))


def repointed(items: DataFrame, retired: DataFrame, owner: str | None = None) -> DataFrame:
    """``items`` (public_id, …) that follow the homes that went into others (``retired``: old_id, new_id).

    With ``owner``, an owner keeps at most one item a home: who holds one of the new home already loses that of the old one, and of several that
    come together the first by old identifier stays.
    """
    met = items.join(retired.select("old_id", "new_id"), F.col("public_id") == F.col("old_id"), "left")
    moved = met.withColumn("_moved", F.col("new_id").isNotNull()).withColumn("_was", F.col("public_id")).withColumn("public_id", F.coalesce("new_id", "public_id"))
    if owner is None:
        return moved.select(*items.columns)
    order = W.partitionBy(owner, "public_id").orderBy("_moved", "_was")
    return moved.withColumn("_nth", F.row_number().over(order)).filter("not _moved or _nth = 1").select(*items.columns)
