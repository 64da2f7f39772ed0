"""One search predicate for lists, tiles, saved searches and alerts, and the answers built on it."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, fields
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintel.functions.geo import distance_km
from lintel.sources.binding import PRECISIONS

from .market import AREA_KEYS, change_permille, latest, previous_plain

MAX_BOX = (0.6, 0.4)
MOST_RADIUS_M, USUAL_RADIUS_M = 20_000, 1_000
SORTS = {"-date": ("sale_date", True), "date": ("sale_date", False), "-price": ("cents", True), "price": ("cents", False), "-change": ("change", True), "change": ("change", False)}


@dataclass(frozen=True)
class SalesFilter:
    """What a search matches. Absent values do not restrict; the filters present become literals of the plan, which Catalyst pushes down."""

    price_min: int | None = None  # cents
    price_max: int | None = None
    date_from: date | None = None
    date_to: date | None = None
    type: str = "any"  # new, second_hand or any
    exclude_non_market: bool = True
    exclude_bulk: bool = True
    min_confidence: str = "locality"
    vat: str = "any"  # exclusive, inclusive or any
    county: tuple[str, ...] | None = None
    area: tuple[str, ...] | None = None  # names of areas
    routing_key: tuple[str, ...] | None = None
    near: tuple[float, float] | None = None  # longitude, latitude
    radius_m: int | None = None
    max_stop_m: int | None = None
    max_school_m: int | None = None
    box: tuple[float, float, float, float] | None = None  # west, south, east, north

    def __post_init__(self) -> None:
        for low, high in ((self.price_min, self.price_max), (self.date_from, self.date_to)):
            if low is not None and high is not None and low > high:
                raise ValueError(f"{low} is above {high}")
        if self.radius_m is not None and self.near is None:
            raise ValueError("a radius needs a point")
        if self.type not in ("any", "new", "second_hand") or self.vat not in ("any", "exclusive", "inclusive") or self.min_confidence not in PRECISIONS:
            raise ValueError("unknown type, vat or confidence")
        if self.box and (self.box[0] >= self.box[2] or self.box[1] >= self.box[3]):
            raise ValueError("malformed box")

    def to_params(self) -> dict[str, str]:
        """The filters that differ from their defaults, as text: lists joined by commas, numbers in plain notation."""
        out = {}
        for f in fields(self):
            value = getattr(self, f.name)
            if value is not None and value != f.default:
                out[f.name] = ",".join(map(str, value)) if isinstance(value, tuple) else str(value).lower() if isinstance(value, bool) else str(value)
        return out

    @classmethod
    def from_params(cls, params: dict[str, str]) -> SalesFilter:
        """The filter of stored parameters: the inverse of ``to_params``."""
        words = lambda v: tuple(v.split(","))
        numbers = lambda v: tuple(map(float, v.split(",")))
        read = dict.fromkeys(("price_min", "price_max", "radius_m", "max_stop_m", "max_school_m"), int) | dict.fromkeys(("date_from", "date_to"), date.fromisoformat)
        read |= dict.fromkeys(("exclude_non_market", "exclude_bulk"), lambda v: v == "true") | dict.fromkeys(("county", "area", "routing_key"), words) | dict.fromkeys(("near", "box"), numbers)
        return cls(**{k: read.get(k, str)(v) for k, v in params.items()})


def small_enough(box: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """The box of a map list, refused if it spans too much to be answered."""
    if box[2] - box[0] > MAX_BOX[0] or box[3] - box[1] > MAX_BOX[1]:
        raise ValueError("box too large")
    return box


def box_of(rows: DataFrame) -> DataFrame:
    """One row: the extent of points."""
    return rows.agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def near_box(lon: float, lat: float, radius_m: int) -> tuple[float, float, float, float]:
    """Degrees that surely hold a circle: a degree of longitude is as short as at the box's edge nearest to a pole."""
    dy = radius_m / 111_000
    north = math.radians(min(abs(lat) + dy, 89.9))
    dx = min(dy / math.cos(north), 180.0)
    return lon - dx, lat - dy, lon + dx, lat + dy


#: Where every place lies, and by how many degrees boxes of areas are widened: outlines are simplified, and places may lie a little outside their county.
WHOLE_MAP, AREA_MARGIN, COUNTY_MARGIN = (-11.0, 51.0, -5.0, 56.0), 0.01, 0.05
SIDES = ("west", "south", "east", "north")


def circle_box(lon: Column, lat: Column, radius_m: Column) -> Column:
    """``near_box`` of columns."""
    dy = radius_m / 111_000
    dx = F.least(dy / F.cos(F.radians(F.least(F.abs(lat) + dy, F.lit(89.9)))), F.lit(180.0))
    return F.struct((lon - dx).alias("west"), (lat - dy).alias("south"), (lon + dx).alias("east"), (lat + dy).alias("north"))


def envelopes(asked: DataFrame, areas: DataFrame, keys: DataFrame) -> DataFrame:
    """(ask_id, west, south, east, north): the smallest box that can hold all matches of each asked search; none where the filters can't match anything.

    ``asked``: ask_id and, null where not asked for, county and area (area_id), routing_key, a circle (lon, lat, radius_m) and a map's box (west, south,
    east, north). ``areas``: area_id, kind and a box; ``keys``: routing_key and a box. Each filter's box cuts the whole map's; an area or
    key without a box, or boxes that don't meet, leave no row.
    """
    box = F.struct(*SIDES)
    widened = lambda b, by: F.struct(*((b[s] + (by if i > 1 else -by)).alias(s) for i, s in enumerate(SIDES)))
    known = areas.select("area_id", "kind", box.alias("b"))
    county = known.filter("kind = 'county'").select(F.col("area_id").alias("county"), F.col("b").alias("_county"))
    area = known.select(F.col("area_id").alias("area"), F.col("b").alias("_area"), (F.col("kind") == "county").alias("_wide"))
    met = asked.join(county, "county", "left").join(area, "area", "left").join(keys.select("routing_key", box.alias("_key")), "routing_key", "left")
    circle = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), circle_box(F.col("lon"), F.col("lat"), F.coalesce("radius_m", F.lit(1000))))
    found = {
        "county": F.when(F.col("_county").isNotNull(), widened(F.col("_county"), COUNTY_MARGIN)),
        "area": F.when(F.col("_area").isNotNull(), widened(F.col("_area"), F.when(F.col("_wide"), COUNTY_MARGIN).otherwise(AREA_MARGIN))),
        "routing_key": F.col("_key"),
        "lon": circle,
        "west": F.when(F.col("west").isNotNull(), box),
    }
    possible = _all_of([F.col(c).isNull() | (b.isNotNull() & b["west"].isNotNull()) for c, b in found.items()])
    parts = F.array_compact(F.array(F.struct(*(F.lit(v).alias(s) for v, s in zip(WHOLE_MAP, SIDES, strict=True))), *found.values()))
    cut = [(F.array_max if i < 2 else F.array_min)(F.transform(parts, lambda b: b[s])).alias(s) for i, s in enumerate(SIDES)]  # noqa: B023
    return met.filter(possible).select("ask_id", *cut).filter("west <= east and south <= north")


def _all_of(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions)


def in_box(box: tuple[float, float, float, float]) -> Column:
    return F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])


def property_filters(f: SalesFilter, areas: DataFrame | None = None) -> list[Column]:
    out = [~F.col("suppressed"), F.col("precision") <= PRECISIONS.index(f.min_confidence)]
    if f.box:
        out.append(in_box(f.box))
    if f.county:
        out.append(F.col("county").isin(*(c.lower() for c in f.county)))
    if f.routing_key:
        out.append(F.col("routing_key").isin(*(k.upper() for k in f.routing_key)))
    if f.near:
        radius = min(f.radius_m or USUAL_RADIUS_M, MOST_RADIUS_M)
        out += [in_box(near_box(*f.near, radius)), distance_km(F.col("lon"), F.col("lat"), F.lit(f.near[0]), F.lit(f.near[1])) * 1000 <= radius]
    return out


def sale_filters(f: SalesFilter) -> list[Column]:
    out = [~F.col("withdrawn"), ~F.col("possible_duplicate")]
    if f.exclude_non_market:
        out.append(~F.col("not_full_market"))
    if f.exclude_bulk:
        out.append(F.col("bulk_group_id").isNull())
    for column, low, high in (("cents", f.price_min, f.price_max), ("sale_date", f.date_from, f.date_to)):
        if low is not None:
            out.append(F.col(column) >= F.lit(low))
        if high is not None:
            out.append(F.col(column) <= F.lit(high))
    if f.type != "any":
        out.append(F.col("is_new") if f.type == "new" else ~F.col("is_new"))
    if f.vat != "any":
        out.append(F.col("vat_exclusive") if f.vat == "exclusive" else ~F.col("vat_exclusive"))
    return out


def _all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    for c in conditions:
        df = df.filter(c)
    return df


def matching_sales(sales: DataFrame, properties: DataFrame, f: SalesFilter, areas: DataFrame | None = None, vicinity: DataFrame | None = None) -> DataFrame:
    """The latest matching sale of each property. ``areas`` is needed for area names, ``vicinity`` for distances to stops and schools."""
    places = _all(properties, property_filters(f))
    if f.area:
        named = areas.filter(F.col("name").isin(*f.area)).select("area_id")
        member = places.select("property_id", F.explode(F.array_compact(F.array(*AREA_KEYS))).alias("area_id"))
        places = places.join(member.join(named, "area_id", "left_semi").select("property_id"), "property_id", "left_semi")
    if f.max_stop_m is not None:
        places = places.join(vicinity.filter(F.col("stop_m") <= f.max_stop_m).select("property_id"), "property_id", "left_semi")
    if f.max_school_m is not None:
        places = places.join(vicinity.filter(F.least("primary_m", "post_primary_m") <= f.max_school_m).select("property_id"), "property_id", "left_semi")
    last = latest(_all(sales, sale_filters(f)), "property_id", "sale_date", "sale_id")
    return last.join(places.select("property_id", "county_id", "settlement_id", "precision", "lon", "lat"), "property_id")


def with_counts(matches: DataFrame, sales: DataFrame) -> DataFrame:
    """Adds n_sales: all sales of the property that are neither withdrawn nor repeats, whatever the filter."""
    counts = sales.filter(~F.col("withdrawn") & ~F.col("possible_duplicate")).groupBy("property_id").agg(F.count("*").alias("n_sales"))
    return matches.join(counts, "property_id", "left").withColumn("n_sales", F.coalesce("n_sales", F.lit(0)))


def with_change(matches: DataFrame, sales: DataFrame) -> DataFrame:
    """Adds prev_date, prev_cents and change (tenths of a percent) against the latest plain sale of an earlier day."""
    before = previous_plain(sales).select("sale_id", "prev_date", "prev_cents")
    return matches.join(before, "sale_id").withColumn("change", change_permille(F.col("cents"), F.col("prev_cents")))


def search(matches: DataFrame, sales: DataFrame, properties: DataFrame, sort: str = "-date", page: int = 1, size: int = 20) -> DataFrame:
    """One page of matches. Sorted by date or price, the page is cut first and only its rows meet the other tables."""
    column, down = SORTS[sort]
    order = [F.col(column).desc_nulls_last() if down else F.col(column).asc_nulls_last(), F.col("property_id")]
    cut = lambda df: df.orderBy(*order).offset((page - 1) * size).limit(size)
    if column == "change":
        # only sales of properties that match can come before a match
        rows = cut(with_change(matches, sales.join(matches.select("property_id"), "property_id", "left_semi")))
        own = sales.join(F.broadcast(rows.select("property_id")), "property_id", "left_semi")
    else:
        rows = cut(matches)
        own = sales.join(F.broadcast(rows.select("property_id")), "property_id", "left_semi")
        rows = with_change(rows, own)
    return with_counts(rows, own).join(properties.select("property_id", "address"), "property_id").orderBy(*order)


def totals(matches: DataFrame) -> DataFrame:
    """One row: how many match and their extent."""
    return matches.agg(F.count("*").alias("total"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def answer(matches: DataFrame, sales: DataFrame, properties: DataFrame, sort: str = "-date", page: int = 1, size: int = 20) -> DataFrame:
    """One page, each row with the total of all matches and their extent, as one answer."""
    return search(matches, sales, properties, sort, page, size).join(F.broadcast(totals(matches)))


def trigrams(text: Column) -> Column:
    """The set of three-letter pieces of each word, padded by two blanks in front and one behind."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    pieces = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams, in millionths (a whole number, so that ties are ties everywhere)."""
    shared = F.size(F.array_intersect(a, b)).cast("long")
    both = F.size(a) + F.size(b) - shared
    return F.when(both > 0, F.expr("cast(0 as bigint)") + F.floor(shared * 1_000_000 / both)).otherwise(0).cast("long")


AREA_KINDS = ("country", "county", "settlement", "electoral_division", "small_area", "townland")


def _area_order(q: str) -> list[Column]:
    kinds = F.array(*map(F.lit, AREA_KINDS))
    return [F.desc(F.col("name") == q), F.desc(F.col("name").ilike(f"{like_literal(q)}%")), F.array_position(kinds, F.col("kind")), F.char_length("name"), F.col("name")]


def autocomplete_areas(areas: DataFrame, text: str, size: int = 8) -> DataFrame:
    """Areas whose name, or a word of it, begins with the text: exact first, then by beginning, kind, length and name."""
    q = text.lower()
    starts, word = F.col("name").ilike(f"{like_literal(q)}%"), F.col("name").ilike(f"% {like_literal(q)}%")
    return areas.filter(starts | word).orderBy(*_area_order(q)).limit(size)


def like_literal(text: str) -> str:
    """Text as a LIKE pattern that means itself."""
    return re.sub(r"([\\%_])", r"\\\1", text)


#: The letters that routing keys begin with.
ROUTING_LETTERS = "acdefhknprtvwxy"


def routing_key_of(q: Column) -> Column:
    """The routing key that a text names: 'a63', or a Dublin district as 'd8', 'Dublin 8' or 'dublin 6w'; else null."""
    text = F.lower(F.trim(F.regexp_replace(q, r"\s+", " ")))
    district = F.regexp_extract(text, r"^(?:dublin|d)\s*([0-9]{1,2}|6w)$", 1)
    own = text.rlike(f"^[{ROUTING_LETTERS}][0-9]{{2}}$") | (text == "d6w")
    return F.when(own, F.upper(text)).when(district == "6w", "D6W").when(district != "", F.concat(F.lit("D"), F.lpad(district, 2, "0")))


def autocomplete(areas: DataFrame, normalised: DataFrame, keys: DataFrame, text: str, size: int = 8) -> DataFrame:
    """(rank, kind, name): the routing key that the text names, then areas, then addresses, ``size`` in all. ``keys``: routing_key, n."""
    asked = keys.filter(F.col("routing_key") == routing_key_of(F.lit(text))).select(F.lit(0).alias("part"), F.lit(0).alias("place"), F.lit("routing_key").alias("kind"), F.col("routing_key").alias("name"))
    # each part has ``size`` rows at most, so one window without a key numbers them
    q = text.lower()
    near = autocomplete_areas(areas, text, size).select(F.lit(1).alias("part"), F.row_number().over(W.orderBy(*_area_order(q))).alias("place"), "kind", "name")
    found = autocomplete_addresses(normalised, text, size)
    found = found.select(F.lit(2).alias("part"), F.row_number().over(W.orderBy(F.desc("score"), "normalised", "property_id")).alias("place"), F.lit("address").alias("kind"), F.col("normalised").alias("name"))
    all_parts = asked.unionByName(near).unionByName(found).orderBy("part", "place").limit(size)
    return all_parts.select(F.row_number().over(W.orderBy("part", "place")).alias("rank"), "kind", "name")


#: Short forms that people type, and what the register spells out.
SHORT_FORMS = {"rd": "road", "ave": "avenue", "st": "street", "sq": "square", "pk": "park", "dr": "drive", "cres": "crescent", "ct": "court", "tce": "terrace", "co": ""}


def query_words(text: str, most: int = 6) -> list[str]:
    words = [SHORT_FORMS.get(w, w) for w in text.lower().replace(",", " ").replace(".", " ").split()]
    return [w for w in words if w][:most]


def autocomplete_addresses(normalised: DataFrame, text: str, size: int = 8) -> DataFrame:
    """Properties whose address holds every word of the text (short forms spelt out), the most similar first."""
    words = query_words(text)
    if sum(map(len, words)) < 3:
        return normalised.limit(0).withColumn("score", F.lit(0).cast("long"))
    found = _all(normalised, [F.col("normalised").ilike(f"%{like_literal(w)}%") for w in words])
    score = similarity(trigrams(F.col("normalised")), trigrams(F.lit(" ".join(words))))
    return found.withColumn("score", score).orderBy(F.desc("score"), "normalised", "property_id").limit(size)
