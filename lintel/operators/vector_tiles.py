"""Vector tiles of points: the protobuf bytes of every tile at one zoom, made of Columns.

A feature is written where its row is, as hex text: its number, its tags, and one move to its place in the tile as zigzag varints. A tile has one
layer, whose features and values are the rows' own bytes one after the other, in the order of their identifiers; a value belongs to one
feature, so that no dictionary has to be gathered. What meets in a task is a tile's finished bytes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintel.functions import text as T
from lintel.functions.geo import web_mercator

EXTENT, HALF = 4096, math.pi * 6378137.0


def _bytes(n: int) -> str:
    """A whole number as base-128 bytes, in hex."""
    out = []
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n]).hex().upper()


def varint(n: Column) -> Column:
    """A whole number from 0 up to 2^35 as base-128 bytes, in hex: seven bits a byte, the lowest first, the top bit set on all but the last."""

    def spelt(n: Column) -> Column:
        def byte(i: int) -> Column:
            low = F.shiftright(n, 7 * i).bitwiseAND(F.lit(127).cast("long"))
            more = (n >= F.lit(1 << 7 * (i + 1))).cast("long") * 128
            return F.lpad(F.hex(low + more), 2, "0")

        return F.concat_ws("", byte(0), *(F.when(n >= F.lit(1 << 7 * i), byte(i)) for i in range(1, 5)))

    return T.let(n.cast("long"), spelt)


def zigzag(n: Column) -> Column:
    n = n.cast("long")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def held(number: int, wire: int, body: Column) -> Column:
    """A field: its key, and for bytes (wire type 2) their length, before the body in hex. The body is worked out once."""
    key = F.lit(_bytes(number << 3 | wire))
    if wire != 2:
        return F.concat(key, body)
    return T.let(body, lambda b: F.concat(key, varint((F.octet_length(b) / 2).cast("long")), b))


def text_hex(value: str) -> Column:
    return F.lit(value.encode().hex().upper())


def tiles(rows: DataFrame, z: int, layer: str, key: str, attributes: tuple[str, ...]) -> DataFrame:
    """(z, x, y, n, tile) of every tile at zoom ``z`` that holds a point. ``rows``: key (a whole number), lon, lat and ``attributes``, whole numbers of 0 or more.

    Places are whole units of the tile's extent, cut to it; a null attribute is left out.
    """
    size = 2 * HALF / 2**z
    px, py = web_mercator(F.col("lon"), F.col("lat"))
    across, down = (px + HALF) / size, (F.lit(HALF) - py) / size
    at = rows.select(key, *attributes, across.alias("_a"), down.alias("_d")).withColumns({"x": F.floor("_a").cast("int"), "y": F.floor("_d").cast("int")})
    at = at.filter(F.col("x").between(0, 2**z - 1) & F.col("y").between(0, 2**z - 1))
    unit = lambda c, tile: F.floor((F.col(c) - F.col(tile)) * EXTENT).cast("long")
    at = at.withColumns({"_u": unit("_a", "x"), "_v": unit("_d", "y"), "_nth": F.row_number().over(W.partitionBy("x", "y").orderBy(key)) - 1})
    tag = lambda i, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(_bytes(i)), varint(F.col("_nth") * len(attributes) + i)))
    tags = F.concat_ws("", *(tag(i, c) for i, c in enumerate(attributes)))
    moved = F.concat(F.lit(_bytes(9)), varint(zigzag(F.col("_u"))), varint(zigzag(F.col("_v"))))  # one "move to" of one point
    feature = F.concat(held(1, 0, varint(F.col(key))), held(2, 2, tags), held(3, 0, F.lit(_bytes(1))), held(4, 2, moved))
    value = lambda c: held(4, 2, held(5, 0, varint(F.coalesce(F.col(c), F.lit(0)))))  # noqa: E731  an unsigned number
    made = at.select("x", "y", F.struct("_nth", held(2, 2, feature).alias("f"), F.concat(*map(value, attributes)).alias("v")).alias("s"))
    whole = made.groupBy("x", "y").agg(F.sort_array(F.collect_list("s")).alias("s"))
    names = F.concat(*(held(3, 2, text_hex(a)) for a in attributes))
    body = F.concat(held(15, 0, F.lit(_bytes(2))), held(1, 2, text_hex(layer)), F.array_join("s.f", ""), names, F.array_join("s.v", ""), held(5, 0, F.lit(_bytes(EXTENT))))
    return whole.select(F.lit(z).alias("z"), "x", "y", F.size("s").cast("long").alias("n"), F.unhex(held(3, 2, body)).alias("tile"))
