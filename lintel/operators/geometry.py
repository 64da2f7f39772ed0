"""Polygons as closed arrays of (x, y): parts of few corners, unions by code, simplified outlines. Columns, joins and aggregates; cutting is numpy inside tasks.

Whatever follows a ring (cutting, joining, thinning) runs in rounds over all rings at once; a round is a written table, and rounds
grow with the logarithm of a ring's corners (simplification: with the depth of its splits). Rings are gathered as arrays at the end only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions.geo import in_ring
from lintel.operators.spatial import covered
from lintel.sources.scratch import drop, kept

MOST_CORNERS = 256


def corners(ring: Column) -> Column:
    return F.size(ring) - 1


def twice_area(ring: Column) -> Column:
    """Twice the area a closed ring goes round, positive where it runs against the clock; from its first corner, to keep numbers small."""
    x0, y0 = F.element_at(ring, 1)["x"], F.element_at(ring, 1)["y"]

    def cross(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        return (a["x"] - x0) * (b["y"] - y0) - (b["x"] - x0) * (a["y"] - y0)

    return F.aggregate(F.transform(F.sequence(F.lit(1), corners(ring)), cross), F.lit(0.0), lambda s, c: s + c)


def box(ring: Column) -> tuple[Column, Column, Column, Column]:
    """Least x, least y, greatest x, greatest y."""
    of = lambda pick, axis: pick(ring[axis])
    return of(F.array_min, "x"), of(F.array_min, "y"), of(F.array_max, "x"), of(F.array_max, "y")


def _halves(u: np.ndarray, v: np.ndarray, size: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What rings have below and above their lines u = at: corners, how many each part has, and the numbers of the rings that have a part there.
    Rings come and go without the corner that closes them, one after the other, ``size`` corners each.

    Where a ring comes back to its line, it runs along it: areas and crossings stay right. Of a run of corners on the line, the first and the last stay.
    """
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    line = np.repeat(at, size)
    below, above = u < line, u > line
    on_line = ~(below | above)

    def following(x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[:-1] = x[1:]
        out[ends] = x[starts]
        return out

    crosses = (below & following(above)) | (above & following(below))
    c = np.flatnonzero(crosses)
    whose = np.searchsorted(ends, c)
    after = np.where(c == ends[whose], starts[whose], c + 1)
    line_c, u_c, v_c = line[c], u[c], v[c]
    cut = v_c + (line_c - u_c) / (u[after] - u_c) * (v[after] - v_c)
    for held in (~above, ~below):
        made = held.view(np.int8) + crosses.view(np.int8)
        upto = np.cumsum(made, dtype=np.int64)
        n = np.add.reduceat(made, starts, dtype=np.int64)
        h = np.flatnonzero(held)
        place, place_c = upto[h] - 1 - crosses[h], upto[c] - 1
        p, q, on = np.empty(upto[-1]), np.empty(upto[-1]), np.empty(upto[-1], bool)
        p[place], p[place_c], q[place], q[place_c] = u[h], line_c, v[h], cut
        on[place], on[place_c] = on_line[h], True
        # corners on the line between two others on it
        last = np.cumsum(n) - 1
        i = np.flatnonzero(on)
        of = np.searchsorted(last, i)
        first_of, last_of = (last - n + 1)[of], last[of]
        between = on[np.where(i == first_of, last_of, i - 1)] & on[np.where(i == last_of, first_of, i + 1)]
        fewer = n - np.bincount(of[between], minlength=len(n))
        whole = fewer >= 3
        if between.any() or not whole.all():
            stays = np.repeat(whole, n)
            stays[i[between]] = False
            p, q = p[stays], q[stays]
        rings = np.flatnonzero(whole)
        yield p, q, fewer[rings], rings


def _spans(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Least x, least y, greatest x and greatest y of each ring."""
    starts = np.cumsum(size) - size
    return [pick.reduceat(c, starts) for pick in (np.minimum, np.maximum) for c in (x, y)]


#: Rings: x, y, corners of each, and the number of the polygon each is of.
Lot = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Corners that are cut at a time: arrays of a megabyte, which stay near the processor.
LOT = 1 << 17


def _lots(lot: Lot) -> Iterator[Lot]:
    """The same rings in lots of some ``LOT`` corners."""
    x, y, size, owner = lot
    ends = np.cumsum(size)
    edges = np.flatnonzero(np.diff((ends - 1) // LOT)) + 1
    for rings, corner in zip(np.split(np.arange(len(size)), edges), np.split(np.arange(len(x)), ends[edges - 1]), strict=True):
        if len(rings):
            at, to = slice(rings[0], rings[-1] + 1), slice(corner[0], corner[-1] + 1)
            yield x[to], y[to], size[at], owner[at]


def _parts(lot: Lot, most: int, levels: int | None) -> Iterator[Lot]:
    """Parts of rings that are cut to the quarters of their boxes until none has more than ``most`` corners, or ``levels`` times.

    What was cut last is cut on first, so that no more than a few lots a level are held however many parts there are.
    """
    held = [(0, part) for part in _lots(lot)]
    while held:
        level, lot = held.pop()
        same, corners_held = [lot], len(lot[0])
        while held and held[-1][0] == level and corners_held + len(held[-1][1][0]) <= LOT:
            same.append(held.pop()[1])
            corners_held += len(same[-1][0])
        x, y, size, owner = lot if len(same) == 1 else (np.concatenate(c) for c in zip(*same, strict=True))
        x0, y0, x1, y1 = _spans(x, y, size)
        large = (size > most) & (np.maximum(x1 - x0, y1 - y0) > 2) & (level != levels)
        if not large.all():
            done = np.repeat(~large, size)
            yield x[done], y[done], size[~large], owner[~large]
            x, y, size, owner, x0, y0, x1, y1 = x[~done], y[~done], *(c[large] for c in (size, owner, x0, y0, x1, y1))
        if not len(size):
            continue
        cx, cy = (np.floor((a + b) / 2) + 0.5 for a, b in ((x0, x1), (y0, y1)))
        quarters = []
        for hx, hy, half, of in _halves(x, y, size, cx):
            if len(half):
                quarters += [(qx, qy, n, owner[of[part]]) for qy, qx, n, part in _halves(hy, hx, half, cy[of])]
        held += [(level + 1, part) for part in _lots(tuple(np.concatenate(c) for c in zip(*quarters, strict=True)))] if quarters else []


def _rings_of(batch: pa.RecordBatch) -> Lot:
    rings = batch.column(1)
    x, y = (pa.compute.struct_field(rings.flatten(), c).to_numpy(zero_copy_only=False) for c in "xy")
    size = rings.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    open_, stays = size - 1, np.ones(len(x), bool)
    stays[np.cumsum(size) - 1] = False
    return x[stays], y[stays], open_, np.arange(len(size))


def _rings(lot: Lot, most: int) -> list[pa.Array]:
    """Rings closed again, their corners and whether they have more than ``most`` and are not tiny."""
    x, y, size, _ = lot
    ends = np.cumsum(size)
    corner = pa.StructArray.from_arrays([pa.array(np.insert(c, ends, c[ends - size])) for c in (x, y)], ["x", "y"])
    x0, y0, x1, y1 = _spans(x, y, size)
    offsets = np.append(0, np.cumsum(size + 1))
    return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), corner), pa.array(size, pa.int32()), pa.array((size > most) & (np.maximum(x1 - x0, y1 - y0) > 2))]


def _figures(lot: Lot, _: int) -> list[pa.Array]:
    """Least x and y, corners and twice the area (``twice_area``, summed in the same order)."""
    x, y, size, _ = lot
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    dx, dy = x - np.repeat(x[starts], size), y - np.repeat(y[starts], size)
    cross = np.zeros(len(x))
    cross[:-1] = dx[:-1] * dy[1:] - dx[1:] * dy[:-1]
    cross[ends] = 0.0  # the side to the first corner
    x0, y0, _, _ = _spans(x, y, size)
    return [pa.array(x0), pa.array(y0), pa.array(size, pa.int32()), pa.array(np.bincount(np.repeat(np.arange(len(size)), size), cross, len(size)))]


def _cut(most: int, levels: int | None, said: Callable[[Lot, int], list[pa.Array]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For tasks: (key, ring) to the key and what is ``said`` of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for lot in _parts(_rings_of(batch), most, levels):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lot[3])), *said(lot, most)], [batch.schema.names[0], *names])

    return run


#: How often a part is cut before the parts are dealt anew; corners of parts that one task cuts to the end; corners a task begins with.
LEVELS, ONE_TASK, BEGIN = 3, 8192, 1 << 19
_RING = "array<struct<x: double, y: double>>"


def _dealt(polygons: DataFrame, key: str, most: int) -> DataFrame:
    """(key, ring): parts that are small enough to be cut to the end in one task each, dealt to many tasks."""
    ring = F.transform("ring", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    least = 4 * polygons.sparkSession.sparkContext.defaultParallelism
    parts = kept(polygons.filter("size(ring) > 1").select(key, ring.alias("ring"), corners(F.col("ring")).alias("_n"), F.lit(True).alias("_large")), "parts")
    count = lambda df: df.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    enough = lambda n: max(least, n // BEGIN + 1)
    total = count(parts)
    small = max(most, min(ONE_TASK, total // (4 * least)))
    ready, schema, names = [], parts.schema, ["ring", "_n", "_large"]
    while total:
        parts = kept(parts.filter("_large").select(key, "ring").repartition(enough(total)).mapInArrow(_cut(small, LEVELS, _rings, names), schema), "parts")
        ready.append(parts.filter("not _large"))
        total = count(parts.filter("_large"))
    pieces = reduce(DataFrame.unionByName, ready) if ready else parts
    return pieces.select(key, "ring").repartition(enough(count(pieces)))


def subdivided(polygons: DataFrame, key: str, most: int = MOST_CORNERS) -> DataFrame:
    """(key, ring): parts of at most ``most`` corners that together are the polygons.

    A part with more corners is cut to the four quarters of its box, along lines between whole metres, until none has more. A part of less than two
    metres stays as it is. In each round tasks cut the parts they got a few times; what is still large is dealt anew, so that the parts of one
    ring are cut in many tasks, and small ones are then cut to the end. A ring whose long sides all cross its middle makes parts by the square of its corners.
    """
    schema = polygons.limit(0).select(key, F.lit(None).cast(_RING).alias("ring"), F.lit(0).alias("_n"), F.lit(True).alias("_large")).schema
    parts = kept(_dealt(polygons, key, most).mapInArrow(_cut(most, None, _rings, ["ring", "_n", "_large"]), schema), "parts").select(key, "ring")
    return parts.unionByName(polygons.filter("size(ring) = 1").select(key, F.col("ring").cast(_RING).alias("ring")))  # points have no sides


def part_figures(polygons: DataFrame, key: str, most: int = MOST_CORNERS) -> DataFrame:
    """(key, x0, y0, corners, area2): the least x and y, the corners and twice the area of each part of ``subdivided``.

    The tasks that cut the parts work out their figures, so that corners are written for parts of up to ``ONE_TASK`` corners only and not for every part.
    """
    schema = polygons.limit(0).select(key, *(F.lit(0.0).alias(c) for c in ("x0", "y0")), F.lit(0).alias("corners"), F.lit(0.0).alias("area2")).schema
    return _dealt(polygons, key, most).mapInArrow(_cut(most, None, _figures, ["x0", "y0", "corners", "area2"]), schema)


def inside_parts(points: DataFrame, parts: DataFrame, key: str, polygon_key: str, size: float) -> DataFrame:
    """(key, polygon_key): the smallest key of a polygon that holds the point, by its parts' cells of ``size``. Points have whole x and y."""
    here = points.withColumn("i", F.floor(F.col("x") / size).cast("long")).withColumn("j", F.floor(F.col("y") / size).cast("long"))
    met = here.join(covered(parts, size).select(polygon_key, "ring", "i", "j"), ["i", "j"]).filter(in_ring(F.col("x"), F.col("y"), F.col("ring")))
    return met.groupBy(key).agg(F.min(polygon_key).alias(polygon_key))


def inside_sectors(points: DataFrame, polygons: DataFrame, key: str, polygon_key: str, size: float) -> DataFrame:
    """(key, polygon_key): the smallest key of a polygon that holds the point (its edge included), by sectors of the rings. Points have whole x and y.

    Around the middle of its box a ring is dealt to as many equal sectors as it has sides, and a side is listed in those that it reaches into. A
    point looks outwards along the line from the middle, so it meets the sides of its own sector only: one or two where the ring goes
    round its middle once, however long and thin its spikes are. Points and rings meet by cells of ``size``.
    """
    rings = kept(polygons.select(polygon_key, "ring").withColumn("_ring", F.monotonically_increasing_id()), "rings")
    n = corners(F.col("ring"))
    sides = rings.filter(n > 0).select("_ring", F.explode(F.arrays_zip(F.slice("ring", F.lit(1), n).alias("a"), F.slice("ring", F.lit(2), n).alias("b"))).alias("s"))
    sides = sides.select("_ring", *(F.col(f"s.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"))
    bounds = sides.groupBy("_ring").agg(F.min("ax").alias("x0"), F.max("ax").alias("x1"), F.min("ay").alias("y0"), F.max("ay").alias("y1"), F.count("*").alias("sectors"))
    # halves, so that no point is the middle itself
    middle = [(F.floor((F.col(f"{c}0") + F.col(f"{c}1")) / 2) + F.lit(0.5)).alias(f"o{c}") for c in "xy"]
    heads = kept(bounds.join(rings.select("_ring", polygon_key), "_ring").select("*", *middle), "rings")
    angle = lambda x, y: F.atan2(F.col(y) - F.col("oy"), F.col(x) - F.col("ox")) + math.pi
    sector = lambda a: F.floor(a / (2 * math.pi) * F.col("sectors")).cast("long")
    turns = sides.join(heads.select("_ring", "sectors", "ox", "oy"), "_ring").withColumns({"_a": angle("ax", "ay"), "_b": angle("bx", "by")})
    low, high = F.least("_a", "_b"), F.greatest("_a", "_b")
    # a side spans less than half a turn; one through the middle, just that, is listed all round
    first, last = F.when(high - low > math.pi, high).otherwise(low), F.when(high - low > math.pi, low + 2 * math.pi).otherwise(high)
    through = F.abs(high - low - math.pi) < 1e-6
    turns = turns.withColumns({"_first": F.when(through, F.lit(0)).otherwise(sector(first - 1e-9)), "_last": F.when(through, F.col("sectors") - 1).otherwise(sector(last + 1e-9))})
    reached = F.sequence("_first", F.least(F.col("_last"), F.col("_first") + F.col("sectors") - 1))
    listed = turns.withColumn("_s", F.explode(reached)).select("_ring", F.pmod("_s", "sectors").alias("sector"), "ax", "ay", "bx", "by", "ox", "oy")
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    boxes = heads.withColumn("i", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("j", F.explode(F.sequence(cell("y0"), cell("y1"))))
    here = points.select(key, "x", "y").distinct().withColumns({"i": cell("x"), "j": cell("y")})
    asked = here.join(boxes, ["i", "j"]).filter("x between x0 and x1 and y between y0 and y1")
    asked = asked.select(key, "x", "y", "_ring", polygon_key, F.pmod(sector(angle("x", "y")), F.col("sectors")).alias("sector"))
    x, y, ax, ay, bx, by = (F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by"))
    dx, dy = x - F.col("ox"), y - F.col("oy")
    left = lambda px, py: dx * (py - F.col("oy")) - dy * (px - F.col("ox")) > 0
    turn = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    crossed = (left(ax, ay) != left(bx, by)) & (left(ax, ay) == (turn < 0))
    touched = (turn == 0) & x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))
    met = asked.join(listed, ["_ring", "sector"]).groupBy("_ring", "sector", key, "x", "y", polygon_key).agg(F.sum(crossed.cast("int")).alias("crossed"), F.bool_or(touched).alias("touched"))
    return met.filter("touched or crossed % 2 = 1").groupBy(key).agg(F.min(polygon_key).alias(polygon_key))


def _edges(polygons: DataFrame, code: str) -> DataFrame:
    """(code, ax, ay, bx, by): the sides of all rings, turned against the clock; sides without length go."""
    ring = F.when(twice_area(F.col("ring")) < 0, F.reverse("ring")).otherwise(F.col("ring"))
    sides = polygons.select(code, ring.alias("ring")).select(code, "ring", F.explode(F.sequence(F.lit(1), corners(F.col("ring")))).alias("i"))
    a, b = F.element_at("ring", F.col("i")), F.element_at("ring", F.col("i") + 1)
    sides = sides.select(code, a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    return sides.filter("ax <> bx or ay <> by")


def _noded(edges: DataFrame, code: str, size: float) -> DataFrame:
    """The sides, cut where a corner of the same code lies on them. Sides and corners meet by cells of ``size``."""
    cell = lambda v: F.floor(v / size).cast("long")
    corner = edges.select(code, F.col("ax").alias("x"), F.col("ay").alias("y")).distinct().withColumns({"i": cell(F.col("x")), "j": cell(F.col("y"))})
    spread = edges.withColumn("i", F.explode(F.sequence(cell(F.least("ax", "bx")), cell(F.greatest("ax", "bx")))))
    spread = spread.withColumn("j", F.explode(F.sequence(cell(F.least("ay", "by")), cell(F.greatest("ay", "by")))))
    dx, dy, px, py = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("x") - F.col("ax"), F.col("y") - F.col("ay")
    along = px * dx + py * dy
    on = (dx * py == dy * px) & (along > 0) & (along < dx * dx + dy * dy)
    side = ["ax", "ay", "bx", "by"]
    cuts = spread.join(corner, [code, "i", "j"]).filter(on).groupBy(code, *side).agg(F.array_sort(F.collect_set(F.struct(along.alias("t"), "x", "y"))).alias("cuts"))
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    inner = F.transform(F.coalesce(F.col("cuts"), F.array().cast(cuts.schema["cuts"].dataType)), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    met = edges.join(cuts, [code, *side], "left").select(code, F.concat(F.array(at("ax", "ay")), inner, F.array(at("bx", "by"))).alias("path"))
    met = met.select(code, "path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("k"))
    a, b = F.element_at("path", F.col("k")), F.element_at("path", F.col("k") + 1)
    return met.select(code, a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))


def united(polygons: DataFrame, code: str, size: float) -> DataFrame:
    """(code, ring): outlines and holes of the union of each code's polygons, which may touch and enclose but not overlap each other.

    A side that two polygons share is met once in each direction and goes. What is left are closed walks: where several touch in a corner, a
    side is followed by the one furthest to the left, which keeps the inner side on the left. Each side then looks twice as far in
    every round for the smallest side of its walk and the steps to it, which names the ring and orders its corners. Outlines
    run against the clock, holes with it.
    """
    sides = _noded(_edges(polygons, code), code, size)
    forward = F.expr("ax < bx or (ax = bx and ay < by)")
    ends = [F.when(forward, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("ax", "bx", "px"), ("ay", "by", "py"), ("bx", "ax", "qx"), ("by", "ay", "qy"))]
    net = sides.select(code, *ends, F.when(forward, 1).otherwise(-1).alias("way")).groupBy(code, "px", "py", "qx", "qy").agg(F.sum("way").alias("way")).filter("way <> 0")
    turn = lambda a, b, c: F.when(F.col("way") > 0, F.col(a)).otherwise(F.col(b)).alias(c)
    left = kept(net.select(code, turn("px", "qx", "ax"), turn("py", "qy", "ay"), turn("qx", "px", "bx"), turn("qy", "py", "by")), "sides")
    side = F.struct("ax", "ay", "bx", "by")
    out = left.select(code, F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("bx").alias("cx"), F.col("by").alias("cy"))
    dx, dy, ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("cx") - F.col("bx"), F.col("cy") - F.col("by")
    angle = F.atan2(dx * ey - dy * ex, dx * ex + dy * ey)
    follows = left.join(out, [code, "bx", "by"]).groupBy(code, side.alias("side")).agg(F.max_by(F.struct(F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("cx").alias("bx"), F.col("cy").alias("by")), angle).alias("next"))
    walks = kept(follows.select(code, "side", "next", F.col("side").alias("first"), F.lit(0).cast("long").alias("steps")), "walks")
    drop(left)
    reach = 1
    while True:
        ahead = walks.select(code, F.col("side").alias("next"), F.col("next").alias("_next"), F.col("first").alias("_first"), F.col("steps").alias("_steps"))
        nearer = F.col("_first") < F.col("first")
        met = walks.join(ahead, [code, "next"]).select(
            code, "side", F.col("_next").alias("next"), F.least("first", "_first").alias("first"), F.when(nearer, F.col("_steps") + reach).otherwise(F.col("steps")).alias("steps"), nearer.alias("moved")
        )
        further, reach = kept(met, "walks"), 2 * reach
        drop(walks)
        walks = further
        if walks.filter("moved").isEmpty():
            break
    # steps lead on to the first side: the last of them comes right after it
    order = F.when(F.col("steps") == 0, F.lit(0)).otherwise(-F.col("steps"))
    found = walks.groupBy(code, "first").agg(F.sort_array(F.collect_list(F.struct((F.col("steps") > 0).alias("later"), order.alias("nth"), F.col("side.ax").alias("x"), F.col("side.ay").alias("y")))).alias("p"))
    points = F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return found.select(code, F.concat(points, F.slice(points, 1, 1)).alias("ring"))


def simplified(polygons: DataFrame, key: str, tolerance: float) -> DataFrame:
    """(key, ring): outlines thinned so that no corner that goes is further than ``tolerance`` from the line that replaces it.

    The rule of Douglas and Peucker in rounds: of each open stretch between two kept corners, the furthest corner (the first
    of several) is kept if it is further away than the tolerance, and both halves stay open; else the stretch is done. Only corners of
    open stretches enter the next round. A ring that would have fewer than three corners stays as it is. ``key`` is the ring's own.
    """
    points = kept(polygons.select(key, F.posexplode("ring").alias("pos", "p")).select(key, F.col("pos").cast("long").alias("pos"), "p.x", "p.y"), "corners")
    ends = points.groupBy(key).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min_by(F.struct("x", "y"), "pos").alias("a"), F.max_by(F.struct("x", "y"), "pos").alias("b"))
    done = [ends.select(key, F.explode(F.array("lo", "hi")).alias("pos"))]
    open_ = points.join(ends, key).filter("pos > lo and pos < hi")
    while True:
        ax, ay, dx, dy = F.col("a.x"), F.col("a.y"), F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
        cross, long2 = dx * (F.col("y") - ay) - dy * (F.col("x") - ax), dx * dx + dy * dy
        # the square of the distance to the line, or to the point where both ends are one
        away = F.when(long2 == 0, (F.col("x") - ax) * (F.col("x") - ax) + (F.col("y") - ay) * (F.col("y") - ay)).otherwise(cross * cross / long2)
        stretch = [key, "lo", "hi"]
        furthest = open_.groupBy(*stretch).agg(F.max(F.struct(away.alias("away"), (-F.col("pos")).alias("back"), "x", "y")).alias("m")).filter(F.col("m.away") > tolerance * tolerance)
        furthest = kept(furthest.select(*stretch, (-F.col("m.back")).alias("mid"), F.struct("m.x", "m.y").alias("c")), "furthest")
        if furthest.isEmpty():
            break
        done.append(furthest.select(key, F.col("mid").alias("pos")))
        met = open_.join(furthest, stretch).filter("pos <> mid")
        before = F.col("pos") < F.col("mid")
        side = lambda a, b, name: F.when(before, F.col(a)).otherwise(F.col(b)).alias(name)
        open_ = kept(met.select(key, "pos", "x", "y", side("lo", "mid", "lo"), side("mid", "hi", "hi"), side("a", "c", "a"), side("c", "b", "b")), "open")
    held = reduce(DataFrame.unionByName, done).join(points, [key, "pos"])
    rings = held.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", F.struct("x", "y").alias("p")))).alias("s")).select(key, F.col("s.p").alias("_thin"))
    return polygons.select(key, "ring").join(rings, key).select(key, F.when(F.size("_thin") >= 4, F.col("_thin")).otherwise(F.col("ring")).alias("ring"))


def straightened(ring: Column) -> Column:
    """The closed ring without corners that lie on the line between their neighbours. Its first corner stays."""

    def bends(p: Column, i: Column) -> Column:
        a, b = F.element_at(ring, F.greatest(i, F.lit(1))), F.element_at(ring, F.least(i + 2, F.size(ring)))
        ends = (i == 0) | (i == corners(ring))
        return ends | ((p["x"] - a["x"]) * (b["y"] - a["y"]) != (p["y"] - a["y"]) * (b["x"] - a["x"]))

    return F.filter(ring, bends)


def cleaned(polygons: DataFrame) -> DataFrame:
    """Rings without repeated neighbours, and without the rings that go round no area."""
    ring = F.filter("ring", lambda p, i: (i == 0) | (p != F.element_at(F.col("ring"), F.greatest(i, F.lit(1)))))
    rows = polygons.withColumn("ring", ring)
    return rows.filter((corners(F.col("ring")) >= 3) & (twice_area(F.col("ring")) != 0))


def centroids(polygons: DataFrame, key: str) -> DataFrame:
    """(key, x, y, area) over all rings of a key, holes counted off: sums of triangles from the first corner of each ring."""
    ring = F.col("ring")
    o = F.element_at(ring, 1)

    def triangle(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        w = (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])
        return F.struct(w.alias("w"), (w * (o["x"] + a["x"] + b["x"])).alias("wx"), (w * (o["y"] + a["y"] + b["y"])).alias("wy"))

    each = polygons.select(key, F.explode(F.transform(F.sequence(F.lit(1), corners(ring)), triangle)).alias("t"))
    sums = each.groupBy(key).agg(*(F.sum(f"t.{c}").alias(c) for c in ("w", "wx", "wy"))).filter("w <> 0")
    return sums.select(key, (F.col("wx") / (3 * F.col("w"))).alias("x"), (F.col("wy") / (3 * F.col("w"))).alias("y"), (F.col("w") / 2).alias("area"))


def numbered_rings(rings: DataFrame, code: str) -> DataFrame:
    """``rings`` with ``ring_no`` from 1 in each code, by first corner: a code has few rings beside its corners."""
    first = F.element_at("ring", 1)
    return rings.withColumn("ring_no", F.row_number().over(Window.partitionBy(code).orderBy(first["x"], first["y"], F.size("ring"))))
