"""What is built to hold at scale: selection of quantiles, clusters, scanned registers, the trigram index, state that expires."""

import csv
import io
import math
import random

import pytest
from pyspark.sql import functions as F

from lintel.functions import quantiles as Q
from lintel.operators import search, spatial, trigram
from lintel.sources import files


@pytest.mark.parametrize("n", [1, 2, 3, 7, 5000])
def test_selected_equals_percentile(spark, n):
    rng = random.Random(n)
    values = [rng.choice((rng.randint(-(2**20), 2**20), rng.randint(-(2**44), 2**44), rng.randint(0, 300), 2**24, -(2**24), 65536, 65535)) for _ in range(n)]
    rows = spark.createDataFrame([(None if i % 11 == 0 else f"g{i % 3}", v) for i, v in enumerate(values)], "g string, cents long")
    plain, wide = (sorted(map(tuple, Q.group_stats(rows, ["g"], 1, wide=w).collect()), key=str) for w in (False, True))
    assert plain == wide


def test_ranges_are_ordered_and_apart(spark):
    edges = [s * (2**b + d) for b in range(0, 60) for d in (-1, 0, 1) for s in (1, -1)]
    rows = spark.createDataFrame([(v,) for v in sorted(edges)], "v long").select("v", Q.range_of(F.col("v")).alias("r")).orderBy("v").collect()
    assert all(a["r"] <= b["r"] and a["r"] <= a["v"] for a, b in zip(rows, rows[1:], strict=False))


def test_one_group_of_a_million_values(spark):
    """Neither the ranges that are put in order nor the values of a range come near the group's size."""
    rows = spark.range(1_000_000).select(F.lit("all").alias("g"), (F.col("id") * 97 % 1_000_003 * 101 + 5_000_000).alias("cents"))
    counted = rows.groupBy("g", "cents").agg(F.count("*").alias("k"))
    ranges = counted.groupBy(Q.range_of(F.col("cents")).alias("r")).agg(F.count("*").alias("n")).agg(F.count("*").alias("ranges"), F.max("n").alias("most")).first()
    assert ranges["ranges"] < 70_000 and ranges["most"] < 70_000
    found = Q.counted_stats(counted, ["g"], wide=True).first()
    cents = sorted(i * 97 % 1_000_003 * 101 + 5_000_000 for i in range(1_000_000))
    at = lambda p: (cents[math.floor(p * 999_999)] + (cents[math.ceil(p * 999_999)] - cents[math.floor(p * 999_999)]) * (p * 999_999 - math.floor(p * 999_999)))
    assert (found["n"], found["median"], found["p25"], found["p75"]) == (1_000_000, *(math.floor(at(p) + 0.5) for p in (0.5, 0.25, 0.75)))


def km(a, b):
    (x, y), (u, v) = a, b
    h = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize(("n", "reach", "spread"), [(120, 20_000, 1.5), (300, 250, 0.02), (200, 30, 0.002), (60, 900_000, 2.0)])
def test_clusters_equal_all_pairs(spark, n, reach, spread):
    rng = random.Random(n)
    rows = [(i, rng.choice("ab") if i % 10 else None, -8 + rng.gauss(0, spread), 53.5 + rng.gauss(0, spread / 2)) for i in range(n)]
    rows += [(n + i, "a", rows[0][2], rows[0][3]) for i in range(5)]
    top = {r[0]: r[0] for r in rows}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, g, *p in rows:
        for j, h, *q in rows:
            if i < j and g == h and g is not None and km(p, q) * 1000 <= reach:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    points = spark.createDataFrame(rows, "k long, g string, lon double, lat double")
    assert {r["k"]: r["cluster"] for r in spatial.clusters(points, "g", "k", reach).collect()} == {i: find(i) for i in top}


def test_dense_cells_make_few_pairs(spark, monkeypatch):
    """10,000 points within reach of each other, and two dense clumps that are just too far apart."""
    rows = spark.range(10_000).select("id", F.lit("g").alias("g"), (F.lit(-8.0) + (F.col("id") % 100) * 1e-6).alias("lon"), (F.lit(53.5) + F.floor(F.col("id") / 100) * 1e-6).alias("lat"))
    apart = rows.select((F.col("id") + 20_000).alias("id"), "g", "lon", (F.col("lat") + 0.0105).alias("lat"))
    made = []
    real = spatial.kept

    def counted(df, name="step"):
        out = real(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(spatial, "kept", counted)
    found = spatial.clusters(rows.unionByName(apart), "g", "id", 1000).groupBy("cluster").count().collect()
    assert {(r["cluster"], r["count"]) for r in found} == {(0, 10_000), (20_000, 10_000)}
    assert sum(n for name, n in made if name in ("boxes", "near", "links")) < 20_000


def test_register_by_many_tasks(spark, tmp_path):
    """Byte ranges of a file give the rows and line numbers of a reader that goes through it from the start."""
    rng = random.Random(3)
    header = list(files.REGISTER_HEADER)
    address = lambda: "".join(rng.choice(("a", "É", " ", "\r\n", "\n", '"', ",", "x" * 40, '""', "")) for _ in range(rng.randint(0, 9)))
    rows = [["01/02/2020", address(), "Cork", "", "€1.00", "No", "Yes", address(), ""][: 9 if i % 37 else 8] for i in range(400)]
    text = io.StringIO()
    writer = csv.writer(text, lineterminator="\r\n")
    writer.writerow(header)
    for i, row in enumerate(rows):
        writer.writerow(row)
        text.write("\r\n" * (i % 50 == 7))  # blank lines between records
    data = text.getvalue().encode("cp1252")
    (tmp_path / "r.csv").write_bytes(data)
    reader = csv.reader(io.StringIO(data.decode("cp1252"), newline=""))
    want = [(reader.line_num, [f.replace("\r\n", "\n") for f in r]) for r in reader if r][1:]
    for most in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            found = files.register(spark, str(tmp_path / "r.csv"))
            tasks = spark.read.text(str(tmp_path / "r.csv"), lineSep="\n").rdd.getNumPartitions()
            rows_found = sorted((r["line_no"], r["n_fields"], [r[c] for c in files.RAW]) for r in found.collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert (tasks > 10) == (most == "1k")
        assert [(n, k) for n, k, _ in rows_found] == [(n, len(r)) for n, r in want]
        assert [r for _, k, r in rows_found if k == 9] == [r for _, r in want if len(r) == 9]


def test_trigram_index(spark, tmp_path):
    rng = random.Random(2)
    streets = ("Main Street", "Church Road", "St. Brígid's Park", "O'Neill_2 Avenue", "Abbey")
    rows = [(i, f"{i % 40} {rng.choice(streets)}, Town_{i % 12}, Co. X{i % 5}".lower()) for i in range(1200)]
    table = spark.createDataFrame(rows, "property_id long, normalised string")
    index = trigram.TrigramIndex.build(table, str(tmp_path / "index"), group_rows=1000)
    for text in ("main st", "church rd town_1", "brígid", "neill_2 ave", "_2", "x4", "39 abbey", "no such", "", "town"):
        want = [tuple(r) for r in search.autocomplete_addresses(table, text).collect()]
        assert [tuple(r) for r in index.lookup(text).select("property_id", "normalised", "score").collect()] == want, text
    asked = index.candidates(["abbey", "town_11"])
    assert asked.count() < 60 and "PushedFilters: [In(trigram" in asked._jdf.queryExecution().toString()


def test_needed_pieces():
    assert trigram.needed(["abcd"]) == ["abc", "bcd"]
    assert trigram.needed(["neill_2"]) == ["  2", "eil", "ill", "ll ", "nei"]
    assert trigram.needed(["a", "7b"]) == []


def test_view_state_expires(spark, tmp_path):
    """With a view of another user a day later, nothing is left of the first user's state but that of the last view."""
    from lintel.streaming import jobs

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    start = 1_700_000_000
    shape = "event_id long, s long, user_id long, event_type string, value double, props string"
    parts = [[(i, start + i * 60, i % 5, "view", 0.0, "") for i in range(50)], [(100, start + 86_400, 9, "view", 0.0, "")], [(101, start + 90_000, 9, "view", 0.0, "")]]
    for n, rows in enumerate(parts):
        made = spark.createDataFrame(rows, shape).select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")
        made.coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = jobs.counted_views(jobs.events(spark, f"{tmp_path}/in/*"), 600)
    query = jobs.to_table(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert max(left) >= 5 and left[-1] < max(left)
    found = {r["event_id"]: r["kept"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    last, want = {}, {}
    for rows in parts:
        for e, s, u, *_ in rows:
            want[e] = u not in last or s - last[u] > 600
            last[u] = s if want[e] else last[u]
    assert found == want


def test_rates_of_a_checked_file(spark, tmp_path):
    from lintel.functions import finance

    def held(*lines):
        path = tmp_path / f"rates{len(list(tmp_path.iterdir()))}.json"
        path.write_text("\n".join(lines))
        return finance.read_rates(spark, str(path))

    one = '{"applies_from": "2003-01-01", "applies_to": null, "dwelling": "any", "rate": "0.135"}'
    two = '{"applies_from": "2025-10-08", "applies_to": "2030-12-31", "dwelling": "qualifying_apartment", "rate": "0.09"}'
    assert sorted(map(str, held(one, "", two).collect())) == sorted(map(str, finance.vat_table(spark).collect()))
    sales = spark.createDataFrame([(1, "2026-01-01", "qualifying_apartment"), (2, "2026-01-01", "any"), (3, "1999-01-01", "any")], "row_id int, sale_date string, dwelling string").withColumn("sale_date", F.col("sale_date").cast("date"))
    rates = {r["row_id"]: r["rate"] and float(r["rate"]) for r in finance.with_vat_rate(sales, spark, held(one, two)).collect()}
    assert rates == {1: 0.09, 2: 0.135, 3: None}
    wrong = (two, "not json", one.replace("0.135", "1.35"), one.replace("0.135", "x"), one.replace("2003-01-01", "soon"), one.replace("null", '"2001-01-01"'), one.replace('"any"', '"all"'), one.replace("}", ', "note": 1}'), '{"applies_from": "2003-01-01", "dwelling": "any"}')
    for line in wrong:
        with pytest.raises(finance.RatesError):
            held(*([one] if line != two else []), line).collect()


def read_tile(data):
    """A tile by the format's definition: {layer: [(id, {key: value}, (x, y))]}."""

    def varint(at):
        n = shift = 0
        while True:
            n, shift, more = n | (data[at] & 127) << shift, shift + 7, data[at] >> 7
            at += 1
            if not more:
                return n, at

    def parts(at, end):
        while at < end:
            key, at = varint(at)
            if key & 7 == 2:
                size, at = varint(at)
                yield key >> 3, (at, at + size)
                at += size
            else:
                n, at = varint(at)
                yield key >> 3, n

    def numbers(span):
        at, out = span[0], []
        while at < span[1]:
            n, at = varint(at)
            out.append(n)
        return out

    out = {}
    for number, span in parts(0, len(data)):
        assert number == 3
        fields = [*parts(*span)]
        of = lambda n: [v for k, v in fields if k == n]  # noqa: B023, E731
        (name,) = (data[a:b].decode() for a, b in of(1))
        keys, values = [data[a:b].decode() for a, b in of(3)], [dict(parts(*v))[5] for v in of(4)]
        assert of(15) == [2] and of(5) == [4096]
        found = []
        for feature in of(2):
            f = dict(parts(*feature))
            tags, (command, x, y) = numbers(f[2]), numbers(f[4])
            assert f[3] == 1 and command == 9
            found.append((f[1], {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2], strict=True)}, (x >> 1, y >> 1)))
        out[name] = found
    return out


def test_tiles_read_back(spark):
    from lintel.operators import vector_tiles

    rng = random.Random(5)
    rows = [(i * 977, rng.uniform(-10, -6), rng.uniform(51.5, 55.4), rng.choice((0, 127, 128, 350_000, 2**31, None)), i % 3) for i in range(300)] + [(2**33, 0.0, 0.0, 5, 1)]
    points = spark.createDataFrame(rows, "id long, lon double, lat double, price long, kind int")
    got = {(r["x"], r["y"]): (r["n"], read_tile(bytes(r["tile"]))["sales"]) for r in vector_tiles.tiles(points, 7, "sales", "id", ("price", "kind")).collect()}
    want = {}
    for i, lon, lat, price, kind in sorted(rows):
        a, d = (lon / 360 + 0.5) * 128, (0.5 - math.log(math.tan(math.radians(lat) / 2 + math.pi / 4)) / (2 * math.pi)) * 128
        tags = {k: v for k, v in (("price", price), ("kind", kind)) if v is not None}
        want.setdefault((int(a), int(d)), []).append((i, tags, (int((a - int(a)) * 4096), int((d - int(d)) * 4096))))
    near = lambda p, q: all(abs(a - b) <= 1 for a, b in zip(p, q, strict=True))
    assert got.keys() == want.keys()
    for tile, features in want.items():
        assert got[tile][0] == len(features)
        for mine, theirs in zip(got[tile][1], features, strict=True):
            assert mine[:2] == theirs[:2] and near(mine[2], theirs[2])
    assert vector_tiles.tiles(points.limit(0), 7, "sales", "id", ("price",)).count() == 0


@pytest.mark.parametrize("most", [8])
def test_nearest_by_density(spark, monkeypatch, most):
    """A crowd some hundred metres wide, a lone far target, targets on one spot, and points among and far from them: as all pairs say, without making them."""
    rng = random.Random(most)
    spots = [(-8.0 + rng.gauss(0, 1e-3), 53.5 + rng.gauss(0, 1e-3), "a") for _ in range(400)] + [(-8.5, 52.0, "a")] * 30 + [(-9.9, 55.0, "b")] + [(-8 + rng.random(), 53 + rng.random(), "b") for _ in range(50)]
    targets = [(i, x, y, g) for i, (x, y, g) in enumerate(spots)]
    points = [(i, -8.0 + rng.gauss(0, 2e-3), 53.5 + rng.gauss(0, 2e-3)) for i in range(40)] + [(40 + i, -10 + 4 * rng.random(), 51.5 + 3.8 * rng.random()) for i in range(60)]
    made = []
    real = spatial.kept

    def counted(df, name="step"):
        out = real(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(spatial, "kept", counted)
    frame = lambda rows, shape: spark.createDataFrame(rows, shape)
    found = spatial.nearest_by_density(frame(points, "p long, lon double, lat double"), frame(targets, "t long, lon double, lat double, g string"), "p", "t", "g", most)
    want = {(p, g): min((math.floor(km((x, y), (u, v)) * 1000 + 0.5), t) for t, u, v, h in targets if h == g) for p, x, y in points for g in "ab"}
    assert {(r["p"], r["g"]): (r["m"], r["t"]) for r in found.collect()} == want
    assert max(n for name, n in made if name == "asked") < 200 * 12


def test_tiles_not_points_go_down_the_tree(spark, monkeypatch):
    """What is written level by level goes by tiles, and places that many points and targets share are looked up once."""
    rng = random.Random(3)
    spots = [(-8.0 + rng.gauss(0, 1e-3), 53.5 + rng.gauss(0, 1e-3)) for _ in range(2000)]
    targets = spark.createDataFrame([(i + 5000 * j, *s) for i, s in enumerate(spots) for j in (1, 0)], "t long, lon double, lat double")
    far = [(-10 + 4 * rng.random(), 51.5 + 3.8 * rng.random()) for _ in range(600)]
    points = spark.createDataFrame([(i + 1000 * j, *s) for i, s in enumerate(far) for j in range(5)] + [(9000, None, 53.0)], "p long, lon double, lat double")
    made = []
    real = spatial.kept

    def counted(df, name="step"):
        out = real(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(spatial, "kept", counted)
    found = {r["p"]: (r["m"], r["t"]) for r in spatial.nearest_by_density(points, targets, "p", "t", most=8).collect()}
    want = [min((math.floor(km(s, t) * 1000 + 0.5), i) for i, t in enumerate(spots)) for s in far]
    assert found == {i + 1000 * j: want[i] for i in range(600) for j in range(5)}
    assert max(n for name, n in made if name == "asked") < 3000  # a row a point would be 3000 a level


def test_rolling_windows_copy_counts_not_rows(spark):
    """Equal sales are counted before they go to areas; two windows asked for are those of all windows, and hold a count once each."""
    from lintel.operators import market as M
    from lintel.operators import statistics as S

    rows = [(i, i % 4, f"20{10 + i % 3}-{i // 3 % 12 + 1:02d}-03", (i % 7) * 1000 + 5, i % 2 == 0) for i in range(600)]
    sales = spark.createDataFrame(rows, "sale_id long, property_id long, sale_date string, cents long, is_new boolean")
    sales = sales.withColumn("sale_date", F.col("sale_date").cast("date"))
    for flag in ("withdrawn", "not_full_market", "possible_duplicate"):
        sales = sales.withColumn(flag, F.lit(False))
    sales = sales.withColumn("bulk_group_id", F.lit(None).cast("long"))
    places = spark.createDataFrame([(p, 1 + p % 2, 100 + p, 1000 + p if p else None, None, None) for p in range(4)], "property_id long, county_id long, settlement_id long, ed_id long, small_area_id long, townland_id long")
    monthly = M.monthly_counts(sales, places)
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    fanned = M.fan_out(sales, places).filter("detail").groupBy("area_id", "segment", F.trunc("sale_date", "MM").alias("m"), "cents").agg(F.count("*").alias("c"))
    assert rows_of(monthly) == rows_of(fanned)
    every = S.rolling(monthly, sales)
    end = F.lit("2012-12-01").cast("date")
    assert every.agg(F.max("period")).first()[0].isoformat() == "2012-12-01"
    two = S.rolling(monthly, sales, lags=(2, 14))
    want = rows_of(every.filter(F.col("period").isin(F.add_months(end, -2), F.add_months(end, -14))))
    assert want and rows_of(two) == want
    near = S.rolling(monthly, sales, lags=(0, 3))  # windows that overlap
    assert rows_of(near) == rows_of(every.filter(F.col("period").isin(end, F.add_months(end, -3))))


def test_points_placed_by_hand_are_dealt_out(spark):
    """Points of one small file meet the areas in many tasks; a point on the box or side of an area is in it."""
    from lintel.operators import geocode

    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 0.0)]
    polygons = spark.createDataFrame([(7, "settlement", ring), (8, "townland", ring)], "area_id long, kind string, ring array<struct<x: double, y: double>>")
    points = [(1, 0.0, 0.0), (2, 10.0, 5.0), (3, 5.0, 5.0), (4, 5.0, 6.0), (5, 11.0, 5.0), (6, 8.0, 1.0)]
    manual = spark.createDataFrame([(*p, True) for p in points], "property_id long, x double, y double, precise boolean").coalesce(1)
    found = geocode.rejoined(manual, polygons, 4)
    assert {r["property_id"]: r["settlement_id"] for r in found.collect()} == {1: 7, 2: 7, 3: 7, 4: None, 5: None, 6: 7}
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()


def test_identifiers_are_made_for_properties_not_sales(spark):
    from lintel.functions import text as T
    from lintel.operators import register as R

    staged = spark.range(60).select(F.col("id").alias("line_no"), F.lit("2020-01-01").cast("date").alias("sale_date"), F.lit("cork").alias("county"), F.concat(F.lit("k"), F.col("id") % 3).alias("key"), F.when(F.col("id") % 2 == 0, "flat 1").alias("unit"))
    staged = staged.withColumns({c: F.lit("x") for c in ("display", "normalised", "house_number", "district", "eircode")})
    want = staged.select("key", "unit", T.public_id(F.col("county"), F.col("key"), F.col("unit")).alias("public_id")).distinct()
    rows_of = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows_of(R.properties_of(staged).select("key", "unit", "public_id")) == rows_of(want) and want.count() == 6


def test_keys_of_views_share_state(spark, tmp_path):
    """Forty users in two buckets and three micro-batches: state is held once a bucket, null users are a key of their own, and each key is judged alone."""
    from lintel.streaming import jobs

    start, shape = 1_700_000_000, "event_id long, s long, user_id long, event_type string, value double, props string"
    parts = [[(n * 200 + i, start + n * 400 + i * 7 % 400, i % 40 if i % 40 else None, "viewed"[: 4 + i % 2], 0.0, "") for i in range(200)] for n in range(3)]
    for n, rows in enumerate(parts):
        made = spark.createDataFrame(rows, shape).select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")
        made.coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    query = jobs.to_table(jobs.counted_views(jobs.events(spark, f"{tmp_path}/in/*"), 300, buckets=2), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 2 * 3
    last, want = {}, {}
    for rows in parts:
        for e, s, *key in sorted((r[:4] for r in rows), key=lambda r: (r[1], r[0])):
            want[e] = tuple(key) not in last or s - last[tuple(key)] > 300
            last[tuple(key)] = s if want[e] else last[tuple(key)]
    assert {r["event_id"]: r["kept"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_files_of_a_table_need_no_order(spark, sf_dir, tmp_path):
    """Files that end on the same day: none of their rows is late."""
    from lintel.plans import catalogue

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for n in range(2):
        events.filter(F.col("event_id") % 2 == n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    rows_of = lambda name, path: sorted(map(tuple, catalogue.QUERIES[name](spark, str(path)).collect()))
    for name in ("stream_views", "stream_tumbling"):
        assert rows_of(name, tmp_path) == rows_of(name, sf_dir)
    assert len(rows_of("stream_views", tmp_path)) == events.count()


def test_equal_addresses_are_looked_up_once(spark, monkeypatch):
    """Ninety addresses that ask three things: their words are worked out for three, and each address gets its answer."""
    from lintel.operators import geocode

    features = spark.createDataFrame(
        [(1, "carlow", "place", "Tullow", None, -6.74, 52.80, 1.5), (3, "carlow", "street", "Church St", None, -6.741, 52.801, 0.0), (5, "carlow", "address", "Church Street", "12", -6.7412, 52.8012, 0.0)],
        "feature_id long, county string, kind string, name string, house_number string, lon double, lat double, radius_km double",
    )
    asked = (["12 Church St", "Tullow"], ["Church Street", "Tullow"], ["Nowhere", "Tullow"])
    addresses = spark.createDataFrame([(k, "carlow", asked[k % 3]) for k in range(90)], "property_id long, county string, parts array<string>")
    sizes, kept = {}, geocode.kept

    def counted(df, name="step"):
        out = kept(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(geocode, "kept", counted)
    found = {r["property_id"]: (r["feature_id"], r["level"]) for r in geocode.local_match(addresses, features).collect()}
    assert found == {k: ((5, 0), (3, 1))[k % 3] for k in range(90) if k % 3 < 2}
    assert sizes["asked"] == 6
    wanted = addresses.select(F.col("property_id").alias("wanted_id"), "county", F.when(F.col("property_id") % 2 == 0, "Tullow").alias("name"))
    names = geocode.unique_names(features.filter("kind <> 'address'").select("feature_id", "county", "name"), wanted)
    assert sorted(map(tuple, names.collect())) == [(k, 1) for k in range(0, 90, 2)]


def test_addresses_of_sales_are_read_once(spark, monkeypatch):
    """Texts of addresses are worked out once an address; sales at addresses that name no dwelling, or none, stay apart."""
    from lintel.operators import register as R

    places = ("12 Main St, Cork", "Apt 3, 12 Main St., Cork", "The Glebe, Dublin 6", "14 Oak Rd, Dublin 6", "14 Oak Road, Dublin 6", "", None)
    codes = ("D6W XY45", "", "D04 AB12", "none")
    rows = [(i, f"{i % 9 + 1:02}/03/2020", places[i % 7], "Cork" if i % 7 < 2 else "Dublin", codes[i % 4], "€100.00" if i % 3 else "bad", "No", "No", "New x", "") for i in range(210)]
    raw = spark.createDataFrame(rows, "line_no long, raw_date string, raw_address string, raw_county string, raw_eircode string, raw_price string, raw_nfmp string, raw_vat string, raw_description string, raw_size string")
    parsed, sizes, kept = R.parse(raw, ("cork", "dublin")), {}, R.kept

    def counted(df, name="step"):
        out = kept(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(R, "kept", counted)
    found = R.properties_filed(parsed, ("cork", "dublin"))
    want = R.properties_of(R.stage(parsed.filter("error is null"), ("cork", "dublin")))
    rows_of = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert found.columns == want.columns and rows_of(found) == rows_of(want)
    assert sizes == {"parsed": 210, "addresses": 7, "vague": 3} and found.filter("key like '%~%'").count() > 3


def test_narrow_ranges_are_ordered_and_apart(spark):
    edges = sorted({s * (2**b + d) for b in range(0, 62) for d in (-1, 0, 1) for s in (1, -1)})
    for bits in (1, 6, 12):
        rows = spark.createDataFrame([(v,) for v in edges], "v long").select("v", Q.narrow_range_of(F.col("v"), F.lit(bits)).alias("r")).orderBy("v").collect()
        assert all(a["r"] <= b["r"] and a["r"] <= a["v"] for a, b in zip(rows, rows[1:], strict=False))
        assert all(a["v"] - a["r"] <= max(0, abs(a["v"]) >> bits) + 1 for a in rows)


def shuffled_rows(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_prices_that_never_repeat_are_not_copied_to_windows(spark):
    """Every price went to the twelve windows of its month before any window was looked at. Gaps, negative and missing prices and months are in."""
    from lintel.operators import statistics as S

    rng = random.Random(8)
    rows = [(a, "all", f"20{10 + m // 12}-{m % 12 + 1:02d}-01", rng.randint(10**6, 10**8), rng.randint(1, 2)) for a, n in ((0, 30_000), (1, 300), (2, 7)) for m in (rng.choice((*range(20), 40)) for _ in range(n))]
    rows += [(2, "all", "2011-02-01", None, 3), (2, "all", None, 5, 9), (3, "new", "2010-05-01", None, 6), (4, "new", "2010-05-01", -70, 5), (4, "new", "2010-04-01", -71, 1), (4, "new", "2010-04-01", -71, 1)]
    monthly = spark.createDataFrame(rows, "area_id long, segment string, m string, cents long, c long").withColumn("m", F.col("m").cast("date"))
    sales = spark.createDataFrame([("2013-06-20",)], "sale_date string").withColumn("sale_date", F.col("sale_date").cast("date"))
    before = shuffled_rows(spark)
    found = {(r["area_id"], r["segment"], r["period"].isoformat()): tuple(r)[3:8] for r in S.rolling(monthly, sales).collect()}
    assert shuffled_rows(spark) - before < 3 * len(rows)
    groups = {}
    for a, g, m, cents, c in rows:
        for i in range(12) if m else ():
            at = int(m[:4]) * 12 + int(m[5:7]) - 1 + i
            if at <= 2013 * 12 + 5:
                groups.setdefault((a, g, f"{at // 12}-{at % 12 + 1:02d}-01"), []).extend([cents] * c)

    def at(v, p):
        low, high = v[math.floor(p * (len(v) - 1))], v[math.ceil(p * (len(v) - 1))]
        return math.floor(low + (high - low) * (p * (len(v) - 1) % 1) + 0.5)

    def figures(v):
        held = sorted(x for x in v if x is not None)
        if len(v) < 5 or not held:
            return (len(v), None, None, None, None)
        return (len(v), *(at(held, p) for p in (0.5, 0.25, 0.75)), int((2 * sum(held) + len(v)) / (2 * len(v))) if sum(held) < 0 else (2 * sum(held) + len(v)) // (2 * len(v)))

    assert found == {k: figures(v) for k, v in groups.items()}
