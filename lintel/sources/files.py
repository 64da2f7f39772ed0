"""Readers of the files that the engine takes in, each with its own checks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintel.operators.register import RAW

# The headers of the register, of the index file and of the deprivation file.
REGISTER_HEADER = ("Date of Sale (dd/mm/yyyy)", "Address", "County", "Eircode", "Price (€)", "Not Full Market Price", "VAT Exclusive", "Description of Property", "Property Size Description")
INDEX_COLUMNS = ("STATISTIC", "TLIST(M1)", "C02803V03373", "VALUE")
INDEX_STATISTIC = "HPM09C01"
SURVEY_BOUNDS = (400_000, 800_000, 500_000, 1_000_000)


#: Windows-1252 read as Latin-1: what its bytes 80 to 9F stand for.
_C1 = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_READ_AS, _MEANT = "".join(map(chr, _C1)), bytes(_C1).decode("cp1252")


def western(text: Column) -> Column:
    return F.translate(text, _READ_AS, _MEANT)


class HeaderMismatchError(ValueError):
    """The file's layout changed: stop rather than read it wrongly."""


def _header_of(spark: SparkSession, path: str) -> list[str]:
    row = spark.read.csv(path, encoding="iso-8859-1", header=False, quote='"', escape='"').limit(1)
    found = row.select(*(western(F.col(c)) for c in row.columns)).first()
    return list(found) if found else []


def _quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of scanned blocks with their place in the block, the quotes before them there, and how many lines up to them begin after an even number of quotes."""
    now, seq, quotes, evens = None, 0, 0, 0
    for batch in batches:
        out = []
        for file, block, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != now:
                now, seq, quotes, evens = (file, block), 0, 0, 0
            evens += quotes % 2 == 0
            n = line.count(b'"')
            out.append((seq, quotes, evens, n))
            seq, quotes = seq + 1, quotes + n
        more = [pa.array([r[i] for r in out], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], ["file", "block", "line", "seq", "before", "evens", "quotes"])


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, record) of text files whose quoted fields may hold line ends; ``line_no`` is that of a record's last line. Bytes are read as Latin-1.

    Any number of tasks scan a file, each a range of its bytes. Whether a line begins inside quotes follows from the number of quotes
    before it: those of its block, and those of the blocks before, which are added up block by block. So do line and record numbers.
    A record of one line is whole where it was read; only lines of longer records are brought together.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    placed = lines.mapInArrow(_quotes, "file string, block long, line binary, seq long, before long, evens long, quotes long")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    blocks = placed.groupBy("file", "block").agg(F.count("*").alias("lines"), F.sum("quotes").alias("all_quotes"), F.max("evens").alias("all_evens"))
    blocks = blocks.withColumns({"odd": upto("all_quotes") % 2 == 1, "lines_before": upto("lines")})
    blocks = blocks.withColumn("starts_before", upto(F.when(F.col("odd"), F.col("lines") - F.col("all_evens")).otherwise(F.col("all_evens")))).select("file", "block", "odd", "lines_before", "starts_before")
    met = placed.join(blocks, ["file", "block"]).withColumn("text", F.decode("line", "ISO-8859-1"))
    begins = (F.col("before") % 2 == 1) == F.col("odd")
    starts = F.when(F.col("odd"), F.col("seq") + 1 - F.col("evens")).otherwise(F.col("evens"))
    met = met.select("file", (F.col("lines_before") + F.col("seq") + 1).alias("line_no"), (F.col("starts_before") + starts).alias("nth"), (begins & (F.col("quotes") % 2 == 0)).alias("whole"), "text")
    several = met.filter("not whole").groupBy("file", "nth").agg(F.max("line_no").alias("line_no"), F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("s"))
    joined = several.select("file", "line_no", F.array_join("s.text", "\n").alias("record"))
    records = met.filter("whole").select("file", "line_no", F.col("text").alias("record")).unionByName(joined)
    return records.withColumn("record", F.regexp_replace("record", "\r(?=\n|$)", "")).filter("record <> ''")


def register(spark: SparkSession, path: str) -> DataFrame:
    """(nine raw fields, n_fields, line_no) of register files in Windows-1252, each read by many tasks. ``n_fields`` is for the check that follows."""
    header = _header_of(spark, path)
    if tuple(header) != REGISTER_HEADER:
        raise HeaderMismatchError(f"unexpected register header: {header!r}")
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "\0", "emptyValue": "", "multiLine": "true"}
    # commas outside quotes part fields; an empty field without quotes is empty too, and null only where the record ends before it
    commas = F.regexp_replace(F.regexp_replace("record", '"(?:[^"]|"")*+"', ""), "[^,]", "")
    rows = quoted_records(spark, path).filter("line_no > 1").select("line_no", (F.char_length(commas) + 1).alias("n_fields"), F.from_csv("record", ", ".join(f"{n} string" for n in RAW), options).alias("r"))
    field = lambda i, c: F.when(F.col("n_fields") > i, F.coalesce(western(F.col(f"r.{c}")), F.lit(""))).alias(c)
    return rows.select(*(field(i, c) for i, c in enumerate(RAW)), "n_fields", "line_no")


def wrong_widths(rows: DataFrame) -> DataFrame:
    """Rows that don't hold nine fields, for the quarantine."""
    return rows.filter("n_fields <> 9").select("line_no", F.concat_ws(",", *RAW).alias("raw_line"), F.concat(F.lit("expected 9 fields, got "), F.col("n_fields").cast("string")).alias("error"))


def unzipped(spark: SparkSession, path: str, only: str = ".csv") -> DataFrame:
    """(archive, name, content) of the members of zip files; files that aren't zips are passed on as they are."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                if not zipfile.is_zipfile(io.BytesIO(content)):
                    yield pd.DataFrame({"archive": [where], "name": [where.rsplit("/", 1)[-1]], "content": [content]})
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.lower().endswith(only):
                            yield pd.DataFrame({"archive": [where], "name": [name], "content": [z.read(name)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, name string, content binary")


def single_csv(spark: SparkSession, path: str) -> DataFrame:
    """The one CSV of a zip, or the bare file; several are an error."""
    found = unzipped(spark, path)
    n = F.count("*").over(Window.partitionBy("archive"))
    return found.withColumn("n", n).withColumn("content", F.when(F.col("n") == 1, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("several CSV files in "), "archive")))).drop("n")


def changed(spark: SparkSession, path: str, runs: DataFrame) -> DataFrame:
    """(path, sha256) of files whose digest is not that of a run that succeeded."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
    return files.join(runs.filter("status = 'succeeded'").select("sha256").distinct(), "sha256", "left_anti")


def price_index(spark: SparkSession, path: str) -> DataFrame:
    """(series, period, value) of one statistic of an index file; blank values are left out, a file without the columns or without values is an error."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    rows = rows.toDF(*(c.lstrip("﻿").strip('"') for c in rows.columns))
    if missing := [c for c in INDEX_COLUMNS if c not in rows.columns]:
        raise HeaderMismatchError(f"the index file lacks {missing}")
    month = F.col("`TLIST(M1)`")
    code = F.when(F.col("C02803V03373") == "-", "00").otherwise(F.col("C02803V03373"))
    found = rows.filter((F.col("STATISTIC") == INDEX_STATISTIC) & (F.trim(F.coalesce("VALUE", F.lit(""))) != ""))
    out = found.select(code.alias("series"), F.make_date(F.substring(month, 1, 4).cast("int"), F.substring(month, 5, 2).cast("int"), F.lit(1)).alias("period"), F.col("VALUE").cast("double").alias("value"))
    if out.isEmpty():
        raise ValueError("the index file has no values")
    return out


def thousands(text: Column) -> Column:
    """A number written with commas; null for a blank."""
    return F.nullif(F.trim(F.regexp_replace(text, ",", "")), F.lit("")).try_cast("double")


def ed_key(text: Column) -> Column:
    """Comparable identifier of a division: parts without leading zeros, in order."""
    return F.array_join(F.array_sort(F.transform(F.split(text, "/"), lambda p: F.regexp_replace(F.trim(p), "^0+", ""))), "/")


def deprivation(spark: SparkSession, path: str, divisions: DataFrame, encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """((guid, key, value, text) three rows a division, identifiers without a division). ``divisions``: division_id, guid."""
    rows = spark.read.csv(path, header=True, encoding=encoding, quote='"', escape='"')
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns)).withColumn("_key", ed_key(F.col("ED_ID_STR")))
    known = divisions.select(ed_key(F.col("division_id")).alias("_key"), "guid")
    one = lambda k, c, t=F.lit(None).cast("string"): F.struct(F.lit(k).alias("key"), thousands(F.col(c)).alias("value"), t.alias("text"))
    three = F.array(one("relative_index", "Index22_ED_std_rel_wt"), one("absolute_index", "Index22_ED_std_abs_wt"), one("category", "Index22_ED_rel_wt_cat", F.col("Index22_ED_rel_wt_lab")))
    found = rows.join(known, "_key").select("guid", F.explode(three).alias("r")).select("guid", "r.*")
    return found, rows.join(known, "_key", "left_anti").select("ED_ID_STR")


def survey(spark: SparkSession, path: str) -> DataFrame:
    """(ref, name, x, y) of surveyed estates; positions off the map are left out, and of a ref in several files the last file counts."""
    rows = spark.read.csv(path, header=True, encoding="iso-8859-1", quote='"', escape='"').withColumn("_file", F.input_file_name())
    x, y = thousands(F.col("`GIS X`")), thousands(F.col("`GIS Y`"))
    low_x, high_x, low_y, high_y = SURVEY_BOUNDS
    rows = rows.select(F.col("DRef").alias("ref"), F.trim(western(F.col("Development"))).alias("name"), x.alias("x"), y.alias("y"), "_file").filter((F.col("x") > low_x) & (F.col("x") < high_x) & (F.col("y") > low_y) & (F.col("y") < high_y))
    return rows.groupBy("ref").agg(F.max_by(F.struct("name", "x", "y"), "_file").alias("r")).select("ref", "r.*")


def timetable(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, name, lon, lat, ref) of the stops that any trip serves, from an unpacked timetable feed: one row a stop and kind of transport.

    Stop times are by far the largest file; they are cut to distinct (trip, stop) pairs before they meet trips and routes.
    """
    table = lambda name: spark.read.csv(f"{folder}/{name}.txt", header=True, quote='"', escape='"')
    trips = table("trips").select("trip_id", "route_id").join(table("routes").select("route_id", "route_type", "route_short_name"), "route_id")
    served = table("stop_times").select("trip_id", "stop_id").distinct().join(trips, "trip_id")
    kinds = served.groupBy("stop_id").agg(F.collect_set("route_type").alias("types"), F.bool_or(F.col("route_short_name") == "DART").alias("dart"))
    has = lambda t: F.array_contains("types", t)
    each = F.array_compact(F.array(F.when(has("3"), "bus_stop"), F.when(has("0"), "luas_stop"), F.when(F.col("dart"), "dart_station"), F.when(has("2") & ~F.col("dart"), "rail_station")))
    stops = table("stops").join(kinds, "stop_id").withColumn("kind", F.explode(each))
    return stops.select("kind", F.col("stop_name").alias("name"), F.col("stop_lon").cast("double").alias("lon"), F.col("stop_lat").cast("double").alias("lat"), F.concat_ws(":", "stop_id", "kind").alias("ref"))


def boundaries(spark: SparkSession, path: str) -> DataFrame:
    """(code, name, parent, rings) of a Parquet export of a boundary layer: shapes without geometry go, a missing code is an error."""
    rows = spark.read.parquet(path).filter("rings is not null")
    code = F.when(F.col("code").isNotNull(), F.col("code")).otherwise(F.raise_error(F.lit("a boundary has no code")))
    # a code in several rows: its first name and parent in order, and all its rings in order
    return rows.withColumn("code", code).groupBy("code").agg(F.min("name").alias("name"), F.min("parent").alias("parent"), F.flatten(F.array_sort(F.collect_list("rings"))).alias("rings"))
