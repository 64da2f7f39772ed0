"""Operator 8, exact dedup: a log-structured merge index of text digests, written as Spark jobs.

* memtable: each task of a flush keeps the best row of every digest it meets, up to ``memtable_rows`` digests;
* flush: a full memtable leaves as a run sorted by digest; the runs of a flush are one segment of level 0, a Parquet table;
* compaction: when a level holds ``fanout`` segments (and at the end, when all do) their runs are merged by digest into one
  segment of the next level. Spark deals the runs by digest and merge-sorts them, and tasks walk the sorted rows once: of equal
  digests the row with the most code points, then the smallest identifier, stays, and the counts add up;
* filters: every segment has a bit map of its digests, and the merged one also a map of the digests with several rows. ``probe`` asks
  a segment's map first, and only rows that it may hold are joined with the segment;
* hits (digests with more than one row) receive byte verification: over all texts of such a digest the smallest and
  the largest normalised bytes must be equal. Where they are not (a digest collision), the group is split by bytes.

A row that the map of repeated digests doesn't know is alone: it keeps itself without meeting the index, and its text never travels.
Maps have 16 bits a counted digest, up to 16 MB; a fuller map only lets more rows travel.

Defined cases: null counts as empty; white space is every character of ``[\\x20\\x09-\\x0D]``; of rows that tie in length and
identifier, all count in group_size and rows with the kept identifier are all marked kept. Identifiers may be of any type that
can be ordered; a null one never wins over another one. Other columns of the input are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, flagged, in_filter

MEMTABLE_ROWS, FANOUT = 50_000, 8
SPACES = " \t\n\x0b\x0c\r"


def normalised(text_col: str) -> Column:
    return F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), SPACES, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """(doc_id, points, digest, sha256) of every row. ``digest_bytes`` shortens the index key (tests use it to force collisions)."""
    points = F.char_length(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).cast("long")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), points.alias("points"), F.unhex(F.sha2(normalised(text_col), 256)).alias("sha256"))
    return rows.select("doc_id", "points", F.substring("sha256", 1, digest_bytes).alias("digest"), "sha256")


def better(old: tuple, new: tuple) -> tuple:
    """Of two (points, doc_id) rows the one that stays; a missing identifier loses to any other of the same length."""
    if old[0] != new[0] or new[1] is None or old[1] is None:
        return old if (old[0], old[1] is not None) >= (new[0], new[1] is not None) else new
    return old if old[1] <= new[1] else new


def _runs(most: int):
    """Memtables of (digest, points, doc_id, n) rows: sorted runs of at most ``most`` digests each."""

    def run_of(table: dict, number: int, schema: pa.Schema) -> pa.RecordBatch:
        keys = sorted(table)
        columns = [[number] * len(keys), keys, *([table[k][i] for k in keys] for i in range(3))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def memtables(batches):
        table, number, schema = {}, 0, None
        for batch in batches:
            schema = schema or pa.schema([("run", pa.int64()), *batch.schema])
            for key, points, doc, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                old = table.get(key)
                table[key] = (points, doc, n) if old is None else (*better(old[:2], (points, doc)), old[2] + n)
                if len(table) >= most:
                    yield run_of(table, number, schema)
                    table, number = {}, number + 1
        if table:
            yield run_of(table, number, schema)

    return memtables


def _merge(batches):
    """One row a digest of rows sorted by digest; holds one digest's best row, whatever the length of its group."""
    held = None
    for batch in batches:
        out = []
        for key, points, doc, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is not None and held[0] == key:
                held = (key, *better(held[1:3], (points, doc)), held[3] + n)
            else:
                out += [held] if held is not None else []
                held = key, points, doc, n
        schema = batch.schema
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held[i]], f.type) for i, f in enumerate(schema)], schema=schema)


class MergeIndex:
    """Segments of digest runs in the shared folder, by level. ``add`` flushes rows and compacts full levels; ``merged`` gives one segment."""

    def __init__(self, spark: SparkSession, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT, bits: int | None = None) -> None:
        self.scratch, self.memtable_rows, self.fanout, self.bits = Scratch(spark, "merge-index"), memtable_rows, fanout, bits
        self.levels: list[list[DataFrame]] = [[]]

    def add(self, rows: DataFrame) -> None:
        """Flushes (doc_id, points, digest) rows as a segment of level 0; full levels move down."""
        rows = rows.select("digest", "points", "doc_id", F.lit(1).cast("long").alias("n"))
        shape = f"run long, digest binary, points long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long"
        self.levels[0].append(self.scratch.keep(rows.mapInArrow(_runs(self.memtable_rows), shape), "level0"))
        for depth in range(len(self.levels)):
            if len(self.levels[depth]) >= self.fanout:
                self._compact(depth, depth + 1)

    def _compact(self, first: int, into: int) -> None:
        """Merges all segments of the levels from ``first`` up to ``into`` (not included) into one of level ``into``."""
        old = [s for level in self.levels[first:into] for s in level]
        rows = old[0].select("digest", "points", "doc_id", "n")
        for more in old[1:]:
            rows = rows.unionByName(more.select("digest", "points", "doc_id", "n"))
        # the runs of a hot digest have one row of it each, so its task reads a row a run and not a row a text
        sorted_rows = rows.repartition("digest").sortWithinPartitions("digest")
        segment = self.scratch.keep(sorted_rows.mapInArrow(_merge, rows.schema), f"level{into}")
        self.scratch.drop(*old)
        self.levels += [[]] * (into + 1 - len(self.levels))
        self.levels = [level if not first <= i < into else [] for i, level in enumerate(self.levels)]
        self.levels[into] = [*self.levels[into], segment]

    def merged(self) -> DataFrame:
        """All segments as one: a row a digest (digest, points, doc_id, n), the smallest identifier of the longest rows kept."""
        if sum(map(len, self.levels)) != 1 or self.levels[0]:
            self._compact(0, len(self.levels))
        return self.levels[-1][0]

    def probe(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with a column digest) that the index holds, with keep_id and n; a segment meets only the rows that its filter lets through."""
        found = None
        for segment in (s for level in self.levels for s in level):
            asked = in_filter(rows, segment.select("digest"), F.col("digest"), F.col("digest"), self.bits)
            hit = asked.join(segment.select("digest", F.col("doc_id").alias("_keep"), "points", "n").withColumnsRenamed({"points": "_points", "n": "_n"}), "digest")
            found = hit if found is None else found.unionByName(hit)
        return found.withColumnsRenamed({"_keep": "keep_id", "_points": "keep_points", "_n": "held"})


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = MEMTABLE_ROWS, digest_bytes: int = 32, filter_bits: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, sha256) for every row."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows = scratch.keep(digests(docs, id_col, text_col, digest_bytes), "digests")
    lsm = MergeIndex(docs.sparkSession, memtable_rows)
    lsm.add(rows)
    repeated = scratch.keep(lsm.merged().filter("n > 1").select("digest", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size")), "repeated")

    text = normalised(text_col)
    points = F.char_length(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).cast("long")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), points.alias("points"), F.encode(text, "UTF-8").alias("bytes"), F.unhex(F.substring(F.sha2(text, 256), 1, 2 * digest_bytes)).alias("digest"))
    texts = in_filter(texts, repeated, F.col("digest"), F.col("digest"), filter_bits)
    differ = scratch.keep(texts.groupBy("digest").agg(F.min("bytes").alias("low"), F.max("bytes").alias("high")).filter("low <> high").select("digest"), "differ")

    asked = flagged(rows, repeated, F.col("digest"), F.col("digest"), "maybe", filter_bits)
    alone = asked.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha256", "digest")
    met = asked.filter("maybe").join(repeated, "digest", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    same = alone.unionByName(met.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), "sha256", "digest"))
    if not differ.isEmpty():  # a digest that stands for several texts: its rows are grouped by the bytes themselves
        split = texts.join(differ, "digest").withColumn("sha256", F.unhex(F.sha2("bytes", 256)))
        longest = split.groupBy("digest", "bytes").agg(F.max("points").alias("most"), F.count("*").alias("group_size"))
        longest = split.join(longest, ["digest", "bytes"]).groupBy("digest", "bytes").agg(F.min(F.when(F.col("points") == F.col("most"), F.col("doc_id"))).alias("keep_id"), F.first("group_size").alias("group_size"))
        resolved = split.join(longest, ["digest", "bytes"]).select("doc_id", "keep_id", "group_size", "sha256", "digest")
        same = same.join(differ, "digest", "left_anti").unionByName(resolved)
    return same.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha256")).alias("sha256"))
