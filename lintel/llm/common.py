"""Helpers shared by the text operators: tables, scratch tables, samples and components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.sources.scratch import root_of

#: A bit map's least and most bits; the most are 16 MB, the largest that is ever sent to every task.
LEAST_BITS, MOST_BITS, BITS_A_KEY = 1 << 15, 1 << 27, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text_col: str) -> Column:
    """16 bytes that stand for a row's identifier, of any type, and text; missing values count as values of their own."""
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(mark(id_col), F.lit("\0"), mark(text_col))))


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with as many ``_`` behind it as it takes to clash with none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Parquet tables in the shared folder that cut lineage and survive lost executors.

    ``keep`` writes a frame and returns it as read back; ``drop`` removes a table that nothing needs any more.
    Whatever the returned result still reads stays until the session's end, when the folder goes.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{root_of(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)  # noqa: SLF001
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)  # noqa: SLF001

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, name: str = "t", **options: str) -> DataFrame:
        path = self.path(name)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lintel_path = path  # noqa: SLF001
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()  # noqa: SLF001
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._lintel_path)  # noqa: SLF001
            path.getFileSystem(conf).delete(path, True)


def bounded_sample(df: DataFrame, key: str, limit: int, salt: str = "sample") -> DataFrame:
    """At most ``limit`` rows, chosen by a hash of ``key``: the same rows on every run. Used only to fit classifiers.

    The hash is cut into 1024 ranges, whose rows are counted; ranges are taken in order as long as they fit, so the bound holds
    without gathering the sample in one task. Where every range is too large, the smallest is cut again.
    """
    at, low, bits, rows = F.xxhash64(F.lit(salt), key).bitwiseAND(F.lit((1 << 60) - 1)), 0, 60, df
    while bits:
        bits -= 10
        part = F.shiftright(at - low, bits)
        counts = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # 1024 rows at most
        if bits == 50 and sum(counts.values()) <= limit:
            return df
        chosen, held = [], 0
        for k in sorted(counts):
            if held + counts[k] <= limit:
                chosen, held = [*chosen, k], held + counts[k]
        if chosen:
            return rows.filter(part.isin(chosen))
        least = min(counts, key=lambda k: (counts[k], k))
        low += least << bits
        rows = rows.filter(part == least)
    return rows.limit(limit)  # a single key with more rows than that


def quotas(totals: dict, limit: int) -> dict:
    """Shares of ``limit`` for groups of the given sizes: small groups whole, what they leave in equal parts to the others."""
    out, left = {}, limit
    for i, k in enumerate(sorted(totals, key=lambda k: (totals[k], str(k)))):
        out[k] = min(totals[k], left // (len(totals) - i))
        left -= out[k]
    return out


def stratified_sample(df: DataFrame, key: str, stratum: str, limit: int, salt: str = "sample") -> tuple[DataFrame, dict]:
    """(at most ``limit`` rows, the share taken of each value of ``stratum``): rare values are taken whole before common ones share what is left.

    Rows of a value are chosen by a hash of ``key``, the same ones on every run. One count of 1024 ranges a value comes to the driver.
    """
    part = F.shiftright(F.xxhash64(F.lit(salt), key).bitwiseAND(F.lit((1 << 60) - 1)), 50)
    counts: dict = {}
    for r in df.groupBy(F.col(stratum).alias("s"), part.alias("part")).agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["s"], {})[r["part"]] = r["n"]
    totals = {s: sum(c.values()) for s, c in counts.items()}
    shares, cuts, alone = quotas(totals, limit), {}, []
    taken = {}
    for s, ranges in counts.items():
        held, cuts[s] = 0, 0
        for k in sorted(ranges):
            if held + ranges[k] > shares[s]:
                break
            held, cuts[s] = held + ranges[k], k + 1
        if shares[s] == totals[s]:
            cuts[s] = 1024
        elif not held and shares[s]:
            alone.append(s)
        taken[s] = held / totals[s]
    if not cuts:
        return df, {}
    bound = F.lit(0)
    for s, cut in cuts.items():
        bound = F.when(F.col(stratum).eqNullSafe(F.lit(s)), F.lit(cut)).otherwise(bound)
    out = df.filter(part < bound)
    for s in alone:  # a value whose first range is over its share already: a single hot key, say
        more = bounded_sample(df.filter(F.col(stratum).eqNullSafe(F.lit(s))), key, shares[s], salt)
        out, taken[s] = out.unionByName(more), shares[s] / totals[s]
    return out, taken


def flagged(rows: DataFrame, wanted: DataFrame, key: Column, wanted_key: Column, flag: str, bits: int | None = None) -> DataFrame:
    """``rows`` with the boolean ``flag``: whether the key may be one of ``wanted``. Only a bit map is sent, bits / 32768 rows of 4 KB.

    The map has 16 bits a wanted row, counted, and 16 MB at most; the fuller it is, the more rows are flagged for nothing.
    """
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * max(wanted.count(), 1) - 1).bit_length()))
    at, part, bit, bitmap = (free_name(n, rows.columns) for n in ("_at", "_part", "_bit", "_map"))
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(bits)) + 1
    held = wanted.select(place(wanted_key).alias(at)).groupBy(F.expr(f"bitmap_bucket_number({at})").alias(part)).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({at}))").alias(bitmap))
    rows = rows.withColumn(at, place(key)).withColumn(part, F.expr(f"bitmap_bucket_number({at})")).withColumn(bit, F.expr(f"bitmap_bit_position({at})"))
    byte = F.conv(F.hex(F.expr(f"substring({bitmap}, cast({bit} div 8 + 1 as int), 1)")), 16, 10).cast("int")
    known = F.coalesce(F.getbit(byte, F.expr(f"cast({bit} % 8 as int)")) == 1, F.lit(False))
    return rows.join(F.broadcast(held), part, "left").withColumn(flag, known).drop(part, bitmap, at, bit)


def in_filter(rows: DataFrame, wanted: DataFrame, key: Column, wanted_key: Column, bits: int | None = None) -> DataFrame:
    """The ``rows`` that ``flagged`` lets through. It only spares the others the shuffle of the join that follows."""
    flag = free_name("_flag", rows.columns)
    return flagged(rows, wanted, key, wanted_key, flag, bits).filter(F.col(flag)).drop(flag)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b): one row (node, label), the label being the smallest node.

    Labels spread over edges and are then shortened through the label's own label, so the rounds grow with the
    logarithm of a component's width. Each round is a written table: both sides of every join are plain exchanges,
    which adaptive execution can split when a hub has many edges.
    """
    both = scratch.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        met = scratch.keep(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "met")
        far = met.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = scratch.keep(met.join(far, "label").select("node", "old", F.least("label", "top").alias("label")), "labels")
        scratch.drop(met, labels)
        labels = new
        if labels.filter("old <> label").isEmpty():
            scratch.drop(both)
            return _as_labels(labels)


def _as_labels(labels: DataFrame) -> DataFrame:
    out = labels.select("node", "label")
    out._lintel_path = labels._lintel_path  # noqa: SLF001
    return out
