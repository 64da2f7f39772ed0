"""An inverted index of addresses by trigram: postings sorted by trigram in the shared folder, rarest trigrams met first.

A text that is typed asks for the pieces that any address with its words must have. Their postings are found by Parquet's own ranges,
as the table is sorted; the rarest ones are intersected, and only addresses that have all of them are read and compared.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators.search import like_literal, query_words, similarity, trigrams

#: Trigrams that are intersected, and identifiers that are sent to the scan of addresses as a list.
RAREST, LISTED = 4, 1_000


def needed(words: list[str]) -> list[str]:
    """The trigrams of every address that holds the words somewhere: those inside each run of letters and digits, and its ends where another
    character of the word follows or comes before."""
    out: list[str] = []
    for word in words:
        runs = list(re.finditer(r"[^\W_]+", word))
        for run in runs:
            padded = f"{'  ' if run.start() else ''}{run.group()}{' ' if run.end() < len(word) else ''}"
            out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return sorted(set(out))


class TrigramIndex:
    """``postings`` (trigram, property_id), ``counts`` (trigram, n) and ``addresses`` (property_id, normalised), each sorted by its first column."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        read = lambda name, shape: spark.read.schema(shape).parquet(f"{path}/{name}")
        self.postings = read("postings", "trigram string, property_id long")
        self.counts = read("counts", "trigram string, n long")
        self.addresses = read("addresses", "property_id long, normalised string")

    @classmethod
    def build(cls, normalised: DataFrame, path: str, group_rows: int = 1 << 16) -> TrigramIndex:
        """Writes the index of (property_id, normalised). Common trigrams take many row groups, rare ones share one."""
        rows = normalised.select(F.col("property_id").cast("long").alias("property_id"), "normalised")
        pairs = rows.select(F.explode(trigrams(F.col("normalised"))).alias("trigram"), "property_id")
        options = {"parquet.block.row.count.limit": str(group_rows)}
        # a hot trigram is many ranges of identifiers
        pairs.repartitionByRange("trigram", "property_id").sortWithinPartitions("trigram", "property_id").write.options(**options).parquet(f"{path}/postings")
        spark = normalised.sparkSession
        counts = spark.read.parquet(f"{path}/postings").groupBy("trigram").agg(F.count("*").alias("n"))
        counts.repartitionByRange("trigram").sortWithinPartitions("trigram").write.parquet(f"{path}/counts")
        rows.repartitionByRange("property_id").sortWithinPartitions("property_id").write.options(**options).parquet(f"{path}/addresses")
        return cls(spark, path)

    def candidates(self, words: list[str]) -> DataFrame | None:
        """(property_id) that have the rarest pieces of the words; none if they are too short to have any, a table without rows if a piece is unknown."""
        pieces = needed(words)
        if not pieces:
            return None
        known = {r["trigram"]: r["n"] for r in self.counts.filter(F.col("trigram").isin(pieces)).collect()}  # as many as the text has pieces
        if len(known) < len(pieces):
            return self.postings.select("property_id").limit(0)
        rarest = sorted(known, key=lambda t: (known[t], t))[:RAREST]
        met = self.postings.filter(F.col("trigram").isin(rarest)).groupBy("property_id").agg(F.count("*").alias("n"))
        return met.filter(F.col("n") == len(rarest)).select("property_id")

    def lookup(self, text: str, size: int = 8) -> DataFrame:
        """(property_id, normalised, score): addresses that hold every word of the text (short forms spelt out), the most similar first."""
        words = query_words(text)
        rows = self.addresses
        if sum(map(len, words)) < 3:
            return rows.limit(0).withColumn("score", F.lit(0).cast("long"))
        found = self.candidates(words)
        if found is not None:
            ids = [r["property_id"] for r in found.limit(LISTED + 1).collect()]
            # few are read by the identifiers' ranges; many meet the table as a join
            rows = rows.filter(F.col("property_id").isin(ids)) if len(ids) <= LISTED else rows.join(found, "property_id", "left_semi")
        for w in words:
            rows = rows.filter(F.col("normalised").ilike(f"%{like_literal(w)}%"))
        score = similarity(trigrams(F.col("normalised")), trigrams(F.lit(" ".join(words))))
        return rows.withColumn("score", score).orderBy(F.desc("score"), "normalised", "property_id").limit(size)
