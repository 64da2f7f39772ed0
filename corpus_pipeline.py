"""A corpus pipeline of five stages, each a text operator of ``lintel.llm`` over all that the stage before it kept.

1. language: documents whose language cannot be told (no letter, or a tie between two languages) go;
2. lines: lines that repeat an earlier line, or are one edit away from it, go from their texts;
3. near: of each group of near copies (SimHash of five-word shingles within two bits, or their Jaccard 0.8 or more) the document with the smallest doc_id stays;
4. mixing: rates that bring the expected domain token totals to their targets; each document stays as often as its rate says;
5. pieces: the texts as SentencePiece ids, with the digests of ids and decoded text.

All but the last return the columns of ``documents``; ``n_chars`` follows the text. The fourth stage returns a document
several times where its rate is above one. A missing text counts as empty and goes in the first stage. Rows that repeat or lack a
doc_id are rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm import language, lines, mixing, pieces, simhash
from lintel.llm.common import Scratch, table
from lintel.llm.queries import domains_of, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs.filter(~language.held_out()))
    return language.keep_known(docs, model).select(*COLUMNS)


def by_line(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(docs)
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, least=simhash.NEAR_LEAST).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, domains_of(table(spark, sf_dir, "labels"))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, tokenizer_path(spark, "piece_bpe_32k.model"))


STAGES = [("language", by_language), ("lines", by_line), ("near", near_copies), ("mixing", mixture), ("pieces", encoded)]

#: Learned classifiers and SentencePiece have no SQL form: ``tests/llm`` holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is written to the shared folder and read again by the next."""
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
