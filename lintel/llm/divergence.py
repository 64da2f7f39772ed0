"""Operator 12, source divergence audit: how far the word shares of every two sources of a language are apart.

* counts: tasks count terms by (lang, source) in bounded tables before anything is shuffled, and Spark adds them up; terms in fewer than
  ``least_docs`` documents of their language go;
* vocabulary: a language's terms are dealt by a hash to chunks of about ``chunk_terms`` terms and numbered within them;
* packed vectors: the counts of a (lang, source, chunk) are two lists, places in the chunk and counts;
* tiles: the sources of a language are dealt to blocks of about ``block_groups`` sources. Each vector is sent to the tasks (its block, any
  block), and such a task computes the submatrix of its two blocks over one vocabulary chunk after the other: it holds one chunk of two
  blocks and the sums of their pairs, whatever the size of the vocabulary.

A hot source is one vector like any other once its terms are counted. Shares are whole billionths: 1 + floor(10^9 (count + 5) / (N + 5 V)),
found digit by digit, so that nothing overflows below 9 * 10^15 counted terms.

Defined cases: null text, lang and source count as ''; rows are documents, also where their identifiers repeat; terms are
``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; groups without a kept term take part with the share of a term that they lack; a language
without a kept term has pairs of value 0. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

LEAST_DOCS, CHUNK_TERMS, BLOCK_GROUPS, TOP, TABLE_ROWS = 30, 4096, 64, 50, 200_000
#: Of bytes: letters lower-cased, whatever no term has as blanks.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _counted(batches):
    """(lang, source, term, n, docs) of the terms of (lang, source, text) rows, from tables of bounded size; a row with a null term for every group."""
    names = ("lang", "source", "term", "n", "docs")

    def rows_of(tables: dict):
        for (lang, source), (total, docs) in tables.items():
            terms = [None, *total]
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array([t if t is None else t.decode() for t in terms], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([0, *total.values()], pa.int64()), pa.array([0, *(docs[t] for t in total)], pa.int64())], names)

    tables, held = {}, 0
    for batch in batches:
        for lang, source, text in zip(*batch.columns, strict=True):
            total, docs = tables.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            held -= len(total)
            terms = text.as_buffer().to_pybytes().translate(TERM_BYTES).split()
            total.update(terms)
            docs.update(set(terms))
            held += len(total)
            if held >= TABLE_ROWS:
                yield from rows_of(tables)
                tables, held = {}, 0
    yield from rows_of(tables)


def counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs) of all terms; a row with a null term for every (lang, source)."""
    word = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    rows = docs.select(word(lang_col, "lang"), word(source_col, "source"), word(text_col, "text"))
    found = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)) of three columns, three digits at a time."""
    rest, below, out = f"({count} + 5L)", f"({total} + 5L * {terms})", "0L"
    for _ in range(3):
        out, rest = f"({out} * 1000L + ({rest} * 1000L) div {below})", f"(({rest} * 1000L) % {below})"
    return F.expr(f"{out} + 1L")


def shares(count: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The same over arrays: ``below`` is total + 5 terms."""
    rest, out = count + 5, np.zeros(np.broadcast_shapes(count.shape, below.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


def _tile(batches, low: int, high: int):
    """Values of all pairs of two blocks' sources, over chunks that come one after the other. A block may be empty.

    Rows are (source, block, total, terms, chunk, size, at, n): first, with chunk -1, one for each source, then its vectors by chunk. The
    submatrix is of the lower block's sources by the higher one's; of one block with itself, it has all pairs.
    """
    sides: tuple[list, list] | None = None
    heads: list[tuple] = []
    sums = below = None
    terms = done = 0
    dense: dict[int, np.ndarray] = {}
    current, width = -1, 0

    def begin():
        rows = [[i for i, h in enumerate(heads) if h[1] == b] for b in (low, high)]
        return (rows, np.zeros((len(rows[0]), len(rows[1])), np.int64), np.array([h[2] for h in heads], np.int64) + 5 * terms)

    def add():
        """One chunk: sources without a vector have no count there."""
        if not sums.size:
            return
        none = np.zeros(width, np.int64)
        left, right = (np.stack([shares(dense.get(i, none), below[i]) for i in side]) for side in sides)
        for i in range(len(left)):
            sums[i] += np.abs(right - left[i]).sum(axis=1)

    for batch in batches:
        for source, block, total, v, chunk, size, at, n in zip(*batch.columns, strict=True):
            if chunk.as_py() < 0:
                heads.append((source.as_py(), block.as_py(), total.as_py()))
                terms = v.as_py()
                continue
            if sides is None:
                sides, sums, below = begin()
                number = {h[0]: i for i, h in enumerate(heads)}
            if chunk.as_py() != current:
                if dense:
                    add()
                    done += width
                current, width, dense = chunk.as_py(), size.as_py(), {}
            vector = np.zeros(width, np.int64)
            vector[at.values.to_numpy()] = n.values.to_numpy()
            dense[number[source.as_py()]] = vector
    if sides is None:
        sides, sums, below = begin()
    if dense:
        add()
        done += width
    if terms > done and sums.size:  # chunks that no source of the two blocks has a term of
        none = np.zeros(1, np.int64)
        flat = [np.array([shares(none, below[i])[0] for i in side]) for side in sides]
        sums += np.abs(flat[0][:, None] - flat[1][None, :]) * (terms - done)
    names = [h[0] for h in heads]
    for row, i in enumerate(sides[0]):
        items = [names[j] for j in sides[1]]
        yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(items), pa.string()), pa.array(items, pa.string()), pa.array(sums[row], pa.int64())], ["source", "item", "value"])


class Audit:
    """The tables of one audit. ``pairs`` and ``terms`` give the two parts of the result."""

    def __init__(self, docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, chunk_terms: int = CHUNK_TERMS, block_groups: int = BLOCK_GROUPS) -> None:
        self.scratch = scratch = Scratch(docs.sparkSession, "divergence")
        self.block_groups = block_groups
        found = scratch.keep(counts(docs, lang_col, source_col, text_col), "counts")
        by_term = found.filter("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least_docs)
        kept = scratch.keep(by_term, "kept")
        langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
        chunk = F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / F.lit(chunk_terms))).cast("int")
        place = Window.partitionBy("lang", "chunk")
        dealt = kept.join(langs, "lang").withColumn("chunk", chunk).repartition("lang", "chunk")  # else a language's chunks stay in one task
        numbered = dealt.select("lang", "term", "lang_n", "chunk", (F.row_number().over(place.orderBy("term")) - 1).alias("at"), F.count("*").over(place).cast("int").alias("size"))
        self.vocabulary = scratch.keep(numbered, "vocabulary")
        #: (lang, source, term, n, lang_n, chunk, at, size) of kept terms that a group has
        self.held = scratch.keep(found.filter("term is not null").select("lang", "source", "term", "n").join(self.vocabulary, ["lang", "term"]), "held")
        totals = self.held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = found.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        #: (lang, source, total, terms, lang_total) of every group
        self.groups = scratch.keep(groups.select("lang", "source", zero("total"), zero("terms"), zero("lang_total")), "groups")
        scratch.drop(found, kept)

    def vectors(self) -> DataFrame:
        """(lang, source, chunk, size, at, n): packed counts, places ascending. A row has at most a chunk's terms."""
        packed = F.sort_array(F.collect_list(F.struct("at", "n")))
        rows = self.held.groupBy("lang", "source", "chunk", "size").agg(packed.alias("packed"))
        return rows.select("lang", "source", "chunk", "size", F.col("packed.at").alias("at"), F.col("packed.n").alias("n"))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value) of every ordered pair of a language's sources."""
        many = self.groups.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(self.block_groups)).cast("int").alias("blocks"))
        placed = self.groups.join(many, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
        empty = (F.lit(-1).alias("chunk"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("at"), F.array().cast("array<long>").alias("n"))
        heads = placed.select("lang", "source", "block", "blocks", "total", "terms", *empty)
        vectors = self.vectors().join(placed.select("lang", "source", "block", "blocks", "total", "terms"), ["lang", "source"]).select(*heads.columns)
        sent = heads.unionByName(vectors).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sent = sent.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        # sorted by chunk, a task's rows are read as a stream
        sent = sent.repartition("lang", "low", "high").sortWithinPartitions("lang", "low", "high", "chunk")
        rows = sent.select("lang", "low", "high", "source", "block", "total", "terms", "chunk", "size", "at", "n").mapInArrow(_tiles, "lang string, low int, high int, source string, item string, value long")
        same, other = F.col("source") == F.col("item"), F.col("low") < F.col("high")
        turned = rows.filter(other).select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
        return rows.filter(~same).select("lang", "source", "item", "value").unionByName(turned)

    def terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank): the terms whose share most exceeds the language's, ``top`` of each group."""
        rows = self.held.join(self.groups, ["lang", "source"])
        over = share("n", "total", "terms") - share("lang_n", "lang_total", "terms")
        rows = rows.select("lang", "source", F.col("term").alias("item"), over.alias("value")).filter("value > 0")
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return rows.withColumn("rank", rank).filter(F.col("rank") <= top)


def _tiles(batches):
    """``_tile`` for each (lang, low, high) of sorted rows, one after the other."""
    held = {"key": None, "next": None}
    source = iter(batches)

    def runs():
        for batch in source:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            first = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[first]:
                    yield keys[first], batch.slice(first, i - first)
                    first = i

    stream = runs()

    def of_key(key, first):
        part = first
        while part is not None:
            yield pa.RecordBatch.from_arrays(part.columns[3:], part.schema.names[3:])
            more = next(stream, None)
            if more is None or more[0] != key:
                held["next"] = more
                return
            part = more[1]

    held["next"] = next(stream, None)
    while held["next"] is not None:
        key, part = held["next"]
        held["next"] = None
        for out in _tile(of_key(key, part), key[1], key[2]):
            keys = [pa.array([k] * out.num_rows, kind) for k, kind in zip(key, (pa.string(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*keys, *out.columns], ["lang", "low", "high", *out.schema.names])


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, chunk_terms: int = CHUNK_TERMS, block_groups: int = BLOCK_GROUPS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources by distance, and the terms that stand out most."""
    audit = Audit(docs, lang_col, source_col, text_col, least_docs, chunk_terms, block_groups)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = audit.pairs().withColumn("rank", rank).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(audit.terms(top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
