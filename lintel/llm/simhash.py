"""Operator 10, SimHash near-dedup: pigeonhole blocks of fingerprints, joined and verified by Hamming distance.

Fingerprints (one 64-bit number a document) come from word shingles. Four blocks of 16 bits: two fingerprints that
differ in at most two bits agree in at least two whole blocks, so each distinct fingerprint is listed under its six
pairs of blocks and only fingerprints that share such a 32-bit key are compared.

A key with more than ``max_block`` distinct fingerprints (a large group of near copies) is not compared pair by pair.
Its members list themselves under the 65 numbers that differ from them in at most one bit: two fingerprints are
within two bits exactly if such lists meet, and all that meet in one number are within two bits of each other, so
each is linked to the smallest one. That is linear in the group and loses no link.

``near_pairs`` is the form for whole texts (``keep_one`` with ``least``): the same links, of fingerprints of five-word shingles, and besides them
links by a wider bit bound and a verified Jaccard similarity. Two bits alone miss most pairs at 0.8; such texts differ in about 10 of 64 bits, where no blocks of a SimHash are both shared and selective, so its blocks are
25 hashes of five minima each over the same shingle hashes: a pair at 0.8 shares one with probability 0.99995, a more similar pair
with a higher one. Pairs of a block within ``NEAR_BITS`` bits are verified on the whole shingle sets. Equal sets are one node.

Large groups of copies with edits of their own would make pairs by the square. So each node is first compared with the most
central member of its blocks (that whose blocks have the most members, the likely source of the copies); what that connects isn't
compared again, and blocks of a single connected part are done. The nodes of the other blocks meet through prefixes, which lose no link:
with shingles in order of rarity, the first one that two sets share has places i and j, and they share at most
min(m - i, n - j) of their m and n shingles. Only shingles whose places leave enough for the bound are listed, and for a copy with too many
edits of its own those are the edited ones, which few others hold.

Defined cases: null text counts as empty; texts without words have fingerprint zero and link like any other; texts of
one or two words hash the whole sequence. Identifiers may be of any type that can be ordered; rows that repeat one are rows of their
own, and a component's name is its smallest non-null identifier (null if there is no other). ``keep_one`` keeps one row of each component: that with the
smallest non-null identifier, then the smallest digest of identifier and text; of rows equal in both, one. Other columns pass through
``keep_one`` whatever their names and are not read elsewhere. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, free_name, in_filter, row_key

SEED, MAX_BITS, MAX_BLOCK = 42, 2, 64
#: Whole texts: words of a shingle, least Jaccard similarity, and a bit bound over 5 standard deviations above what texts at 0.8 differ in.
NEAR_WIDTH, NEAR_LEAST, NEAR_BITS = 5, 0.8, 28
BANDS, MINIMA = 25, 5
_CHUNK = 1 << 14


def _hashes(text: bytes | None, width: int, seed: int):
    """Arrays of the big-endian octets of the shingle hashes, chunk by chunk; none of a text without words."""
    words = (text or b"").lower().split()  # bytes.lower and bytes.split know ASCII only
    if not words:
        return
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = list(zip(starts, ends[width - 1 :], strict=False)) or [(0, len(joined))]
    digest = xxhash.xxh64_digest
    for at in range(0, len(spans), _CHUNK):
        part = spans[at : at + _CHUNK]
        yield np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in part]), np.uint8).reshape(-1, 8)


def _majority(chunks) -> int:
    total, n = np.zeros(64, np.int64), 0
    for octets in chunks:
        total += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.uint16)
        n += len(octets)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big", signed=True)


def fingerprint(text: bytes | None, width: int = 3, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of the word shingles; a bit is set if it is set in over half of the shingle hashes."""
    return _majority(_hashes(text, width, seed))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.col(f"`{text_col}`").cast("string").alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, row_key, fp) of every row."""

    def hashed(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([fingerprint(t.as_py(), width) for t in texts], pa.int64())], ["doc_id", "row_key", "fp"])

    docs = _rows(docs, id_col, text_col)
    return docs.mapInArrow(hashed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key binary, fp long")


def _block_keys(fp: Column) -> Column:
    """The six pairs of 16-bit blocks, each as pair number * 2**32 + the 32 bits."""
    block = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    return F.array(*[F.lit(k << 32) + F.shiftleft(block[i], 16) + block[j] for k, (i, j) in enumerate(combinations(range(4), 2))])


def _flips(fp: Column) -> Column:
    """All numbers that differ from fp in at most one bit."""
    masks = [0, *(1 << i for i in range(63)), -(1 << 63)]
    return F.array(*[fp.bitwiseXOR(F.lit(m)) for m in masks])


def links(distinct: DataFrame, scratch: Scratch, max_block: int = MAX_BLOCK) -> DataFrame:
    """Edges (a, b), a < b, between the distinct fingerprints in column fp: enough to join all that are within two bits."""
    listed = distinct.select(F.explode(_block_keys(F.col("fp"))).alias("key"), "fp")
    sizes = scratch.keep(listed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "blocks")
    members = scratch.keep(listed.join(sizes, "key"), "members")
    scratch.drop(sizes)
    small, large = members.filter(F.col("n") <= max_block), members.filter(F.col("n") > max_block)
    pairs = (
        small.select("key", F.col("fp").alias("a"))
        .join(small.select("key", F.col("fp").alias("b")), "key")
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
        .select("a", "b")
    )
    near = large.select("fp").distinct().select("fp", F.explode(_flips(F.col("fp"))).alias("key"))
    least = scratch.keep(near.groupBy("key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("key", "a"), "least")
    stars = near.join(least, "key").filter((F.col("a") < F.col("fp")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= MAX_BITS))
    edges = scratch.keep(pairs.unionByName(stars.select("a", F.col("fp").alias("b"))).distinct(), "links")
    scratch.drop(members, least)
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_block: int = MAX_BLOCK) -> DataFrame:
    """(doc_id, row_key, fp, component_id, component) for every row; component_id is the smallest doc_id reachable over links, component its number."""
    scratch = Scratch(docs.sparkSession, "simhash")
    hashed = scratch.keep(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = scratch.keep(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = links(distinct, scratch, max_block)
    labels = components(edges, scratch)
    scratch.drop(edges)
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    tops = scratch.keep(named.groupBy("label").agg(F.min("least").alias("component_id")), "tops")
    final = scratch.keep(named.join(tops, "label").select("fp", "component_id", F.col("label").alias("component")), "final")
    scratch.drop(distinct, labels, tops)
    return hashed.join(final, "fp").select("doc_id", "row_key", "fp", "component_id", "component")


def _odd(n: int, salt: int) -> np.ndarray:
    return np.random.default_rng(salt).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def shingled(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, row_key, node, fp, shingles, keys) of every row: node names the set of shingle hashes, keys are its blocks."""
    factors, mixers, salts = _odd(BANDS * MINIMA, 1), _odd(BANDS * MINIMA, 2), _odd(BANDS, 3)

    def blocks(found: np.ndarray) -> np.ndarray:
        least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(found), 1024):
            np.minimum(least, (found[at : at + 1024, None] * factors).min(axis=0), out=least)
        return (least * mixers).reshape(BANDS, MINIMA).sum(axis=1, dtype=np.uint64) * salts + salts

    def hashed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                nodes, fps, sets, keys = [], [], [], []
                for text in part.column(2).cast(pa.binary()):
                    chunks = list(_hashes(text.as_py(), width, SEED))
                    found = np.unique(np.concatenate([c.view(">u8").ravel() for c in chunks]).astype(np.uint64)) if chunks else np.empty(0, np.uint64)
                    nodes.append(int.from_bytes(xxhash.xxh64_digest(found.tobytes(), SEED), "big", signed=True))
                    fps.append(_majority(chunks))
                    sets.append(found.view(np.int64))
                    keys.append(blocks(found).view(np.int64) if len(found) else np.empty(0, np.int64))
                lists = [pa.array(x, pa.list_(pa.int64())) for x in (sets, keys)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), *lists], ["doc_id", "row_key", "node", "fp", "shingles", "keys"])

    docs = _rows(docs, id_col, text_col)
    return docs.mapInArrow(hashed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key binary, node long, fp long, shingles array<long>, keys array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, least: float, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of ``least`` or more."""
    both = pairs.distinct().join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return scratch.keep(both.filter(shared >= F.lit(least) * (F.size("x") + F.size("y") - shared) - F.lit(1e-9)).select("a", "b"), f"{name}-edges")


def print_links(hashed: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between the nodes whose fingerprints are equal or within two bits, by ``links``: enough to join all of them."""
    prints = scratch.keep(hashed.select("fp", "node").distinct(), "prints")
    first = scratch.keep(prints.groupBy("fp").agg(F.min("node").alias("first")), "first")
    edges = links(first.select("fp"), scratch)
    end = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}"))
    met = edges.join(end("a"), "a").join(end("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    equal = prints.join(first, "fp").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return scratch.keep(met.unionByName(equal), "print-links")


def near_pairs(hashed: DataFrame, scratch: Scratch, least: float = NEAR_LEAST, max_bits: int = NEAR_BITS) -> DataFrame:
    """(node, label) of the nodes that have a near copy: label is the smallest node reachable over links by fingerprint or by verified similarity."""
    listed = hashed.select("node", "fp", F.size("shingles").alias("m"), F.explode("keys").alias("key")).distinct()
    blocks = scratch.keep(listed.groupBy("key").agg(F.count("*").alias("n"), F.min("m").alias("smallest")).filter("n > 1"), "blocks")
    members = scratch.keep(listed.join(blocks, "key"), "members")
    nodes = scratch.keep(members.groupBy("node").agg(F.sum("n").alias("weight"), F.min("smallest").alias("smallest")), "nodes")
    held = in_filter(hashed.select("node", "shingles"), nodes, F.col("node"), F.col("node"))
    sets = scratch.keep(held.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    share = least / (1 + least)  # two sets of m and n shingles are similar if they have share * (m + n) in common
    enough = lambda shared, m, n: shared >= F.lit(share) * (m + n) - F.lit(1e-6)
    close = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= max_bits

    weighed = members.join(nodes.select("node", "weight"), "node")
    tops = scratch.keep(weighed.groupBy("key").agg(F.max(F.struct("weight", "node", "fp", "m")).alias("top")), "tops")
    first = members.join(tops, "key").groupBy("node", "fp", "m").agg(F.max("top").alias("top"))
    first = first.filter((F.col("top.node") != F.col("node")) & close(F.col("top.fp"), F.col("fp")) & enough(F.least("m", "top.m"), F.col("m"), F.col("top.m")))
    stars = _verified(first.select(F.least("top.node", "node").alias("a"), F.greatest("top.node", "node").alias("b")), sets, least, scratch, "stars")
    labels = components(stars, scratch)
    named = scratch.keep(members.join(labels, "node", "left").select("key", "node", "fp", "m", F.coalesce("label", "node").alias("label")), "named")
    open_blocks = scratch.keep(named.groupBy("key").agg((F.min("label") != F.max("label")).alias("open")).filter("open").select("key"), "open")
    left = scratch.keep(named.join(open_blocks, "key", "left_semi").select("node", "fp", "m", "label").distinct().join(nodes.select("node", "smallest"), "node"), "left")

    tokens = scratch.keep(sets.join(left.select("node"), "node", "left_semi").select("node", F.explode("shingles").alias("s")), "tokens")
    common = scratch.keep(tokens.groupBy("s").agg(F.count("*").alias("n")).filter("n > 1"), "common")
    ranked = tokens.join(common, "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("order")).join(left, "node")
    # shingles that no other node holds come first and are not listed
    prefix = ranked.select("node", "fp", "m", "label", "smallest", (F.col("m") - F.size("order")).alias("alone"), F.posexplode("order").alias("at", "x"))
    prefix = prefix.withColumn("rest", F.col("m") - F.col("alone") - F.col("at")).filter(enough(F.col("rest"), F.col("m"), F.greatest(F.col("smallest"), F.ceil(F.lit(least) * F.col("m") - F.lit(1e-6)))))
    prefix = scratch.keep(prefix.select(F.col("x.s").alias("s"), "node", "fp", "m", "label", "rest"), "prefix")
    a, b = (prefix.select(*(F.col(c).alias(f"{c}_{x}") for c in prefix.columns)) for x in "xy")
    meet = (F.col("label_x") < F.col("label_y")) & close(F.col("fp_x"), F.col("fp_y")) & enough(F.least("rest_x", "rest_y"), F.col("m_x"), F.col("m_y"))
    met = a.join(b, (F.col("s_x") == F.col("s_y")) & meet)
    rest = _verified(met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")), sets, least, scratch, "rest")
    near = stars.unionByName(rest).unionByName(print_links(hashed, scratch))
    out = components(scratch.keep(near, "links"), scratch)
    scratch.drop(blocks, members, nodes, sets, tops, stars, labels, named, open_blocks, left, tokens, common, prefix, rest)
    return out


def near_copies(docs: DataFrame, least: float = NEAR_LEAST, id_col: str = "doc_id", text_col: str = "text", width: int = NEAR_WIDTH, max_bits: int = NEAR_BITS) -> DataFrame:
    """(doc_id, row_key, component_id) for every row; component_id is the smallest doc_id reachable over pairs within two bits or of Jaccard ``least`` or more."""
    scratch = Scratch(docs.sparkSession, "near")
    hashed = scratch.keep(shingled(docs, id_col, text_col, width), "shingles")
    labels = near_pairs(hashed, scratch, least, max_bits)
    named = hashed.select("doc_id", "row_key", "node").join(labels, "node", "left").select("doc_id", "row_key", F.coalesce("label", "node").alias("label"))
    named = scratch.keep(named, "named")
    scratch.drop(hashed, labels)
    tops = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return named.join(tops, "label").select("doc_id", "row_key", "component_id", F.col("label").alias("component"))


def keep_one(docs: DataFrame, least: float | None = None, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One row of ``docs`` for each component: of ``near_copies`` where ``least`` is given, else of ``near_duplicates``."""
    found = near_duplicates(docs, id_col, text_col, **more) if least is None else near_copies(docs, least, id_col, text_col, **more)
    own, key = free_name("_kept", docs.columns), free_name("_key", docs.columns)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first"))
    kept = first.select(F.col("first.row_key").alias(own))
    rows = docs.withColumn(key, row_key(id_col, text_col))
    return rows.join(kept, F.col(key) == F.col(own), "left_semi").dropDuplicates([key]).drop(key)
