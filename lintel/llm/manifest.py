"""Operator 13, a Merkle manifest of a dataset: a proof for every row that it belongs to the dataset's root.

A row's leaf is a digest of its fields. The leaves of a source, by identifier, are a tree whose inner nodes are digests of ``fanout``
consecutive nodes; the roots of the sources, by name, are the leaves of one more tree.

Superblock reduction: the nodes of a tree are dealt to buckets by index div fanout^levels; a task collapses ``levels`` levels of a bucket to
its root, and the roots of the buckets are the nodes of the next round, until one is left in each tree. On the way back each round's
nodes meet the proof of their bucket's root and put it behind their own, lower, proof. The last such step is that of the leaves. A bucket
has at most fanout^levels nodes (4096), however hot a source is, and each round has that many times fewer nodes.

Indices come from a range partition by (source, identifier, leaf), counts of its parts and their prefix sums, so that no source is
numbered in one task.

A proof is the siblings' digests (32 bytes each) from the lowest level to the root, from left to right, with the node's place
among its run and the number of siblings of each level. ``folded`` computes the root that a leaf and a proof lead to.

Defined cases: null fields are marked as such; a null identifier comes before all others, a null source before all others; rows with
equal identifiers are ordered by their leaves, equal rows count as often as they occur. A single row is its source's root, a single source
the dataset's. Identifiers may be of any type that can be ordered and read back from text. Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

FANOUT, LEVELS = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "proof binary, places array<int>, widths array<int>"


def digest(*parts: Column) -> Column:
    """SHA-256 in lowercase hex of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """The digest of fields: each its length in UTF-8 bytes, a colon and its value, or a dash where it is null."""
    said = [f.cast("string") for f in fields]
    return digest(*(F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in said))


def numbered(rows: DataFrame, scratch: Scratch, tree: str, *order: str) -> DataFrame:
    """``rows`` with the column ``at``, from 0 in each ``tree`` by ``order``, and ``total``, the tree's rows. Ties are in any, but one, order."""
    ranged = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("_row", F.monotonically_increasing_id())
    ranged = scratch.keep(ranged.withColumn("_part", F.shiftright("_row", 33)), "ranged")  # one file a part: its order is fixed from here on
    parts = ranged.groupBy(tree, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    of_tree = Window.partitionBy(tree)  # a row a part
    before = F.coalesce(F.sum("_n").over(of_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = scratch.keep(parts.select(tree, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(of_tree).alias("total")), "parts")
    same = [ranged[tree].eqNullSafe(parts[tree]), ranged["_part"] == parts["_part"]]
    return ranged.join(parts, same).select(*(ranged[c] for c in ranged.columns if c not in ("_row", "_part")), (ranged["_row"] + parts["_shift"]).alias("at"), parts["total"])


class Collapse:
    """The levels of one bucket: hex digests by level, from its nodes (by index) to its root."""

    def __init__(self, nodes: list[bytes], total: int, fanout: int, levels: int) -> None:
        self.fanout, self.levels = fanout, [nodes]
        alone = total <= fanout**levels  # the only bucket of its tree: it ends with one node
        while len(self.levels) <= levels and (len(self.levels[-1]) > 1 or not alone):
            last = self.levels[-1]
            self.levels.append([hashlib.sha256(b"".join(last[i : i + fanout])).hexdigest().encode() for i in range(0, len(last), fanout)])

    @property
    def root(self) -> bytes:
        return self.levels[-1][0]

    def proofs(self, upper: tuple[bytes, list[int], list[int]]) -> tuple[list[bytes], list[list[int]], list[list[int]]]:
        """Of each node: packed siblings, places and widths up to the bucket's root, and then those of ``upper``."""
        packed = [[bytes.fromhex(d.decode()) for d in level] for level in self.levels[:-1]]
        above: list[tuple] = [upper]
        for level in reversed(packed):
            here = []
            for i, _ in enumerate(level):
                first = i // self.fanout * self.fanout
                run = level[first : first + self.fanout]
                up = above[i // self.fanout]
                here.append((b"".join((*run[: i - first], *run[i - first + 1 :], up[0])), [i - first, *up[1]], [len(run) - 1, *up[2]]))
            above = here
        return tuple(map(list, zip(*above, strict=True)))


class Forest:
    """Trees over (tree, at, total, node, ...) rows, reduced round by round to one root each."""

    def __init__(self, nodes: DataFrame, scratch: Scratch, fanout: int = FANOUT, levels: int = LEVELS) -> None:
        self.scratch, self.fanout, self.levels = scratch, fanout, levels
        self.rounds = [scratch.keep(nodes, "round")]
        done = []
        while True:
            roots = scratch.keep(self._roots(self.rounds[-1]), "roots")
            done.append(roots.filter("total <= 1"))
            more = roots.filter("total > 1")
            if more.isEmpty():
                break
            self.rounds.append(scratch.keep(more, "round"))
        #: (tree, node): the root of each tree
        self.roots = done[0].select("tree", "node")
        for one in done[1:]:
            self.roots = self.roots.unionByName(one.select("tree", "node"))

    @property
    def bucket(self) -> Column:
        return F.expr(f"at div {self.fanout**self.levels}")

    def _roots(self, nodes: DataFrame) -> DataFrame:
        """The buckets' roots as nodes of the next round: its index, and how many there are."""
        fanout, levels = self.fanout, self.levels

        def collapsed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("at")
            total = int(rows["total"].iloc[0])
            one = Collapse([n.encode() for n in rows["node"]], total, fanout, levels)
            return pd.DataFrame({"tree": rows["tree"].iloc[:1], "at": [key[1]], "total": [-(-total // fanout**levels)], "node": [one.root.decode()]})

        tree = nodes.schema["tree"].dataType.simpleString()
        return nodes.select("tree", "at", "total", "node", self.bucket.alias("bucket")).groupBy("tree", "bucket").applyInPandas(collapsed, f"tree {tree}, at long, total long, node string")

    def proofs(self, upper: DataFrame | None = None) -> DataFrame:
        """The first round's rows with proof, places and widths up to their tree's root, and from there those of ``upper`` (tree, proof, places, widths), if given."""
        if upper is None:
            upper = self.roots.select("tree", *(F.expr(f"cast({x} as {kind})").alias(name) for x, name, kind in (("''", "proof", "binary"), ("array()", "places", "array<int>"), ("array()", "widths", "array<int>"))))
        above = upper.select("tree", F.lit(0).cast("long").alias("bucket"), "proof", "places", "widths")
        for i in range(len(self.rounds) - 1, -1, -1):
            found = self._proved(self.rounds[i], above)
            if not i:
                return found
            ends = upper.join(self.rounds[i].select("tree").distinct().withColumnRenamed("tree", "_tree"), F.col("tree").eqNullSafe(F.col("_tree")), "left_anti")  # trees that end below
            ends = ends.select("tree", F.lit(0).cast("long").alias("bucket"), "proof", "places", "widths")
            above = self.scratch.keep(found.select("tree", F.col("at").alias("bucket"), "proof", "places", "widths").unionByName(ends), "above")
        raise AssertionError

    def _proved(self, nodes: DataFrame, above: DataFrame) -> DataFrame:
        fanout, levels = self.fanout, self.levels
        names = nodes.columns

        def proved(rows: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
            if rows.empty:  # a tree that has its root below this round
                return rows[names].assign(**{c: pd.Series(dtype=object) for c in ("proof", "places", "widths")})
            rows = rows.sort_values("at")
            one = Collapse([n.encode() for n in rows["node"]], int(rows["total"].iloc[0]), fanout, levels)
            proof, places, widths = one.proofs((bytes(up["proof"].iloc[0]), [*map(int, up["places"].iloc[0])], [*map(int, up["widths"].iloc[0])]))
            return rows[names].assign(proof=proof, places=places, widths=widths)

        # the key of a null tree is a value of its own in both
        key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
        left = nodes.withColumns({"_bucket": self.bucket, "_tree": key(F.col("tree"))}).groupBy("_tree", "_bucket")
        right = above.withColumn("_tree", key(F.col("tree"))).select("_tree", F.col("bucket").alias("_bucket"), "proof", "places", "widths").groupBy("_tree", "_bucket")
        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
        return left.cogroup(right).applyInPandas(proved, f"{shape}, {PROOF}")


def folded(node: Column, proof: Column, places: Column, widths: Column) -> Column:
    """The root (hex) that the node (hex) leads to with the proof's siblings."""
    siblings = lambda first, n: F.lower(F.hex(F.substring(proof, F.lit(32) * first + F.lit(1), F.lit(32) * n)))
    levels = F.arrays_zip(places.alias("place"), widths.alias("width"))
    start = F.struct(node.alias("node"), F.lit(0).alias("first"))
    step = lambda now, level: F.struct(
        digest(siblings(now["first"], level["place"]), now["node"], siblings(now["first"] + level["place"], level["width"] - level["place"])).alias("node"),
        (now["first"] + level["width"]).alias("first"),
    )
    return F.aggregate(levels, start, step)["node"]


def manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", fanout: int = FANOUT, levels: int = LEVELS, **also: Column) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof, places, widths) of every row, and the string columns ``also``, computed from the row.

    Fields are read once, for the leaves; what follows moves digests.
    """
    scratch = Scratch(rows.sparkSession, "manifest")
    col = lambda c: F.col(f"`{c}`")
    kind = rows.select(col(id_col)).schema[0].dataType
    # identifiers travel as they are ordered and, through tasks in Python, as text: a missing number is no number there
    leaves = rows.select(col(id_col).alias("_id"), col(source_col).cast("string").alias("tree"), leaf(*map(col, fields)).alias("node"), *(c.cast("string").alias(name) for name, c in also.items()))
    leaves = scratch.keep(leaves, "leaves")
    placed = numbered(leaves, scratch, "tree", "_id", "node")
    sources = Forest(placed.withColumn("_id", F.col("_id").cast("string")), scratch, fanout, levels)
    scratch.drop(leaves)
    top = numbered(scratch.keep(sources.roots.select(F.lit(0).alias("tree"), F.col("tree").alias("source"), "node"), "subroots"), scratch, "tree", "source")
    whole = Forest(top, scratch, fanout, levels)
    upper = whole.proofs().join(whole.roots.select("tree", F.col("node").alias("root")), "tree")
    upper = scratch.keep(upper.select(F.col("source").alias("_tree"), F.col("node").alias("subroot"), "root", "proof", "places", "widths"), "upper")
    found = sources.proofs(upper.select(F.col("_tree").alias("tree"), "proof", "places", "widths"))
    found = found.join(upper.select("_tree", "subroot", "root"), F.col("tree").eqNullSafe(F.col("_tree")))
    return found.select(F.col("_id").cast(kind).alias("doc_id"), F.col("tree").alias("source"), F.col("node").alias("leaf"), "subroot", "root", "proof", "places", "widths", *also)
