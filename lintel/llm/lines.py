"""Operator 1, line dedup: a deletion-neighbourhood join over lines, DataFrame operations only.

A line goes if an earlier line (smaller doc_id, then smaller position) is equal to it or, for lines of ``least`` characters
or more, within one edit (insert, delete or replace one character). Lines of white space only always stay.

Equal lines are grouped by digest. Then the neighbourhood of one deletion is emitted in three steps, each as hashed keys that are
joined with equal keys, so that a line of n characters costs about n * sqrt(n) instead of n * n:

1. halves: one edit leaves the first or the last half untouched. Every line lists the hashes of its two halves, for its own
   length L = n (role long) and for L = n + 1 (role short: the partner has one character more);
2. segments: where halves met, the other half is cut into about sqrt(n) segments and listed without one of them;
3. characters: where those met, the segment is listed without one of its characters, hashed with what surrounds it.

Role long: equal variants with the same deleted place differ in that one character, all members from each other: each is linked
to the earliest. Role short: the short line is each member with one character deleted: members are linked to it and it to the earliest
member. Each link is verified by the edit distance of the two segments. That is linear in a group's size and finds for each
line the earliest line within one edit.

Defined cases: null text stays null and has no lines; an empty text stays empty; a text of which every line goes becomes empty, its
row stays. Identifiers may be of any type that can be ordered; a null one counts as smallest. A place is (doc_id, digest of identifier and text, position),
so rows that repeat an identifier with other texts are rows of their own, in the order of their digests; rows equal in both share one
fate. Other columns pass through untouched whatever their names; where one is called line_count, exact_dropped or near_dropped, the new column
gets a ``_`` behind its name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, in_filter, row_key

LEAST = 20
_PLACE = ("doc_id", "row_key", "pos")


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row_key, pos, line) of every line."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def _halves(line: Column, n: Column) -> Column:
    """The four (role, half, key) of a line."""
    out = []
    for role in (0, 1):
        size = n + role
        half = F.floor(size / 2).cast("int")
        out.append(F.struct(F.lit(role).alias("role"), F.lit(0).alias("half"), F.xxhash64(F.lit(0), size, line.substr(F.lit(1), half)).alias("key")))
        out.append(F.struct(F.lit(role).alias("role"), F.lit(1).alias("half"), F.xxhash64(F.lit(1), size, line.substr(n - half + 1, half)).alias("key")))
    return F.array(*out)


def distinct_lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """One row a distinct line that is not blank: its first place, length and the keys of its halves (role 0 and 1, half 0 and 1)."""
    lines = split_lines(docs, id_col, text_col).filter(F.col("line").rlike(r"\S"))
    n = F.char_length("line")
    keys = F.when(n >= least, F.transform(_halves(F.col("line"), n), lambda x: x["key"]))
    rows = lines.select(*_PLACE, F.unhex(F.md5("line")).alias("digest"), *(F.get(keys, F.lit(i)).alias(f"k{i}") for i in range(4)))
    first = rows.groupBy("digest").agg(F.min(F.struct(*_PLACE)).alias("at"), *(F.first(f"k{i}").alias(f"k{i}") for i in range(4)))
    return first.select("at.*", *(f"k{i}" for i in range(4)))


def _met(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows whose key occurs in several lines, at least one of them in role long."""
    keys = scratch.keep(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("role").alias("least")).filter("n > 1 and least = 0").select("key"), f"{name}-keys")
    return rows.join(keys, "key")


def near_lines(docs: DataFrame, distinct: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """(row_key, pos) of the distinct lines that have an earlier line one edit away."""
    listed = distinct.filter("k0 is not null").select(
        *_PLACE, F.explode(F.array(*(F.struct(F.lit(i // 2).alias("role"), F.lit(i % 2).alias("half"), F.col(f"k{i}").alias("key")) for i in range(4)))).alias("x")
    )
    halves = scratch.keep(_met(listed.select(*_PLACE, "x.*"), scratch, "halves"), "halves")
    wanted = halves.groupBy(F.col("row_key").alias("_key")).agg(F.collect_list(F.struct("pos", "role", "half", "key")).alias("picks"))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = in_filter(texts, halves.select("row_key"), F.col("row_key"), F.col("row_key"))
    picked = texts.join(wanted, F.col("row_key") == F.col("_key")).select("doc_id", "row_key", F.split("text", "\n", -1).alias("lines"), F.explode("picks").alias("x"))
    rest = picked.select("doc_id", "row_key", "x.*", F.get("lines", F.col("x.pos")).alias("line"))
    n = F.char_length("line")
    size, half = n + F.col("role"), F.floor((n + F.col("role")) / 2).cast("int")
    rest = rest.select(*_PLACE, "role", "key", (size - half).alias("m"), F.when(F.col("half") == 0, F.col("line").substr(half + 1, n - half)).otherwise(F.col("line").substr(F.lit(1), n - half)).alias("rest"))
    width = F.ceil(F.sqrt("m")).cast("int")
    cut = rest.withColumn("w", width).select(*_PLACE, "role", "key", "m", "w", "rest", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("m") / F.col("w")) - 1).cast("int"))).alias("s"))
    left = F.col("s") * F.col("w")
    right = F.greatest(F.col("m") - left - F.col("w"), F.lit(0))
    middle = F.col("m") - F.col("role") - left - right
    segments = cut.select(
        *_PLACE,
        "role",
        F.xxhash64("key", "s", F.col("rest").substr(F.lit(1), left), F.col("rest").substr(F.col("m") - F.col("role") - right + 1, right)).alias("key"),
        F.col("rest").substr(left + 1, middle).alias("part"),
    )
    segments = scratch.keep(segments, "segments")
    met = scratch.keep(_met(segments, scratch, "segments"), "met")
    scratch.drop(halves, segments)

    at = F.sequence(F.lit(1), F.char_length("part"))
    long = met.filter("role = 0").select(*_PLACE, "key", "part", F.explode(at).alias("i"))
    long = long.withColumn("without", F.concat(F.col("part").substr(F.lit(1), F.col("i") - 1), F.col("part").substr(F.col("i") + 1, F.char_length("part"))))
    replaced = long.select(F.xxhash64("key", "i", "without").alias("v"), F.lit(0).alias("role"), *_PLACE, "part")
    shorter = long.select(F.xxhash64("key", F.lit(0), "without").alias("v"), F.lit(1).alias("role"), *_PLACE, "part").distinct()
    short = met.filter("role = 1").select(F.xxhash64("key", F.lit(0), "part").alias("v"), F.lit(2).alias("role"), *_PLACE, "part")
    variants = scratch.keep(replaced.unionByName(shorter).unionByName(short), "variants")
    place = F.struct(*_PLACE, "part")
    first = lambda role: F.min(F.when(F.col("role") == role, place)).alias(f"first{role}")
    groups = scratch.keep(variants.groupBy("v").agg(*map(first, range(3)), F.count("*").alias("n")).filter("n > 1 and (first0 is not null or first2 is not null and first1 is not null)"), "groups")
    linked = variants.join(groups, "v").withColumn("by", F.when(F.col("role") == 1, F.col("first2")).when(F.col("role") == 2, F.col("first1")).otherwise(F.col("first0")))
    before = F.struct(*(F.col(f"by.{c}") for c in _PLACE)) < F.struct(*_PLACE)
    linked = linked.filter(F.col("by").isNotNull() & before & (F.levenshtein("part", F.col("by.part"), 1) >= 0))
    out = scratch.keep(linked.select("row_key", "pos").distinct(), "near")
    scratch.drop(met, variants, groups)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with its repeated lines gone, and the columns line_count, exact_dropped and near_dropped."""
    scratch = Scratch(docs.sparkSession, "lines")
    distinct = scratch.keep(distinct_lines(docs, id_col, text_col, least), "distinct")
    near = near_lines(docs, distinct, scratch, id_col, text_col)
    places = distinct.select("row_key", "pos", F.lit(False).alias("goes")).unionByName(near.select("row_key", "pos", F.lit(True).alias("goes")))
    own = ("_doc", "_key", "_first", "_near", "_lines", "_kept", "_n", "_goes")
    doc, key, first, goes, lines, kept, n, gone = names = [free_name(x, docs.columns) for x in own]
    by_doc = places.groupBy(F.col("row_key").alias(doc)).agg(F.collect_list(F.when(~F.col("goes"), F.col("pos"))).alias(first), F.collect_list(F.when(F.col("goes"), F.col("pos"))).alias(goes))
    text = F.col(f"`{text_col}`").cast("string")
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(by_doc, F.col(key) == F.col(doc), "left").withColumn(lines, F.split(text, "\n", -1))
    empty = F.array().cast("array<int>")
    blank = F.filter(F.transform(lines, lambda x, i: F.when(~x.rlike(r"\S"), i)), lambda i: i.isNotNull())
    stays = F.sort_array(F.concat(blank, F.array_except(F.coalesce(first, empty), F.coalesce(goes, empty))))
    joined = joined.withColumn(kept, stays).withColumn(n, F.size(lines)).withColumn(gone, F.coalesce(F.size(goes), F.lit(0)))
    text = F.array_join(F.filter(F.transform(kept, lambda i: F.get(lines, i)), lambda x: x.isNotNull()), "\n")
    count = lambda x: F.when(F.col(lines).isNull(), F.lit(0)).otherwise(x).cast("long")
    counts = {"line_count": count(F.col(n)), "near_dropped": count(F.col(gone)), "exact_dropped": count(F.col(n) - F.size(kept) - F.col(gone))}
    return joined.withColumns({text_col: text} | {free_name(c, docs.columns): x for c, x in counts.items()}).drop(*names)
