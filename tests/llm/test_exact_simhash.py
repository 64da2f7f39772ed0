"""Exact and near dedup against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lintel.llm import exact, queries, simhash


def brute_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute_components(fps, bits=2):
    ids = sorted(fps, key=lambda i: (i is None, i))
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= bits:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: top(i) for i in ids}


def test_op10_against_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    found = queries.op10_simhash(spark, sf_dir).collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in found} == fps
    assert {r["doc_id"]: r["component_id"] for r in found} == brute_components(fps)


@pytest.mark.parametrize("max_block", [2, 64])
def test_links_lose_nothing_in_large_groups(spark, max_block):
    rnd = random.Random(max_block)
    base = rnd.getrandbits(64)
    values = {base}
    while len(values) < 150:  # a dense ball, chains that leave it, and strangers
        start = rnd.choice(sorted(values)) if rnd.random() < 0.8 else rnd.getrandbits(64)
        values.add(start ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    distinct = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    from lintel.llm.common import Scratch, components

    scratch = Scratch(spark, "test")
    labels = {r["node"]: r["label"] for r in components(simhash.links(distinct, scratch, max_block), scratch).collect()}
    found = {v: labels.get(signed(v), signed(v)) for v in values}
    want = brute_components({v: v for v in values})
    groups = lambda m: sorted(sorted(v for v in m if m[v] == g) for g in set(m.values()))
    assert groups(found) == groups(want)


def test_simhash_awkward_rows(spark, awkward, clashing):
    found = simhash.near_duplicates(clashing(awkward)).collect()
    assert len(found) == awkward.count()
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1]["fp"] == by_id[2]["fp"] == by_id[3]["fp"] == 0
    assert by_id[1]["component_id"] == by_id[3]["component_id"] == 1
    assert by_id[4]["component_id"] == by_id[5]["component_id"] == 4
    kept = simhash.keep_one(clashing(awkward))
    assert kept.columns == clashing(awkward).columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [1, 4, 6, 7]
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((i, t or ""))
    out = []
    for text, members in groups.items():
        longest = max(len(t) for _, t in members)
        ids = [i for i, t in members if len(t) == longest and i is not None]
        keep = min(ids) if ids else None
        out += [(i, keep, len(members), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=str)


@pytest.mark.parametrize(("digest_bytes", "memtable"), [(32, 50_000), (32, 3), (1, 7)])
def test_exact_against_brute_force(spark, documents, awkward, clashing, digest_bytes, memtable):
    """With one-byte digests texts collide, and byte verification has to split them."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(9)]
    more = [(100 + i, rnd.choice((" ", "\n", "  ")).join(rnd.choice(words) for _ in range(rnd.randrange(4)))) for i in range(300)]
    docs = awkward.unionByName(documents(*more))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = exact.exact_duplicates(clashing(docs), memtable_rows=memtable, digest_bytes=digest_bytes)
    assert sorted((tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "kept", "sha256").collect()), key=str) == brute_exact(rows)
    assert exact.exact_duplicates(docs.limit(0)).count() == 0


def test_repeat_filter_when_full(spark, documents):
    docs = documents(*((i, f"t{i % 40}") for i in range(100)))
    found = exact.exact_duplicates(docs, filter_bits=32768).orderBy("doc_id").collect()
    assert [r["group_size"] for r in found[:3]] == [3, 3, 3] and sum(r["kept"] for r in found) == 40


def test_index_levels_and_probes(spark, documents):
    """Flushes pile up in levels, runs are sorted, and probes meet only rows that a segment's filter lets through."""
    index = exact.MergeIndex(spark, 4, fanout=2, bits=32768)
    parts = [exact.digests(documents(*((i, f"t{i % 9}") for i in range(k, 60, 5)))).cache() for k in range(5)]
    shapes = []
    for part in parts:
        index.add(part)
        for segment in index.levels[0]:
            for (run,) in segment.select("run").distinct().collect():
                found = [r["digest"] for r in segment.filter(F.col("run") == run).collect()]
                assert found and len(set(found)) <= 4 * 4
        shapes.append([len(level) for level in index.levels])
    assert shapes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    asked = exact.digests(documents((100, "t3"), (101, "x1"), (102, "x2"), (103, "t8 ")))
    hits = index.probe(asked).groupBy("doc_id").agg(F.sum("held").alias("n"), F.min("keep_id").alias("keep")).collect()
    assert {(r["doc_id"], r["n"], r["keep"]) for r in hits} == {(100, 7, 3), (103, 6, 8)}
    from lintel.llm.common import flagged

    for segment in (s for level in index.levels for s in level):
        passed = flagged(asked, segment.select("digest"), F.col("digest"), F.col("digest"), "maybe", 32768).filter("maybe").count()
        assert passed <= 2  # the two strangers skip every segment
    merged = index.merged()
    assert sorted((r["doc_id"], r["n"]) for r in merged.collect()) == [(i, len(range(i, 60, 9))) for i in range(9)]
    assert [len(level) for level in index.levels][-1] == 1


def test_exact_ids_of_other_types(spark):
    docs = spark.createDataFrame([("u-2", "a b"), ("u-1", "ab"), (None, "a b"), ("u-3", "c")], "doc_id string, text string")
    found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_duplicates(docs).collect()}
    assert found == {"u-2": ("u-2", 3, True), "u-1": ("u-2", 3, False), None: ("u-2", 3, False), "u-3": ("u-3", 1, True)}


def test_keep_one_of_null_and_repeated_ids(spark, documents):
    """A null id gets its text's component; rows of one id are rows of their own; the operator's own names may be taken."""
    docs = documents((1, "p q r"), (None, "p q r"), (None, "z z y"), (7, "one two"), (7, "three four"), (8, "one two"))
    taken = docs.withColumns({c: F.lit("clash") for c in ("_kept", "_key", "_row", "row_key", "component", "component_id", "node")})
    for least in (None, 0.8):
        kept = simhash.keep_one(taken, least=least)
        assert kept.columns == taken.columns
        assert sorted(((r["doc_id"] or 0, r["text"]) for r in kept.collect())) == [(0, "z z y"), (1, "p q r"), (7, "one two"), (7, "three four")]
    texts = spark.createDataFrame([("u-2", "a b"), ("u-1", "A b")], "doc_id string, text string")
    assert {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(texts).collect()} == {("u-2", "u-1"), ("u-1", "u-1")}


def test_distinct_fingerprints_of_all_widths(documents):
    docs = documents((1, "a b c d e"), (2, "A B C D E"), (3, "a\tb  c\x0bd e"))
    assert docs.select(F.count("*")).first()[0] == 3
    assert len({r["fp"] for r in simhash.fingerprints(docs, width=5).collect()}) == 1


def test_near_copies_against_brute_jaccard(spark, documents, awkward, clashing):
    """Texts around the bound, and a group whose blocks are large; most linked pairs differ in more than two bits."""
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(10**6)}"
    texts = []
    for size in (6, 12, 30, 60, 120, 300):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for changes in (0, 0, 1, 1, 2, 3, 5):
                copy = list(base)
                for _ in range(changes):
                    copy[rnd.randrange(size)] = word()
                texts.append(" ".join(copy))
    base = [word() for _ in range(200)]
    for _ in range(90):
        texts.append(" ".join([*base[: 200 - rnd.randrange(12)], word()]))
    docs = awkward.unionByName(documents(*((100 + i, t) for i, t in enumerate(texts))))

    sets = {r["doc_id"]: brute_shingles(r["text"]) for r in docs.collect() if r["doc_id"] is not None}
    parent = {i: i for i in sets}

    def top(i):
        return i if parent[i] == i else top(parent[i])

    far = 0
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
                far += sets[a] != sets[b] and bin(brute_fingerprint(texts[a - 100]) ^ brute_fingerprint(texts[b - 100])).count("1") > 2
    assert far > 100
    found = simhash.near_copies(clashing(docs), 0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] is not None} == {i: top(i) for i in sets}
    kept = simhash.keep_one(clashing(docs), least=0.8)
    assert sorted({r["doc_id"] for r in kept.filter("doc_id is not null").collect()}) == sorted(i for i in sets if top(i) == i)
    assert simhash.keep_one(docs.limit(0), least=0.8).count() == 0


def test_near_copies_take_simhash_links(spark, documents):
    """Whatever is within two bits by pigeonhole blocks is linked, also where the minima of two texts and their similarity say nothing."""
    from lintel.llm.common import Scratch

    rows = [(1, "a", 0b1011, 11), (2, "b", 0b1000, 12), (3, "c", 0b1000, 13), (4, "d", -1, 14), (5, "e", -4, 15), (6, "f", 0x0FF00FF00FF00FF0, 16)]
    hashed = spark.createDataFrame([(i, k.encode(), n, fp, [n], [100 + n]) for i, k, fp, n in rows], "doc_id long, row_key binary, node long, fp long, shingles array<long>, keys array<long>")
    found = simhash.near_pairs(hashed, Scratch(spark, "test"))
    assert {(r["node"], r["label"]) for r in found.collect()} >= {(12, 11), (13, 11), (15, 14)}
    assert {r["node"]: r["label"] for r in found.collect()}.get(16, 16) == 16
