"""Byte-level BPE against the tiktoken library, the divergence audit and the manifest against brute force."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lintel.llm import bpe, divergence, manifest, queries
from tests.compare import rows_of, rows_of_sql

TEXTS = (
    "", "a", "Hello  world\n\n\ttabs 'tis don't WE'LL", "a" * 3001, "==" * 777, " " * 301, "é" * 900, "日本語のテキスト" * 40, "\0\x1f\x85\xa0", "<|endoftext|>", "🙂👩‍👩‍👧 é",
    "".join(map(chr, range(1, 1500))), "abcabcabcabd" * 60, "\r\n\r\n  x", "١٢٣ ½ Ⅷ", "aaaabaaaab aaaaaab",
)


@pytest.fixture(scope="module")
def vocabulary(spark):
    import public_tokenizers

    return queries.tokenizer_path(spark, "byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library(vocabulary):
    import tiktoken

    path, pattern = vocabulary
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_words_equal_the_library(spark, vocabulary, name):
    import numpy as np
    import tiktoken

    path = queries.tokenizer_path(spark, name)
    library = tiktoken.Encoding("own", pat_str=vocabulary[1], mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    one = bpe.Codec(path, vocabulary[1])
    rng = np.random.default_rng(5)
    made = ["".join(rng.choice([*"aabbcde  \n'0é語"], int(rng.integers(1, 60)))) for _ in range(800)]
    for text, (n, of_ids, of_text, ids) in zip((*TEXTS, *made), one.encode([*TEXTS, *made]), strict=True):
        want = library.encode_ordinary(text)
        assert [int(x) for x in ids.split()] == want, text[:80]
        assert n == len(want) and of_ids == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert of_text == hashlib.sha256(text.encode()).hexdigest()
    assert not one.odd


def test_long_text_and_small_memo(vocabulary, library, monkeypatch):
    """Parts of a long text, and a memo that turns over between them, change nothing."""
    one = bpe.Codec(*vocabulary)
    monkeypatch.setattr(bpe, "MEMO", 50)
    monkeypatch.setattr(bpe, "PART", 40)
    texts = [" ".join(f"word{i * k}x" for i in range(60)) for k in range(1, 9)] + ["short one", "", "short two"]
    found = [[int(x) for x in ids.split()] for *_, ids in one.encode(texts)]
    assert found == [library.encode_ordinary(t) for t in texts]
    assert len(one.memo) <= 50 + 300


def test_encode_decode_rows(spark, vocabulary, library, awkward, clashing):
    rows = bpe.encode(clashing(awkward), *vocabulary)
    found = rows.collect()
    want = Counter((r["doc_id"], tuple(library.encode_ordinary(r["text"] or ""))) for r in awkward.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in found) == want
    back = bpe.decode(rows.withColumn("decoded", F.lit("clash")), *vocabulary).collect()
    assert Counter((r["doc_id"], bytes(r["decoded_"])) for r in back) == Counter((r["doc_id"], (r["text"] or "").encode()) for r in awkward.collect())
    assert bpe.encode(awkward.limit(0), *vocabulary).count() == 0 and bpe.decode(rows.limit(0), *vocabulary).count() == 0


def test_decode_of_any_ids(spark, vocabulary, library):
    rows = spark.createDataFrame([(0, [220, 0, 50255]), (1, []), (2, None), (3, [1, 50256]), (4, [1, None])], "row long, `ids.all` array<int>")
    found = {r["row"]: r["decoded"] for r in bpe.decode(rows, *vocabulary, ids_col="ids.all").collect()}
    assert bytes(found[0]) == library.decode_bytes([220, 0, 50255]) and found[1] == b"" and [found[i] for i in (2, 3, 4)] == [None] * 3


def test_op11_whole_table(spark, sf_dir, library):
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()))
    assert sorted(tuple(r) for r in queries.op11_bytes(spark, sf_dir).collect()) == sorted(want)


def brute_divergence(rows, least_docs, top):
    import re

    groups, docs = {}, {}
    for lang, source, text in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.setdefault((lang or "", source or ""), Counter()).update(terms)
        docs.setdefault(lang or "", Counter()).update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        mine = {s: c for (g, s), c in groups.items() if g == lang}
        mine = {s: {t: c[t] for t in kept} for s, c in mine.items()}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in mine.items()}
        q = share({t: sum(c[t] for c in mine.values()) for t in kept})
        for s in mine:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in mine if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if mine[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "block", "least"), [(4096, 64, 2), (3, 2, 2), (5, 1, 1), (4096, 64, 99)])
def test_divergence_of_any_tiling(spark, chunk, block, least):
    import numpy as np

    rng = np.random.default_rng(chunk)
    words = ["alpha", "Beta", "gamma", "ÉTÉ", "été", "naïve", "語", "zeta9eta", "rare", "it's", "Zz_z"]
    rows = [(None if i % 17 == 0 else ("en", "fr", "")[i % 3], None if i % 13 == 0 else f"s{int(rng.integers(0, 7))}", " ".join(rng.choice(words, int(rng.integers(0, 12))))) for i in range(150)]
    rows += [("de", "lone", None), ("it", "a", "only"), ("it", "b", "7 8 9"), ("it", "a", "only"), ("en", "hot", "beta " * 3000), ("en", "hot", "beta " * 3000), ("en", "", "")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"n": F.lit("clash"), "term": F.lit("clash"), "block": F.lit(1)})
    found = divergence.divergence(docs.repartition(5), least_docs=least, chunk_terms=chunk, block_groups=block, top=4)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == brute_divergence(rows, least, 4)


def test_divergence_tables_of_bounded_size(spark, monkeypatch):
    rows = [("en", f"s{i % 3}", " ".join(f"t{chr(97 + j)}{chr(97 + (i * j) % 20)}" for j in range(20))) for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    batches = [b for b in docs.select("lang", "source", "text").coalesce(1).toArrow().to_batches()]
    whole = [r for b in divergence._counted(batches) for r in b.to_pylist()]
    monkeypatch.setattr(divergence, "TABLE_ROWS", 50)
    parts = [b for b in divergence._counted(batches)]
    assert max(b.num_rows for b in parts) <= 50 + 21
    add = lambda rs, k: {key: sum(r[k] for r in rs if (r["source"], r["term"]) == key) for key in {(r["source"], r["term"]) for r in rs}}
    flat = [r for b in parts for r in b.to_pylist()]
    assert add(whole, "n") == add(flat, "n") and add(whole, "docs") == add(flat, "docs")
    assert divergence.divergence(docs.limit(0)).count() == 0


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(r, text):
    said = ["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)]
    return H(*said)


def brute_tree(nodes, fanout):
    """(root, for each node the runs on its way: (place, run))."""
    ways, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for i in range(len(nodes)):
            first = at[i] // fanout * fanout
            ways[i].append((at[i] - first, level[first : first + fanout]))
            at[i] //= fanout
        level = [H(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], ways


def brute_manifest(rows, fanout=16):
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    by_source = {}
    if not rows:
        return Counter()
    for r in rows:
        by_source.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r, r["text"]), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])], fanout) for s in names}
    root, ways = brute_tree([trees[s][0] for s in names], fanout)
    out = []
    for i, s in enumerate(names):
        for (_, _, leaf, r), way in zip(sorted(by_source[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            now, way = brute_leaf(r, lower(r["text"])) if hit else leaf, way + ways[i]
            for place, run in way:
                now = H(*run[:place], now, *run[place + 1 :])
            proof = H(*(d for place, run in way for j, d in enumerate(run) if j != place))
            out.append((r["doc_id"], leaf, trees[s][0], root, proof, now, now == root))
    return Counter(out)


def digests_of(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return Counter(tuple(r) for r in queries.op13_manifest(spark, str(tmp_path)).collect())


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 300])
def test_op13_sizes(spark, documents, tmp_path, n):
    docs = documents(*((i * 7 % 1000, f"Text {i} É", "en") for i in range(n))).withColumn("source", F.when(F.col("doc_id") % 4 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 40)))
    assert digests_of(spark, docs, tmp_path) == brute_manifest(docs.collect())


def test_op13_awkward(spark, awkward, clashing, tmp_path):
    docs = awkward.withColumn("source", F.when(F.col("doc_id") > 3, F.col("source"))).withColumn("lang", F.when(F.col("doc_id") != 2, F.lit("é|:")))
    want = brute_manifest(docs.collect())
    assert digests_of(spark, clashing(docs), tmp_path) == want


@pytest.mark.parametrize(("fanout", "levels"), [(2, 3), (3, 2), (16, 1)])
def test_rounds_of_superblocks(spark, documents, fanout, levels):
    """Several rounds, trees of different heights, and last runs of one node give the roots and proofs of plain trees."""
    docs = documents(*((i, f"t{i}") for i in range(90))).withColumn("source", F.expr("case when doc_id < 60 then 'a' when doc_id < 85 then 'b' when doc_id < 88 then 'c' else cast(doc_id as string) end"))
    found = manifest.manifest(docs, fanout=fanout, levels=levels, mine=F.col("text"))
    root = manifest.folded(F.col("leaf"), F.col("proof"), F.col("places"), F.col("widths"))
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")), 256).alias("said"), root.alias("now"), "mine").collect()
    want = {k[0]: k[1:5] for k in brute_manifest(docs.collect(), fanout)}
    assert {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], r["said"]) for r in found} == want
    assert all(r["now"] == r["root"] and r["mine"] == f"t{r['doc_id']}" for r in found)


def test_identifiers_beyond_doubles(spark):
    big = 2**53
    rows = spark.createDataFrame([(big + 1, "x"), (big, "y"), (None, "z")], "doc_id long, text string").withColumns({c: F.lit("s") for c in ("source", "lang")}).withColumn("n_chars", F.lit(1))
    assert {r["doc_id"] for r in manifest.manifest(rows).collect()} == {big, big + 1, None}


@pytest.mark.parametrize("name", ["op12_divergence", "op13_manifest"])
def test_twins(spark, duck, sf_dir, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, queries.ORACLES[name])
