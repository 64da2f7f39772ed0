"""The corpus pipeline, stage by stage against brute force."""

import hashlib
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lintel.llm import language, mixing, queries  # noqa: E402

from .test_exact_simhash import brute_shingles  # noqa: E402
from .test_lines_urls_mixing import brute_lines  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    root = tmp_path_factory.mktemp("stages")
    kept["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = kept[name] = spark.read.parquet(f"{root}/{name}")
    return kept


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "mixing", "pieces"]
    for name in ("language", "lines", "near", "mixing"):
        assert stages[name].dtypes == stages["input"].dtypes


def test_language_stage(spark, stages):
    model = language.train(stages["input"].filter(~language.held_out()))
    known = language.identify(stages["input"], model).filter("lang_pred <> 'und' and not ambiguous")
    assert sorted(r[0] for r in stages["language"].select("doc_id").collect()) == sorted(r["doc_id"] for r in known.collect())


def test_lines_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages["language"].collect()]
    want = {r[0]: r[1] for r in brute_lines(rows)}
    assert {r["doc_id"]: r["text"] for r in stages["lines"].collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stages["lines"].collect())


def test_near_stage(stages):
    """One text stays of each group of texts connected by five-word Jaccard of 0.8 or more, over all pairs."""
    want = brute_near({r["doc_id"]: r["text"] for r in stages["lines"].collect()})
    assert {r["doc_id"] for r in stages["near"].collect()} == want


def brute_near(texts):
    sets = {i: brute_shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def top(i):
        return i if parent[i] == i else top(parent[i])

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i for i in sets if top(i) == i}


def test_near_stage_finds_planted_copies(spark, sf_dir, documents):
    """Copies with words replaced, up to the bound: at least nine of ten, and no text without a copy goes."""
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(10**6)}"
    texts, planted = {}, []
    for k in range(60):
        base = [word() for _ in range(rnd.choice((60, 150, 400)))]
        texts[10 * k] = " ".join(base)
        copy = list(base)
        for _ in range(max(1, len(base) // 60)):
            copy[rnd.randrange(len(copy))] = word()
        if k % 2:
            texts[10 * k + 1] = " ".join(copy)
            planted.append(10 * k + 1)
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, documents(*texts.items()), sf_dir).collect()}
    assert len([i for i in planted if i not in kept]) >= 0.9 * len(planted)
    assert {i for i in texts if i % 10 == 0} <= kept


@pytest.mark.parametrize("rows", [(), ((None, None), (None, "the same words here and there " * 4), (3, ""), (4, "the same words here and there " * 4), (4, "another line of text, long enough"))])
def test_tables_that_are_empty_or_lack_ids(spark, sf_dir, documents, tmp_path, rows):
    documents(*((i, t, "en") for i, t in rows) or ((1, "x"),)).limit(len(rows)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(found) == (3 if rows else 0)  # missing and empty texts go; the repeated line goes from its text, whose row stays


def test_mixing_stage(spark, sf_dir, stages):
    rates, _, _ = mixing.rates(stages["near"], queries.domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    want = sorted(i for r in rates.collect() for i in [r["doc_id"]] * r["copies"])
    assert sorted(r["doc_id"] for r in stages["mixing"].collect()) == want


def test_pieces_stage(spark, stages):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(spark, "piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in stages["mixing"].collect()}
    rows = stages["pieces"].collect()
    assert len(rows) == stages["mixing"].count()
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_run_equals_stages(spark, sf_dir, stages):
    want = sorted(map(str, stages["pieces"].collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == want
