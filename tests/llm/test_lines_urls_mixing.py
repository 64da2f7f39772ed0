"""The native operators against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lintel.llm import lines, mixing, queries, urls


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(rows, least=20):
    """For each row (doc_id order): kept text and counts."""
    seen, out = {}, []
    places = []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            if line.strip(" \t\n\x0b\f\r") and line not in seen:
                seen[line] = (doc, pos)
    near = {}
    for line, at in seen.items():
        near[line] = len(line) >= least and any(len(o) >= least and oat < at and within_one(line, o) for o, oat in seen.items())
    for doc, text in rows:
        if text is None:
            out.append((doc, None, 0, 0, 0))
            continue
        kept, exact, close = [], 0, 0
        all_lines = text.split("\n")
        for pos, line in enumerate(all_lines):
            if not line.strip(" \t\n\x0b\f\r"):
                kept.append(line)
            elif seen[line] != (doc, pos):
                exact += 1
            elif near[line]:
                close += 1
            else:
                kept.append(line)
        out.append((doc, "\n".join(kept), len(all_lines), exact, close))
    return sorted(out, key=lambda r: r[0])


def edited(rnd, line):
    i = rnd.randrange(len(line))
    kind = rnd.randrange(3)
    c = rnd.choice("abcxyz é")
    return line[:i] + line[i + 1 :] if kind == 0 else line[:i] + c + line[i:] if kind == 1 else line[:i] + c + line[i + 1 :]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_against_brute_force(spark, documents, clashing, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abc ") for _ in range(rnd.choice((3, 19, 20, 21, 22, 40, 41, 90)))) for _ in range(25)]
    rows = []
    for doc in range(30):
        ls = []
        for _ in range(rnd.randrange(8)):
            line = rnd.choice(base)
            for _ in range(rnd.choice((0, 0, 1, 1, 2))):
                line = edited(rnd, line)
            ls.append(line)
        rows.append((doc, "\n".join([*ls, *rnd.choice(([], [""], ["  "]))])))
    rows += [(90, None), (91, ""), (92, "\n\n"), (93, "x" * 50_000), (94, "x" * 49_999)]
    found = lines.dedup_lines(clashing(documents(*rows)))
    got = sorted(((r["doc_id"], r["text"], r["line_count"], r["exact_dropped"], r["near_dropped"]) for r in found.collect()), key=lambda r: r[0])
    assert got == brute_lines(rows)
    assert found.filter("key = 'clash' and n = 'clash'").count() == len(rows)


def test_lines_with_a_full_filter(spark, documents, monkeypatch):
    from lintel.llm import common

    monkeypatch.setattr(common, "MOST_BITS", 32768)
    rows = [(i, f"the same beginning of a line number {i % 7} and its end") for i in range(60)]
    got = sorted(((r["doc_id"], r["text"], r["line_count"], r["exact_dropped"], r["near_dropped"]) for r in lines.dedup_lines(documents(*rows)).collect()), key=lambda r: r[0])
    assert got == brute_lines(rows)


def test_lines_of_repeated_and_null_ids(spark, documents):
    found = lines.dedup_lines(documents((1, "aaa"), (2, "bbb"), (2, "aaa"), (None, "ccc"), (None, "ddd"), (3, "ccc"))).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in found) == [(0, "ccc"), (0, "ddd"), (1, "aaa"), (2, ""), (2, "bbb"), (3, "")]
    texts = spark.createDataFrame([("u-2", "a\nb"), ("u-1", "b")], "doc_id string, text string")
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(texts).collect()} == {"u-1": "b", "u-2": "a"}


def test_lines_keep_columns_of_any_name(spark, documents):
    names = ("_doc", "_key", "_n", "_kept", "_lines", "_first", "_near", "_goes", "_at", "_map", "row_key", "line_count", "Near_Dropped")
    docs = documents((1, "x\nx"), (2, "x")).withColumns({c: F.lit("clash") for c in names})
    found = lines.dedup_lines(docs)
    assert found.columns == [*docs.columns, "line_count_", "near_dropped_", "exact_dropped"]
    assert found.filter(" and ".join(f"`{c}` = 'clash'" for c in names)).count() == 2
    assert {r["doc_id"]: (r["text"], r["line_count_"]) for r in found.collect()} == {1: ("x", 2), 2: ("", 1)}


def test_lines_empty_and_repeated_rows(spark, documents):
    assert lines.dedup_lines(documents((1, "x")).limit(0)).count() == 0
    twice = lines.dedup_lines(documents((4, "one line\nanother"), (4, "one line\nanother"), (None, "another"))).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in twice) == [(0, "another"), (4, "one line"), (4, "one line")]


URLS = (
    ("https://WWW.Example.org/es/casa?x=1", "www.example.org", "/es/casa", "example.org/es/", "block"),
    ("http://example.org/en/12#a", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://a.b.com/fr/x", "a.b.com", "/fr/x", "com/fr/", "allow"),
    ("http://com/de/", "com", "/de/", "com/de/", "block"),
    ("http://xcom/de/", "xcom", "/de/", None, "allow"),
    ("http://example.org", "example.org", "", None, "allow"),
    ("http://casino.net/a", "casino.net", "/a", None, "block"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://example.org/ES/", "example.org", "/ES/", "org/", "allow"),
    ("http://example.org/en/1\nx", "example.org", "/en/1\nx", "example.org/en/1", "block"),
)


@pytest.mark.parametrize("max_broadcast", [10_000, 0])
def test_urls(spark, clashing, max_broadcast):
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)] + [(0, URLS[0][0])], "page_id long, url string")
    found = urls.judge(clashing(pages), urls.rule_table(spark), max_broadcast=max_broadcast).collect()
    assert len(found) == len(URLS) + 1
    for r in found:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == URLS[r["page_id"]][1:], r
    assert urls.judge(pages.limit(0), urls.rule_table(spark)).count() == 0


def test_rules_sit_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(i, f"http://example.org/{'es/' if i == 0 else ''}x") for i in range(5)], "page_id long, url string")
    targets = pages.select(F.concat(urls.host_of(F.col("url")), urls.path_of(F.col("url"))).alias("target"))
    found, small = urls.index(urls.rule_table(spark), targets)
    assert small and {r["rule"]: r["token"] for r in found.collect()}["example.org/es/"] == "es"


@pytest.mark.parametrize("max_broadcast", [10_000, 0])
def test_thousands_of_rules_fetch_few(spark, max_broadcast):
    """Rules of a table, tried one by one in Python, give the same; a URL runs only the rules that its tokens fetch."""
    import re

    rules = urls.rule_table(spark)
    table = rules.collect()
    assert len(table) > 3000 and len({r["rule_id"] for r in table}) == len(table)
    hosts = ("free-bets.a.net", "x.casino-win.example.net", "casinowin.net", "mycasinowin.net", "pills.com", "a.best-loans-b.org", "a-viagra-online.net", "forexplay.io", "plain.net")
    given = [(i, f"http://{h}/{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in ("", "de/x", "casino-win/y"))]
    pages = spark.createDataFrame(given, "page_id long, url string")
    rank = lambda r: (r["listed"], len(r["rule"]), -r["rule_id"])
    for r in urls.judge(pages, rules, max_broadcast=max_broadcast).collect():
        hits = [x for x in table if re.search(x["pattern"], r["host"] + r["path"])]
        best = max(hits, key=rank, default=None)
        assert (r["matched"], r["verdict"]) == ((best["rule"], best["action"]) if best else (None, "allow")), r
    targets = pages.select(F.concat(urls.host_of(F.col("url")), urls.path_of(F.col("url"))).alias("target"))
    listed, _ = urls.index(rules, targets, max_broadcast)
    fetched = targets.select(F.explode(urls.tokens_of(F.col("target"))).alias("token")).join(listed, "token").count()
    assert fetched < 0.01 * len(given) * len(table)
    bare = rules.filter("rule = 'org/' or rule = '*pills*'").withColumn("tokens", F.lit(None).cast("array<string>"))
    few = urls.judge(pages, urls.rules_of(bare), max_broadcast=max_broadcast).filter("matched is not null").collect()
    assert {(r["host"], r["matched"]) for r in few} == {("pills.com", "*pills*"), ("a.best-loans-b.org", "org/")}


def test_mixing_meets_reachable_targets(spark, documents):
    rows = [(i, "good fine words here and there" if i % 10 else "BAD bad %%% %%% nasty nasty nasty stuff") for i in range(400)]
    docs = documents(*rows)
    labels = spark.createDataFrame([(i, "high" if i % 10 else "low") for i in range(400)], "doc_id long, domain string")
    found, domains, reached = mixing.rates(docs, labels, {"high": 0.8, "low": 0.2})
    got = found.collect()
    total = sum(r["tokens"] for r in got)
    share = {d: sum(r["rate"] * r["tokens"] * r["p"][k] for r in got) / total for k, d in enumerate(domains)}
    assert abs(share["high"] - 0.8) < 2e-3 and abs(share["low"] - 0.2) < 2e-3
    assert all(abs(reached[d][0] - share[d]) < 1e-6 for d in domains) and reached["low"][1] == 0.2
    assert all(0 <= r["rate"] <= mixing.MOST_RATE and abs(r["copies"] - r["rate"]) < 1 for r in got)


@pytest.mark.parametrize("domains", [("high", "low"), ("high", "low", "toxic")])
def test_mixing_of_balanced_domains(spark, documents, domains):
    """Domains of equal size, told by words that two of three may share, still have words that speak."""
    words = {"high": "fine plain", "low": "poor plain", "toxic": "nasty"}
    of = lambda i: domains[i % len(domains)]
    docs = documents(*((i, f"some text of {words[of(i)]} words") for i in range(600)))
    labels = spark.createDataFrame([(i, of(i)) for i in range(600)], "doc_id long, domain string")
    targets = dict(zip(domains, (0.9, 0.07, 0.03), strict=False))
    found, names, reached = mixing.rates(docs, labels, targets)
    got = found.collect()
    assert all(r["p"][names.index(of(r["doc_id"]))] > 0.9 for r in got)
    total = sum(r["tokens"] for r in got)
    for d, aim in targets.items():
        share = sum(r["rate"] * r["tokens"] for r in got if of(r["doc_id"]) == d) / total
        assert abs(share - aim / sum(targets.values())) < 0.02


def test_mixing_of_a_rare_domain(spark, documents, caplog):
    """A domain with 0.2 % of the tokens reaches 3 %; under an upper bound of the rate the gap is logged."""
    of = lambda i: "toxic" if i % 500 == 0 else "high"
    docs = documents(*((i, "nasty nasty mean words" if of(i) == "toxic" else "good fine plain words") for i in range(2000)))
    labels = spark.createDataFrame([(i, of(i)) for i in range(2000)], "doc_id long, domain string")
    for most, met in ((None, True), (8.0, False)):
        caplog.clear()
        found, names, reached = mixing.rates(docs, labels, {"high": 0.97, "toxic": 0.03}, **({"most_rate": most} if most else {}))
        got = found.collect()
        share = sum(r["rate"] * r["tokens"] * r["p"][names.index("toxic")] for r in got) / sum(r["tokens"] for r in got)
        assert (abs(share - 0.03) < 2e-3) == met
        assert ("domain toxic reaches" in caplog.text) != met
        assert max(r["rate"] for r in got) > 8 if met else max(r["rate"] for r in got) <= 8
    caplog.clear()
    mixing.rates(docs, labels, {"high": 0.9, "low": 0.1})
    assert "domain low reaches 0.0000 of the tokens, target 0.1000" in caplog.text


def test_mixing_against_brute_force(spark, sf_dir):
    """Posteriors, rates and copies of the whole table, by a plain reading of the method."""
    import math
    import re

    import numpy as np
    import xxhash

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found, names, reached = mixing.rates(docs, queries.domains_of(labels))
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def parts(text):
        low = text.lower()
        words = [w for w in re.split(r"[ \t\n\x0b\f\r!-/:-@\[-`{-~]+", low) if w]
        once = list(dict.fromkeys(words))
        step = lambda x, y: math.floor(x / y * (mixing.SHAPES - 2)) if y else mixing.SHAPES - 1
        buckets = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) % mixing.BUCKETS for w in once]
        return len(words), [*buckets, mixing.BUCKETS + step(len(once), len(words)), mixing.BUCKETS + mixing.SHAPES + step(sum(map(len, once)), len(text))]

    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    of = {r["doc_id"]: "toxic" if r["toxic"] == 1 else "high" if r["quality"] == 1 else "low" for r in labels.collect()}
    features = {i: parts(t) for i, t in texts.items()}
    known = [i for i in texts if i in of]
    m = {d: sum(of[i] == d for i in known) for d in names}
    total, counts = len(known), {}
    for i in known:
        for b in set(features[i][1]):
            counts.setdefault(b, dict.fromkeys(names, 0))[of[i]] += 1
    base, logs = {d: math.log(m[d] / total) for d in names}, {}
    for b, k in counts.items():
        n = sum(k.values())

        def speaks(d, k=k, n=n):
            a, o, share = k[d] / m[d], (n - k[d]) / (total - m[d]), n / total
            return abs(a - o) >= mixing.LEAST_ERRORS * math.sqrt(max(share * (1 - share) * (1 / m[d] + 1 / (total - m[d])), 1e-12)) and max(a, o) >= mixing.LEAST_RATIO * min(a, o)

        if any(map(speaks, names)):
            for d in names:
                rate = (k[d] + mixing.SMOOTH * n / total) / (m[d] + mixing.SMOOTH)
                base[d] += math.log1p(-min(rate, 1 - 1e-6))
                logs[d, b] = round(math.log(rate) - math.log1p(-min(rate, 1 - 1e-6)), 4)
    want = {}
    for i, (_, buckets) in features.items():
        z = [base[d] + sum(logs.get((d, b), 0) for b in buckets) for d in names]
        e = [math.exp(x - max(z)) for x in z]
        want[i] = [x / sum(e) for x in e]
    got = {r["doc_id"]: r for r in found.collect()}
    assert got.keys() == texts.keys() and all(r["tokens"] == features[i][0] for i, r in got.items())
    assert all(abs(x - y) < 1e-4 for i, r in got.items() for x, y in zip(r["p"], want[i], strict=True))
    t, p, r = (np.array([got[i][c] for i in sorted(got)], float) for c in ("tokens", "p", "rate"))
    share = (r * t) @ p / t.sum()
    assert (r >= 0).all() and all(abs(share[k] - reached[d][0]) < 1e-6 for k, d in enumerate(names))
    # no nonnegative rates come closer to the targets: accelerated projected gradient over the distinct posteriors
    aim = np.array([reached[d][1] for d in names])
    rays, x, y, k = np.unique(p, axis=0).T, 0, 0, 1
    x = y = np.zeros(rays.shape[1])
    for _ in range(20_000):
        new = np.maximum(0, y - rays.T @ (rays @ y - aim) / np.linalg.norm(rays @ rays.T, 2))
        y, x, k = new + (k - 1) / (k + 1.5) * (new - x), new, k + 0.5
    assert ((share - aim) ** 2).sum() <= 1.02 * ((rays @ x - aim) ** 2).sum() + 1e-5
    for i, x in got.items():
        u = signed(xxhash.xxh64_intdigest(hashlib.md5(f"={i}\0={texts[i]}".encode()).digest(), xxhash.xxh64_intdigest(b"mixing", 42))) % (1 << 30) / (1 << 30)
        assert x["copies"] == math.floor(x["rate"] + u)


def test_mixing_awkward_rows(spark, awkward, clashing):
    labels = spark.createDataFrame([], "doc_id long, domain string")
    found, domains, reached = mixing.rates(clashing(awkward), labels)
    assert domains == ["all"] and {r["rate"] for r in found.collect()} == {1.0}
    taken = clashing(awkward).withColumns({c: F.lit("clash") for c in ("_id", "_copies", "_copy", "row", "u", "copies")})
    out = mixing.mixed(taken, labels)
    assert out.columns == taken.columns and sorted(map(str, out.collect())) == sorted(map(str, taken.collect()))
    assert mixing.mixed(awkward.limit(0), labels).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, duck, sf_dir, name):
    from tests.compare import rows_of, rows_of_sql

    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, queries.ORACLES[name])


def test_buckets_are_made_of_the_sample_only(spark, documents):
    """No filter on the buckets, which splits every text, goes below the join with the sampled labels."""
    labels = spark.createDataFrame([(1, "high")], "doc_id long, domain string")
    docs = documents((1, "some words here"), (2, "others there"))
    rows = mixing.featured(docs.join(labels.hint("broadcast"), "doc_id"), "doc_id", "text", "domain").select("domain", "buckets")
    plan = mixing.bucketed(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "split" not in plan.split("Join")[1]
    assert mixing.bucketed(rows).count() == 5
