"""Operator 9, mixing sources to target weights by soft membership, DataFrame operations only.

1. A classifier fitted on the labelled table gives every document a probability for each domain: naive Bayes over hashed
   words and two shape features (share of distinct words, share of letters), counted by Spark over at most ``max_rows`` labelled
   documents (rare domains first, by a hash of the identifier; the prior is that of all labels). Of the buckets only those speak whose document rate in some domain and that in all others together differ
   ``LEAST_RATIO`` times, up or down, and by ``LEAST_ERRORS`` standard errors: a bound that does not depend on a domain's share.
   Both the presence and the absence of such a bucket count.
2. Each document gets a rate r >= 0 (at most ``most_rate`` where the caller names one), how often it should be read. Projected gradient descent, scaled by the domains' cross
   products (domains x domains), minimises the squared distance between the expected domain totals, sum of r * tokens * P(domain),
   and the targets. A step is one aggregate over the documents; the rates themselves never leave the executors.
   A domain whose reached share misses its target is logged as a warning with both figures.
3. copies = floor(rate + u), u in [0, 1) a hash of the identifier: the expected number of copies is the rate.

Defined cases: null counts as empty; texts without words have no tokens and the prior as posterior, rate as any other
of that posterior; without labelled rows there is one domain, ``all``, and every rate is 1; domains without tokens are
left out of the targets, whose weights then sum to 1 again. Each row has a rate and copies of its own: rows that repeat an identifier are hashed by
identifier and text. Identifiers may be of any type (that of ``labels``); a null one hashes like a value of its own. Other columns pass through ``mixed``
untouched whatever their names. Empty table: empty result.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_key, stratified_sample

BUCKETS, SHAPES, MAX_ROWS, LEAST_ERRORS, LEAST_RATIO, SMOOTH = 1 << 16, 22, 20_000, 8.0, 4.0, 1.0
STEPS, CLOSE, RIDGE, MOST_RATE = 20, 1e-3, 0.01, math.inf
#: A domain whose cross product is below 1 / RIDGE_REACH gets a smaller ridge in proportion.
RIDGE_REACH = 50.0
LOG = logging.getLogger(__name__)
#: The share of all tokens that each domain should have.
TARGETS = {"high": 0.90, "low": 0.07, "toxic": 0.03}


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "high").when(quality == 0, "low")


def featured(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(doc_id, tokens, buckets): buckets of the distinct words, and of the binned shares of distinct words and of letters."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *more, F.char_length(text).alias("n"), F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != "").alias("words"))
    rows = rows.select("doc_id", *more, "n", F.size("words").cast("long").alias("tokens"), F.array_distinct("words").alias("words"), F.char_length(F.array_join("words", "")).alias("letters"))
    step = lambda x, y: F.coalesce(F.floor(F.try_divide(x, y) * (SHAPES - 2)), F.lit(SHAPES - 1)).cast("int")
    shapes = F.array(F.lit(BUCKETS) + step(F.size("words"), F.col("tokens")), F.lit(BUCKETS + SHAPES) + step(F.col("letters"), F.col("n")))
    words = F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    return rows.select("doc_id", *more, "tokens", F.concat(words, shapes).alias("buckets"))


def bucketed(rows: DataFrame) -> DataFrame:
    """(domain, bucket) for each bucket of a row, of which each has some. A plain ``explode`` would add a filter on them that Spark moves below
    the join with the sample, where every text is split for it."""
    return rows.select("domain", F.explode_outer("buckets").alias("bucket"))


def _speaks(k: int, m: int, others: int, rest: int) -> bool:
    """Whether k of a domain's m documents and ``others`` of the ``rest`` have clearly different rates."""
    if not rest:
        return False
    share, a, b = (k + others) / (m + rest), k / m, others / rest
    return abs(a - b) >= LEAST_ERRORS * math.sqrt(max(share * (1 - share) * (1 / m + 1 / rest), 1e-12)) and max(a, b) >= LEAST_RATIO * min(a, b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> tuple[list[str], list[float], list[list[float]]]:
    """(domains, for each domain the log-probability of a text with no bucket, and what each bucket adds). ``labels``: doc_id, domain."""
    labels = labels.filter("domain is not null").select("doc_id", "domain")
    chosen, taken = stratified_sample(labels, "doc_id", "domain", max_rows)
    # the sample holds max_rows identifiers and domains at most, so texts stay where they are
    chosen = F.broadcast(chosen) if max_rows <= MAX_ROWS else chosen
    known = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(chosen, "doc_id")
    rows = featured(known, "doc_id", "text", "domain").select("domain", F.array_distinct("buckets").alias("buckets"))
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).orderBy("domain").collect()}
    if not sizes:
        return ["all"], [0.0], [[0.0] * (BUCKETS + 2 * SHAPES)]
    counts = bucketed(rows).groupBy("bucket").pivot("domain", list(sizes)).count().na.fill(0).collect()  # a row a bucket at most
    total = sum(sizes.values())
    logs = [[0.0] * (BUCKETS + 2 * SHAPES) for _ in sizes]
    all_rows = {d: n / max(taken.get(d, 1.0), 1e-9) for d, n in sizes.items()}
    base = [math.log(n / sum(all_rows.values())) for n in all_rows.values()]
    for r in counts:
        n = [r[d] for d in sizes]
        share = sum(n) / total
        if any(_speaks(k, m, sum(n) - k, total - m) for k, m in zip(n, sizes.values(), strict=True)):
            for i, (k, m) in enumerate(zip(n, sizes.values(), strict=True)):
                rate = (k + SMOOTH * share) / (m + SMOOTH)
                base[i] += math.log1p(-min(rate, 1 - 1e-6))
                logs[i][r["bucket"]] = round(math.log(rate) - math.log1p(-min(rate, 1 - 1e-6)), 4)
    return list(sizes), base, logs


def posteriors(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(doc_id, the columns ``more``, tokens, p): p an array with the probability of each domain."""
    domains, priors, logs = model
    rows = featured(docs, id_col, text_col, *more)

    def score(prior: float, values: list[float]) -> Column:
        weights = F.from_json(F.lit("[" + ",".join(f"{x:g}" for x in values) + "]"), "array<double>")  # folded to one constant
        return F.aggregate("buckets", F.lit(prior), lambda a, b: a + F.get(weights, b))

    scores = [score(*x) for x in zip(priors, logs, strict=True)]
    rows = rows.select("doc_id", *more, "tokens", F.array(*scores).alias("z"))
    rows = rows.select("doc_id", *more, "tokens", F.transform("z", lambda x: F.exp(x - F.array_max("z"))).alias("e"))
    return rows.select("doc_id", *more, "tokens", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b)).alias("p"))


def fit_rates(rows: DataFrame, domains: list[str], targets: dict[str, float], steps: int = STEPS, close: float = CLOSE, most_rate: float = MOST_RATE) -> tuple[Column, dict[str, tuple[float, float]]]:
    """(the rate as a Column over tokens and p, for each domain its reached and its wanted share). The Column holds the history of steps, one
    number a domain and step. Unmet targets are logged."""
    k, t = range(len(domains)), F.col("tokens").cast("double")
    p = [F.get("p", F.lit(d)) for d in k]
    rate = F.lit(1.0)
    cross = [(d, e) for d in k for e in k]

    def sums(r: Column) -> tuple[float, list[float], np.ndarray]:
        """All tokens; each domain's share of them at rate r; the cross products of the documents that are not at rate 0."""
        at = rows.select(t.alias("t"), "p", r.alias("r"))  # the rate is computed once a row
        held = F.when(F.col("r") > 0, F.col("t")).otherwise(0.0)
        got = at.agg(F.sum("t").alias("all"), *(F.sum(F.col("r") * F.col("t") * p[d]).alias(f"s{d}") for d in k), *(F.sum(held * p[d] * p[e]).alias(f"h{d}_{e}") for d, e in cross)).first()
        total = got["all"] or 0.0
        part = lambda x: (got[x] or 0.0) / total if total else 0.0
        return total, [part(f"s{d}") for d in k], np.array([part(f"h{d}_{e}") for d, e in cross]).reshape(len(k), len(k))

    total, now, products = sums(rate)
    aims = [targets.get(domains[d], 0.0) if now[d] > 1e-9 else 0.0 for d in k]
    if not total or not sum(aims):
        return rate, {n: (now[d], targets.get(n, 0.0)) for d, n in enumerate(domains)}
    aims = [a / sum(aims) for a in aims]
    for _ in range(steps):
        gaps = np.array(now) - aims
        if np.abs(gaps).max() < close:
            break
        # a document's gradient is tokens * sum of gap * p; scaled by its tokens and by the domains' cross products
        # the ridge follows a domain's own product, so that a rare domain moves as fast as a common one
        move = np.linalg.solve(products + RIDGE * np.diag(np.minimum(1.0, RIDGE_REACH * np.diag(products))) + 1e-9 * np.eye(len(k)), gaps)
        rate = F.greatest(F.lit(0.0), rate - sum((F.lit(float(move[d])) * p[d] for d in k), F.lit(0.0)))
        rate = rate if math.isinf(most_rate) else F.least(F.lit(most_rate), rate)
        _, now, products = sums(rate)
    wanted = {n: targets.get(n, 0.0) for n in {*domains, *targets}}
    scale = sum(wanted.values())
    reached = {n: (now[domains.index(n)] if n in domains else 0.0, w / scale) for n, w in sorted(wanted.items())}
    for name, (got, want) in reached.items():
        if abs(got - want) >= close:
            LOG.warning("mixing: domain %s reaches %.4f of the tokens, target %.4f", name, got, want)
    return rate, reached


def _rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None, id_col: str, text_col: str, max_rows: int, most_rate: float, carry: bool) -> tuple[DataFrame, list[str], dict]:
    """((doc_id, row if ``carry``, u, tokens, p, rate, copies), domains, reached shares): row is a struct of the columns of ``docs``."""
    scratch = Scratch(docs.sparkSession, "mixing")
    model = fit(docs, labels, id_col, text_col, max_rows)
    u = F.pmod(F.xxhash64(F.lit("mixing"), row_key(id_col, text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    inner = docs.select(*row, F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), u.alias("u"))
    rows = scratch.keep(posteriors(inner, model, "doc_id", "text", *(["row"] if carry else []), "u"), "posteriors")
    rate, reached = fit_rates(rows, model[0], TARGETS if targets is None else targets, most_rate=most_rate)
    return rows.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + F.col("u")).cast("long")), model[0], reached


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, most_rate: float = MOST_RATE) -> tuple[DataFrame, list[str], dict[str, tuple[float, float]]]:
    """((doc_id, tokens, p, rate, copies) of every row, the domains of p, for each domain its reached and its wanted share of the tokens)."""
    found, domains, reached = _rated(docs, labels, targets, id_col, text_col, max_rows, most_rate, carry=False)
    return found.select("doc_id", "tokens", "p", "rate", "copies"), domains, reached


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, most_rate: float = MOST_RATE) -> DataFrame:
    """``docs`` with each row as often as its copies say: the mixture itself. Rows travel with their posteriors, so no text is shuffled."""
    found, _, _ = _rated(docs, labels, targets, id_col, text_col, max_rows, most_rate, carry=True)
    return found.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
