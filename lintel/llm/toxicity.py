"""Operator 6, toxicity by a factorization machine over hashed terms.

Score = sigmoid(bias + sum of w_i + sum over pairs of <v_i, v_j>) over the hashed terms a text holds. The pairwise part
learns what an additive model misses, such as an insult that only counts together with the mention of a group.

Fitting uses at most ``max_rows`` labelled rows (by a hash of the identifier; rare labels first, the machine's bias is set back to the label shares of all
rows). The machine's inputs are hashed terms of two kinds, as many as pass: those whose document rates differ between the labels by
LEAST_ERRORS standard errors, and those of pairs that tell more together than either term alone: pairs of at least PAIR_DOCS documents whose
rates differ by PAIR_ERRORS standard errors, and by PAIR_GAIN more than those of their terms. So a term that says nothing by itself gets in with
its partner, however large the vocabulary is. Pairs are sought by pruning: Spark counts terms and leaves those out that could not pass if all their
documents of one label were the pair's; terms of the same documents are counted as one; and the pair's documents of that label alone are
counted first. Then the machine is fitted by gradient steps on the log loss. Scoring reads all rows and whole texts.

Defined cases: null and empty texts hold no term and score the machine's bias; terms count once a text, so length does not
matter; if no labelled row or only one label is found, every score is the share of label 1 (0 without labels). A null
identifier counts as not held out. Identifiers may be of any type; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stratified_sample

BUCKETS, FACTORS, MAX_ROWS, EPOCHS = 1 << 22, 4, 20_000, 8
LEAST_DOCS, LEAST_ERRORS, MEMO = 8, 5.0, 200_000
PAIR_DOCS, PAIR_ERRORS, PAIR_GAIN = 40, 9.0, 5.0
_WORD = re.compile(r"\w+")


def buckets_of(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings of 3 to 8 characters, which also stand for forms of it that were never seen."""
    data = [word, *(f"{word[:n]}-" for n in range(3, 9) if len(word) > n)]
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in data)


def hashed_terms(text: str, memo: dict[str, tuple], places: dict[int, int] | None = None) -> set[int]:
    """Buckets of the lower-cased words in the whole text; with ``places``, the places of those that it holds."""
    if len(memo) > MEMO:
        memo.clear()
    out: set[int] = set()
    for word in set(_WORD.findall(text.lower())):
        found = memo.get(word)
        if found is None:
            found = buckets_of(word)
            found = memo[word] = found if places is None else tuple(places[b] for b in found if b in places)
        if found:
            out.update(found)
    return out


@dataclass
class Machine:
    inputs: dict[int, int]  # bucket -> row of w and v
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, rows: list[int]) -> float:
        z = self.bias
        if rows:
            factors = self.v[rows]
            total = factors.sum(axis=0)
            z += self.w[rows].sum() + 0.5 * float((total * total).sum() - (factors * factors).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sizes(rows: DataFrame) -> tuple[int, int]:
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    return n.get(1, 0), n.get(0, 0)


def select_inputs(rows: DataFrame) -> tuple[list[int], list[int]]:
    """(telling buckets, hopeful buckets). Telling: document rates that differ between the labels by LEAST_ERRORS standard errors or more, the most
    distinct first. Hopeful: the others of which a pair could differ by PAIR_ERRORS if it had all their documents of one label and none of the other.

    ``rows``: x (array of buckets), y. Counted by Spark: only the chosen buckets come to the driver.
    """
    n1, n0 = _sizes(rows)
    if not n1 or not n0:
        return [], []
    counts = rows.select("y", F.explode("x").alias("bucket")).groupBy("bucket").agg(F.sum("y").alias("k1"), F.count("*").alias("docs")).filter(F.col("docs") >= LEAST_DOCS)

    def errors(k1: Column, k0: Column) -> Column:
        p = (k1 + k0) / (n1 + n0)
        return F.abs(k1 / n1 - k0 / n0) / F.sqrt(F.greatest(p * (1 - p) * (1 / n1 + 1 / n0), F.lit(1e-12)))

    k1, k0, none = F.col("k1"), F.col("docs") - F.col("k1"), F.lit(0)
    hope = F.when(F.col("docs") >= PAIR_DOCS, F.greatest(errors(k1, none), errors(none, k0))).otherwise(0.0)
    judged = counts.select("bucket", errors(k1, k0).alias("errors"), hope.alias("hope"))
    found = judged.filter((F.col("errors") >= LEAST_ERRORS) | (F.col("hope") >= PAIR_ERRORS)).collect()
    telling = [r["bucket"] for r in sorted(found, key=lambda r: (-r["errors"], r["bucket"])) if r["errors"] >= LEAST_ERRORS]
    return telling, sorted(r["bucket"] for r in found if r["errors"] < LEAST_ERRORS)


def _bits(rows: list[np.ndarray], n: int) -> np.ndarray:
    """For each place below ``n`` the rows that hold it, as bits of 64-bit words."""
    parts = []
    for at in range(0, max(len(rows), 1), 1024):
        held = np.zeros((n, 1024), bool)
        for i, r in enumerate(rows[at : at + 1024]):
            held[r, i] = True
        parts.append(np.packbits(held, axis=1).view(np.uint64))
    return np.concatenate(parts, axis=1)


def telling_pairs(x: list[np.ndarray], labels: np.ndarray, n: int) -> list[int]:
    """Places below ``n`` that tell the labels apart with a partner better than alone, those of the best pairs first."""
    rows = [[r for r, y in zip(x, labels, strict=True) if (y > 0.5) == side] for side in (True, False)]
    sizes = tuple(map(len, rows))
    if not all(sizes) or not n:
        return []

    def errors(k1: np.ndarray, k0: np.ndarray) -> np.ndarray:
        p = (k1 + k0) / sum(sizes)
        return np.abs(k1 / sizes[0] - k0 / sizes[1]) / np.sqrt(np.maximum(p * (1 - p) * (1 / sizes[0] + 1 / sizes[1]), 1e-12))

    bits = [_bits(side, n) for side in rows]
    classes: dict[bytes, list[int]] = {}  # terms of the same documents, by a digest of those
    for place in range(n):
        classes.setdefault(hashlib.blake2b(bits[0][place].tobytes() + bits[1][place].tobytes(), digest_size=16).digest(), []).append(place)
    members = list(classes.values())
    first = np.array([m[0] for m in members])
    for i in (0, 1):
        bits[i] = bits[i][first]  # terms of the same documents once
    count = lambda w: np.bitwise_count(w).sum(axis=-1, dtype=np.int64)
    held = [count(side) for side in bits]
    alone = errors(*held)
    found = {}
    for one, other in ((0, 1), (1, 0)):  # pairs that are commoner in the first label, then in the second
        most = errors(*((np.arange(sizes[one] + 1), 0) if one == 0 else (0, np.arange(sizes[one] + 1))))  # by documents of that label
        enough = int(np.argmax(most >= PAIR_ERRORS)) if (most >= PAIR_ERRORS).any() else sizes[one] + 1
        able = np.flatnonzero(held[one] >= enough)
        mine, theirs, bound = bits[one][able], bits[other][able], alone[able]
        for i in range(len(able) - 1):
            k = count(mine[i] & mine[i + 1 :])
            need = np.maximum(np.maximum(bound[i], bound[i + 1 :]) + PAIR_GAIN, PAIR_ERRORS)
            hopeful = np.flatnonzero(most[k] >= need)
            k, rest = k[hopeful], count(theirs[i] & theirs[i + 1 + hopeful])
            z = np.where(k + rest >= PAIR_DOCS, errors(*((k, rest) if one == 0 else (rest, k))), 0)
            for j in np.flatnonzero(z >= need[hopeful]):
                pair = able[i], able[i + 1 + hopeful[j]]
                found[pair] = z[j] - max(alone[pair[0]], alone[pair[1]])
    ranked = sorted((-gain, *sorted((members[i], members[j]))) for (i, j), gain in found.items())
    return list(dict.fromkeys(place for _, left, right in ranked for place in (*left, *right)))


def fit(x: list[np.ndarray], labels: np.ndarray, chosen: list[int], factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 5) -> Machine:
    """``x``: for each row the places in ``chosen`` of the buckets it holds."""
    share = float(labels.mean()) if len(labels) else 0.0
    bias = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    if not 0 < share < 1:
        return Machine({}, bias, np.zeros(0), np.zeros((0, factors)))
    inputs = {b: i for i, b in enumerate(chosen)}
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(inputs)), rng.normal(0, 0.1, (len(inputs), factors))
    gw, gv, gb = np.full(len(w), 1e-2), np.full(v.shape, 1e-2), 1e-2
    for _ in range(epochs):  # one adaptive gradient step a row; the decay keeps terms of few rows small
        for i in rng.permutation(len(x)):
            at = x[i]
            f = v[at]
            total = f.sum(axis=0)
            z = bias + w[at].sum() + 0.5 * ((total * total).sum() - (f * f).sum())
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]
            gb += g * g
            bias -= 0.2 * g / np.sqrt(gb)
            if len(at):
                dw, dv = g + 1e-3 * w[at], g * (total - f) + 1e-3 * f
                gw[at] += dw * dw
                gv[at] += dv * dv
                w[at] -= 0.2 * dw / np.sqrt(gw[at])
                v[at] = f - 0.05 * dv / np.sqrt(gv[at])
    return Machine(inputs, float(bias), w, v)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Machine:
    """Fits on at most ``max_rows`` rows of ``labelled``, equal texts counting once. What comes to the driver are the chosen buckets, and for each
    row the places of those that it holds."""

    def hashed(batches):
        memo: dict[str, tuple] = {}
        for batch in batches:
            found = [sorted(hashed_terms(t.as_py() or "", memo)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["x", "y"])

    rows = labelled.filter(F.col(f"`{label_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{label_col}`").cast("int").alias("y"))
    scratch = Scratch(labelled.sparkSession, "toxicity")
    sample, taken = stratified_sample(rows, "id", "y", max_rows)
    held = scratch.keep(sample.select("text", "y").mapInArrow(hashed, "x array<int>, y int"), "terms")
    once = held.groupBy(F.xxhash64("x"), "y").agg(F.first("x").alias("x")).select("x", "y")
    telling, hopeful = select_inputs(once)
    places = {b: i for i, b in enumerate([*telling, *hopeful])}

    def placed(batches):
        for batch in batches:
            found = [sorted(places[b] for b in r if b in places) for r in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([np.array(r, np.uint32).tobytes() for r in found], pa.binary()), batch.column(1)], ["x", "y"])

    got = once.select("x", "y").mapInArrow(placed, "x binary, y int").toPandas().sort_values(["x", "y"])
    scratch.drop(held)
    x, y = [np.frombuffer(v, np.uint32) for v in got["x"]], got["y"].to_numpy(float)
    chosen = list(dict.fromkeys([*range(len(telling)), *telling_pairs(x, y, len(places))]))  # the pairs' terms after the telling ones
    new = np.full(len(places), -1)
    new[chosen] = np.arange(len(chosen))
    buckets = [*telling, *hopeful]
    machine = fit([r[r >= 0] for r in (new[r] for r in x)], y, [buckets[i] for i in chosen])
    if taken.get(0) and taken.get(1):  # labels that were sampled more thinly are that much more frequent
        machine.bias += float(np.log(taken[0] / taken[1]))
    return machine


def scored(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""

    def scores(batches):
        memo: dict[str, tuple] = {}
        for batch in batches:
            out = [machine.score(sorted(hashed_terms(text.as_py() or "", memo, machine.inputs))) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(scores, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
