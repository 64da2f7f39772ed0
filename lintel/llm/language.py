"""Operator 7, language identification by error-correcting output codes.

Every language gets a codeword of bits. One binary classifier a bit (logistic regression over hashed character 1- to
3-grams) predicts that bit; decoding sums each codeword's logistic loss over the bits, every bit weighted by how well
its classifier did on rows that it wasn't fitted on, and takes the nearest codeword. The score is the share of
exp(-loss) that the winner has; a document is flagged ambiguous where the runner-up is too near.

Fitting uses at most ``max_rows`` labelled rows (rare languages first, by a hash of the identifier), everything else reads all rows and whole texts.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; one learned language gives that language
with score 1; no labelled row at all gives ``und`` everywhere. A null identifier counts as not held out. Identifiers may be of any type; other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stratified_sample

BUCKETS, MAX_ROWS, STEPS, MARGIN = 2048, 4000, 150, 0.2
_A, _B, _C = (np.uint32(x) for x in (2654435761, 2246822519, 3266489917))
_SPAN = 1 << 16


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Square-rooted shares of hashed character n-grams (1 to 3) of the whole text, scaled to length 1."""
    text, total = text.lower(), np.zeros(buckets)
    shift = np.uint32(32 - buckets.bit_length() + 1)
    for at in range(0, len(text), _SPAN):  # spans overlap by two characters, so that no n-gram is lost
        points = np.frombuffer(text[max(at - 2, 0) : at + _SPAN].encode("utf-32-le", "surrogatepass"), np.uint32)
        one = points * _A
        two = (one[:-1] ^ (points[1:] * _B)) * _C
        three = (two[:-1] ^ (points[2:] * _A)) * _B
        lead = min(at, 2)
        for grams in (one[lead:], two[max(lead - 1, 0) :], three):
            total += np.bincount(grams >> shift, minlength=buckets)
    root = np.sqrt(total)
    return root / (np.linalg.norm(root) or 1)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1. Up to six languages: all splits in two; beyond, the random code of widest least distance of 200."""
    if n <= 6:
        return np.array([[1 if i == 0 or (c >> (i - 1)) & 1 else -1 for c in range(2 ** (n - 1) - 1)] for i in range(n)])
    rng, best, bits = np.random.default_rng(seed), None, max(15, int(np.ceil(8 * np.log2(n))))
    for _ in range(200):
        code = rng.choice([-1, 1], (n, bits))
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        both = (np.abs(code.sum(axis=0)) < n).all()
        if both and (best is None or apart > best[0]):
            best = apart, code
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # a weight for each bit's loss

    def decode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, margin to the runner-up) of each row of features."""
        if len(self.langs) == 1:
            return np.zeros(len(rows), int), np.ones(len(rows)), np.ones(len(rows))
        out = rows @ self.weights + self.bias
        loss = (np.logaddexp(0, -out[:, None, :] * self.code[None]) * self.trust).sum(axis=2)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        top = np.sort(share, axis=1)
        return loss.argmin(axis=1), top[:, -1], top[:, -1] - top[:, -2]


def fit(rows: np.ndarray, langs: list[str], steps: int = STEPS) -> Model | None:
    if not langs:
        return None
    names = sorted(set(langs))
    code, y = codewords(len(names)), np.array([names.index(x) for x in langs])
    if len(names) == 1:
        return Model(names, code, np.zeros((rows.shape[1], 0)), np.zeros(0), np.zeros(0))
    share = np.bincount(y) / len(y)
    weight = (1 / (len(names) * share))[y][:, None] / len(y)
    test = np.arange(len(y)) % 5 == 4
    target = code[y].astype(np.float32)

    def descend(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, t, c = rows[keep].astype(np.float32), target[keep], weight[keep].astype(np.float32)
        w, b = np.zeros((x.shape[1], t.shape[1]), np.float32), np.zeros(t.shape[1], np.float32)
        vw, vb = w.copy(), b.copy()
        for _ in range(steps):  # gradient descent with momentum
            g = -c * t / (1 + np.exp(t * (x @ w + b)))
            vw, vb = 0.9 * vw + x.T @ g + 1e-6 * w, 0.9 * vb + g.sum(axis=0)
            w, b = w - 8 * vw, b - 8 * vb
        return w, b

    w, b = descend(~test) if test.any() else descend(test | True)
    error = ((np.sign(rows[test] @ w + b) != target[test]).mean(axis=0) if test.any() else np.zeros(code.shape[1])).clip(0.01, 0.49)
    trust = np.log((1 - error) / error)
    w, b = descend(test | True)
    return Model(names, code, w, b, trust * len(trust) / trust.sum())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS, buckets: int = BUCKETS) -> Model | None:
    """Fits on at most ``max_rows`` rows of ``labelled`` that have text and language; their features, not their texts, go to the driver."""

    def featured(batches):
        for batch in batches:
            found = [features(t.as_py(), buckets).astype(np.float32).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["x", "lang"])

    text, lang = F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
    rows = labelled.filter(text.isNotNull() & lang.isNotNull())
    rows, _ = stratified_sample(rows.select(F.col(f"`{id_col}`").alias("id"), text, lang), "id", "lang", max_rows)
    got = rows.select("text", "lang").mapInArrow(featured, "x binary, lang string").toPandas().sort_values(["lang", "x"])
    x = np.array([np.frombuffer(v, np.float32) for v in got["x"]]).reshape(-1, buckets)
    order = np.random.default_rng(11).permutation(len(x))
    return fit(x[order], [got["lang"].iloc[i] for i in order])


def _judged(texts: pa.Array, model: Model | None, buckets: int):
    """(places, what ``decode`` says) of the texts with a letter, 256 at a time: only those are held as text and features."""
    for at in range(0, len(texts) if model else 0, 256):
        part = [(i, t) for i, v in enumerate(texts[at : at + 256], at) if has_letter(t := v.as_py() or "")]
        if part:
            yield [i for i, _ in part], model.decode(np.array([features(t, buckets) for _, t in part]))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN, buckets: int = BUCKETS) -> DataFrame:
    """Per row: doc_id, lang_pred, score, ambiguous."""

    def predicted(batches):
        for batch in batches:
            n = batch.num_rows
            langs, scores, doubt = ["und"] * n, [0.0] * n, [True] * n
            for part, (best, score, apart) in _judged(batch.column(1), model, buckets):
                for i, k, s, a in zip(part, best, score, apart, strict=True):
                    langs[i], scores[i], doubt[i] = model.langs[k], float(s), bool(a < margin)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores), pa.array(doubt)], ["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(predicted, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")


def keep_known(docs: DataFrame, model: Model | None, text_col: str = "text", margin: float = MARGIN, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` whose language can be told: neither ``und`` nor ambiguous. Judged row by row, without a join."""

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        out = [False] * len(texts)
        for part, (_, _, apart) in _judged(texts, model, buckets):
            for i, a in zip(part, apart, strict=True):
                out[i] = bool(a >= margin)
        return pa.array(out, pa.bool_())

    return docs.filter(known(F.col(f"`{text_col}`").cast("string")))


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % folds == fold, F.lit(False))
