"""Operator 2, secret scans: fixed patterns, plus character Markov models of random strings and of ordinary identifiers.

The patterns give the base spans (kinds assign, access, hex). The method adds spans of kind ``markov``: every other run of
8 or more characters of ``[A-Za-z0-9+/_=-]``, words apart, that a model of random strings explains better than the model of identifiers. The
log-likelihood ratio has to reach ``least_ratio`` in all and ``per_char`` for each character and ``SHORT`` more, so that short runs need more a character.
Words are runs of under 20 letters, with no capital but the first or in capitals throughout; identifiers also count as they look in capitals.

The models are first-order chains over characters, counted by Spark from labelled samples: values that the patterns
found in at most ``max_rows`` of the rows that hold such a value (label random; by a hash of the identifier) and the other words of those rows (label
identifier). Random strings have one chain for each alphabet that keys are written in, counted from the samples whose smallest
alphabet it is and smoothed towards an even choice of its characters; the best chain counts, less the price of choosing among them.

Defined cases: null counts as empty; positions are code points, ends exclusive; base spans always stay, and a markov span never
overlaps one. An empty sample leaves all models at their priors, which add no span. Rows are independent, so repeated
rows give repeated results; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

MAX_ROWS, LEAST, LEAST_RATIO, PER_CHAR, SHORT = 10_000, 8, 12.0, 0.6, 16
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Every text with a base span matches this, in Java's reading too; a few others may.
MAY_HOLD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
#: A run of the characters that keys are made of, but for words.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?!(?:[A-Za-z][a-z]{7,18}|[A-Z]{8,19})(?![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{%d,}" % LEAST)
WORD = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
_CLASSES = {c: i for i, c in enumerate("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-")}
_N = len(_CLASSES)
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The alphabets of random strings, smaller ones first.
ALPHABETS = (_DIGITS + _LOWER[:6], _DIGITS + _UPPER[:6], _LOWER, _UPPER, _DIGITS + _LOWER, _DIGITS + _UPPER, _DIGITS + _LOWER + _UPPER, "".join(_CLASSES))
_CODE = np.full(128, 0, np.int64)
for _c, _i in _CLASSES.items():
    _CODE[ord(_c)] = _i


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the leftmost non-overlapping matches of each kind that are long enough."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def pairs_of(token: str) -> np.ndarray:
    """Codes of the neighbouring character pairs."""
    code = _CODE[np.frombuffer(token.encode(), np.uint8)]
    return code[:-1] * _N + code[1:]


def alphabet_of(token: str) -> int:
    """The smallest alphabet that has all of its characters."""
    return next(i for i, chars in enumerate(ALPHABETS) if set(token) <= set(chars))


def log_ratios(counts: np.ndarray, prior: float = 5.0, ordinary_prior: float = 0.2) -> np.ndarray:
    """log P(next | previous, random) - log P(next | previous, ordinary) by alphabet and pair code; pairs outside an alphabet are far below any bound.

    ``counts``: a row of pair counts for each alphabet and, last, for identifiers. Without identifiers there is nothing to tell apart: all zero.
    """
    chances = lambda table: np.log(table / table.sum(axis=1, keepdims=True))
    out = np.full((len(ALPHABETS), _N, _N), -1e9)
    if not counts[-1].any():
        return np.zeros((len(ALPHABETS), _N * _N))
    ordinary = counts[-1].reshape(_N, _N)
    capital = [_CLASSES[c.upper()] for c in _CLASSES]  # what identifiers look like in capitals, a tenth as often
    in_capitals = np.zeros((_N, _N))
    np.add.at(in_capitals, np.ix_(capital, capital), ordinary)
    ordinary = chances(ordinary + 0.1 * in_capitals + ordinary_prior)
    for i, chars in enumerate(ALPHABETS):
        at = np.ix_(*[[_CLASSES[c] for c in chars]] * 2)
        out[i][at] = chances(counts[i].reshape(_N, _N)[at] + prior) - ordinary[at]
    return out.reshape(len(ALPHABETS), -1)


def ratio_of(token: str, ratios: np.ndarray) -> float:
    """The log-likelihood ratio of the alphabet that explains a run best, less the price of the choice."""
    return float(ratios[:, pairs_of(token)].sum(axis=1).max()) - float(np.log(len(ALPHABETS)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> np.ndarray:
    """Log-likelihood ratios by alphabet and character pair. What comes to the driver is one count a pair and label."""

    labels = len(ALPHABETS) + 1

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((labels, _N * _N), np.int64)
        for batch in batches:
            words: list[Counter] = [Counter(), Counter()]
            for value in batch.column(0):
                text = value.as_py() or ""
                spans, at = base_spans(text), 0
                for start, end, kind in spans:
                    words[1].update(WORD.findall(text[at:start]) if start > at else ())
                    token = text[start:end] if kind != "assign" else ASSIGN.match(text, start)[2].replace(".", "")
                    words[0][token] += 1
                    at = max(at, end)
                words[1].update(WORD.findall(text[at:]))
            for kind, found in enumerate(words):
                for token, n in found.items():
                    if len(token) > 1:
                        np.add.at(both[-1 if kind else alphabet_of(token)], pairs_of(token), n)
        label, pair = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(pair, pa.int32()), pa.array(both[label, pair], pa.int64())], ["label", "pair", "n"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter(F.col("text").rlike(MAY_HOLD))
    rows = bounded_sample(rows, "id", max_rows).select("text")
    counts = np.zeros((labels, _N * _N))
    for r in rows.mapInArrow(labelled, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
        counts[r["label"], r["pair"]] = r["n"]  # at most 9 * 67 * 67 rows
    return log_ratios(counts)


def spans_of(text: str, ratio: np.ndarray, least_ratio: float = LEAST_RATIO, per_char: float = PER_CHAR) -> tuple[list, list]:
    """(base spans, all spans), each sorted by start and kind."""
    base = base_spans(text)
    more = []
    for m in TOKEN.finditer(text):
        start, end = m.span()
        if any(s < end and start < e for s, e, _ in base):
            continue
        total = ratio_of(m[0], ratio)
        if total >= least_ratio and total >= per_char * (end - start + SHORT):
            more.append((start, end, "markov"))
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2])))


def scan(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", least_ratio: float = LEAST_RATIO, per_char: float = PER_CHAR) -> DataFrame:
    """Per row: doc_id, base and spans, arrays of (kind, start, end)."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, list] = ([], [])
            for value in batch.column(1):
                for out, found in zip(columns, spans_of(value.as_py() or "", ratio, least_ratio, per_char), strict=True):
                    out.append([{"kind": k, "start": s, "end": e} for s, e, k in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(span)) for c in columns)], ["doc_id", "base", "spans"])

    shape = "array<struct<kind:string,start:long,end:long>>"
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(scanned, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base {shape}, spans {shape}")


def redact(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; other columns stay."""

    @F.arrow_udf("string")
    def redacted(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            text = value.as_py()
            if text is not None:
                parts, at = [], 0
                for start, end, _ in spans_of(text, ratio)[1]:
                    if end > at:
                        parts += [text[at:start], mark] if start >= at else []
                        at = end
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, redacted(F.col(f"`{text_col}`").cast("string")))


def joined(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
