"""Operator 11, byte-level BPE encoding and decoding by recursive queries that DuckDB runs inside each partition.

A text is cut into words by the vocabulary's pattern. Words that the partition has not met lately become token-position rows, one a byte,
that name the position that follows them. A recursive query joins neighbours with the merge table, takes each word's smallest rank, then
its leftmost place, contracts there, and goes on until no pair of a word is in the table. The merge table has every division of a token in
two tokens, so a pair is found exactly if its bytes together are a token. Ordered aggregation gives the ids of a word in order, and decodes
them: tokens are joined with their bytes, which are put together by position. A text's ids are those of its words.

A step contracts all places of the smallest rank that don't overlap if no pair with the new token has a smaller rank (``safe`` in
the merge table): the places after the leftmost would come next anyway. Otherwise it contracts the leftmost place alone.

Words are remembered in two halves of at most ``MEMO`` words, of which the older one goes; a chunk of ``CHUNK`` bytes of text, or ``PART``
words of a longer text, meets DuckDB at a time, so memory does not grow with a partition, a text or a vocabulary of words.

Defined cases: null counts as empty (no ids; digests of nothing); texts of any length are encoded whole; special tokens are ordinary text. Rows
are independent, so repeated rows give repeated results. ``decode`` gives null for null ids and for ids outside the vocabulary. Other
columns pass (``decode``) or are not read (``encode``). An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name
from .pieces import slices

MEMO, CHUNK, PART, MEMORY = 300_000, 1 << 21, 1 << 18, "600MB"

#: ``start`` has a row a byte: position over all words, word, token and the next position of the word (-1 at its end).
#: A pair's key is its rank and, in the lower 32 bits, its position.
ENCODE = """
WITH RECURSIVE t (pos, word, token, next, done) AS (
  SELECT pos, word, token, next, false FROM start
  UNION ALL (
    WITH pairs AS MATERIALIZED (
      SELECT a.word, a.pos, a.next AS gone, b.next, a.token = b.token AS twin, m.merged, m.safe
      FROM t a JOIN t b ON a.next = b.pos JOIN merges m ON a.token = m.first AND b.token = m.second WHERE NOT a.done AND NOT b.done),
    best AS MATERIALIZED (SELECT word, min(merged::BIGINT * 4294967296 + pos) AS key FROM pairs GROUP BY word),
    places AS MATERIALIZED (
      SELECT p.* FROM pairs p JOIN best ON p.word = best.word AND p.merged = best.key // 4294967296 WHERE p.safe OR p.pos = best.key % 4294967296),
    runs AS (  -- of places that overlap, as in aaaa, every other one
      SELECT pos, sum(fresh::INT) OVER (ORDER BY pos) AS run FROM (SELECT pos, coalesce(lag(gone) OVER (ORDER BY pos) <> pos, true) AS fresh FROM places WHERE twin)),
    overlapped AS (SELECT pos FROM (SELECT pos, row_number() OVER (PARTITION BY run ORDER BY pos) AS nth FROM runs) WHERE nth % 2 = 0),
    chosen AS MATERIALIZED (SELECT pos, gone, next, merged FROM places WHERE pos NOT IN (SELECT pos FROM overlapped))
    SELECT t.pos, t.word, coalesce(c.merged, t.token), CASE WHEN c.pos IS NULL THEN t.next ELSE c.next END, best.word IS NULL
    FROM t LEFT JOIN best ON t.word = best.word LEFT JOIN chosen c ON c.pos = t.pos WHERE NOT t.done AND t.pos NOT IN (SELECT gone FROM chosen)))
SELECT word, string_agg(token::VARCHAR, ' ' ORDER BY pos) AS ids, unhex(string_agg(v.bytes, '' ORDER BY pos)) AS decoded
FROM t JOIN vocabulary v ON v.id = t.token WHERE done GROUP BY word"""

DECODE = """
SELECT r.row, CASE WHEN count(*) = count(v.id) THEN unhex(coalesce(string_agg(v.bytes, '' ORDER BY r.pos), '')) END AS decoded
FROM rows r LEFT JOIN vocabulary v ON v.id = r.id GROUP BY r.row"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks, which are their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(first, second, merged, safe) of every division of a token in two tokens."""
    rows = np.array([(a, b, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None], np.int32).reshape(-1, 3)
    whole = np.maximum(rows[:, 0], rows[:, 1])
    late = np.unique(whole[rows[:, 2] <= whole])  # tokens that come after one that they are part of
    return pa.table({"first": rows[:, 0], "second": rows[:, 1], "merged": rows[:, 2], "safe": ~np.isin(rows[:, 2], late)})


class Codec:
    """The vocabulary in a DuckDB of one Python worker, and the words that it met lately."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks, self.words = read_ranks(path), regex.compile(pattern)
        self.duck = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self._load("merges", merge_table(self.ranks))
        self._load("vocabulary", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": [t.hex() for t in self.ranks]}))
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}  # words that don't decode to themselves

    def _load(self, name: str, rows: pa.Table) -> None:
        self.duck.register("given", rows)
        self.duck.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.duck.unregister("given")

    def _ask(self, query: str, name: str, rows: pa.Table) -> list[tuple]:
        self.duck.register(name, rows)
        found = self.duck.execute(query).fetchall()
        self.duck.unregister(name)
        return found

    def contract(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids with blanks between, bytes that they decode to) of each word, none of them empty."""
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        pos = np.arange(ends[-1], dtype=np.int32)
        follows = pos + 1
        follows[ends - 1] = -1
        start = {"pos": pos, "word": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "token": self.byte[np.frombuffer(b"".join(words), np.uint8)], "next": follows}
        out: list = [None] * len(words)
        for word, ids, decoded in self._ask(ENCODE, "start", pa.table(start)):
            out[word] = ids.encode(), decoded
        return out

    def learn(self, lists: list[list[str]]) -> None:
        """Afterwards the memo has every word of ``lists``. A word that is a token is that token, as its pairs need not lead there."""
        if len(self.memo) > MEMO:
            self.old, self.memo = self.memo, {}
        memo, unknown = self.memo, []
        for word in {w for words in lists for w in words if w not in memo}:
            ids, data = self.old.get(word), word.encode()
            if ids is not None:
                memo[word] = ids
            elif data in self.ranks:
                memo[word] = b"%d" % self.ranks[data]
            else:
                unknown.append((word, data))
        if not unknown:
            return
        for (word, data), (ids, decoded) in zip(unknown, self.contract([data for _, data in unknown]), strict=True):
            memo[word] = ids
            if decoded != data:
                self.odd[word] = decoded

    def parts(self, text: str) -> Iterator[list[str]]:
        """The words of a text, ``PART`` at most at a time."""
        if len(text) <= PART:
            yield self.words.findall(text)
            return
        found = self.words.finditer(text)
        while part := [m.group() for m in islice(found, PART)]:
            yield part

    def joined(self, words: list[str]) -> tuple[bytes, bytes]:
        """(ids with blanks between, decoded bytes) of learnt words."""
        decoded = "".join(words).encode() if not self.odd else b"".join(self.odd.get(w) or w.encode() for w in words)
        return b" ".join(map(self.memo.__getitem__, words)), decoded

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str, bytes]]:
        """(number of ids, digest of the ids, digest of the decoded bytes, ids with blanks between) of each text."""
        short = [self.words.findall(t) if len(t) <= PART else None for t in texts]
        self.learn([words for words in short if words])
        for text, words in zip(texts, short, strict=True):
            if words is not None:
                ids, decoded = self.joined(words)
                yield ids.count(b" ") + bool(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids
                continue
            said, of_ids, of_text = [], hashlib.sha256(), hashlib.sha256()
            for part in self.parts(text):
                self.learn([part])
                ids, decoded = self.joined(part)
                of_ids.update(b" " + ids if said else ids)
                of_text.update(decoded)
                said.append(ids)
            self.learn([words for words in short if words])  # a long text may have turned the memo over
            ids = b" ".join(said)
            yield ids.count(b" ") + 1, of_ids.hexdigest(), of_text.hexdigest(), ids

    def decode(self, lists: pa.ListArray) -> list[bytes | None]:
        """The bytes of each list of ids."""
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        rows = {"row": np.repeat(np.arange(len(lists)), sizes), "pos": np.arange(ends[-1] if len(ends) else 0), "id": lists.flatten()}
        out = [b"" if x else None for x in lists.is_valid().to_pylist()]
        for row, decoded in self._ask(DECODE, "rows", pa.table(rows)):
            out[row] = decoded
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids."""

    def encoded(batches):
        one = codec(path, pattern)
        for batch in batches:
            for some in slices(batch, CHUNK):
                found = [*one.encode([t.as_py() or "" for t in some.column(1)])]
                arrays = [some.column(0), *(pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string())))]
                if with_ids:
                    arrays.append(pa.array([np.array(r[3].split(), np.int32) for r in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names)

    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.mapInArrow(encoded, shape)


def decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that the ids stand for."""
    name = free_name(out_col, rows.columns)
    at = rows.columns.index(ids_col)

    def decoded(batches):
        one = codec(path, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(one.decode(some.column(at)), pa.binary())], [*batch.schema.names, "decoded"])

    plain = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))  # names with dots are none that tasks in Arrow can have
    return plain.mapInArrow(decoded, plain.withColumn("decoded", F.lit(None).cast("binary")).schema).toDF(*rows.columns, name)
