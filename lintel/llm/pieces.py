"""Operator 5, SentencePiece encoding and decoding with byte offsets.

Offset-preserving: a text is normalised through the model's compiled character map, always taking the longest prefix
that the map knows; each output byte remembers which source bytes made it, so every piece is projected back to the
span of original bytes it stands for. Then the text is cut where no piece of the vocabulary can cross (before a space mark
that does not follow another one, and around characters that only occur in pieces of their own); such segments encode independently,
so the library's pieces of a segment are computed once and remembered in a bounded memo. The ids are decoded by the library.

The cut is derived from the vocabulary when the model is loaded; models that normalise white space away, treat white space as
a suffix or whose pieces cross such places are encoded as one segment a text, through the library alone.

Defined cases: null counts as empty (no ids); text of any length is encoded whole; ids carry no begin or end marks.
Rows are independent, so repeated rows give repeated results. Other columns are not read. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK, MEMO, BATCH, CHUNK = "▁", 60_000, 1_000, 1 << 18


class CharacterMap:
    """The compiled character map: a double-array trie over UTF-8 prefixes whose values point at replacement strings."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, np.uint32, size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest known prefix of data[at:]."""
        units, found = self.units, None
        offset = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
        node = offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.strings[value : self.strings.index(b"\0", value)]
        return found

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Replaced bytes, and for each of them (and the end) the source byte where its prefix begins. An empty map knows no prefix: each byte is its own."""
        if not self.units:
            return data, np.arange(len(data) + 1)
        out, source, at = bytearray(), [], 0
        while at < len(data):
            step = self.longest(data, at)
            if step is None:
                n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                step = n, data[at : at + n]
            out += step[1]
            source += [at] * len(step[1])
            at += step[0]
        return bytes(out), np.array([*source, len(data)])


class Encoder:
    """Encodes, decodes and projects pieces to source bytes; one for each Python worker and model."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        rules, pieces = proto.normalizer_spec, [p.piece for p in proto.pieces if p.type in (1, 4)]
        self.chars = CharacterMap(rules.precompiled_charsmap)
        self.prefix = rules.add_dummy_prefix
        several = [p for p in pieces if len(p) > 1]
        crossing = any(a != MARK and b == MARK for p in several for a, b in zip(p, p[1:], strict=False))
        self.lead = len(self.library.encode("\n"))
        self.line = np.array(self.library.encode("\n")[-1:], np.int32)
        known = proto.pieces[int(self.line[0])].type != 2 and self.library.encode("\n\n")[self.lead :] == self.line.tolist()
        self.plain = known and proto.trainer_spec.model_type == 2 and "\n" not in {c for p in several for c in p} and rules.escape_whitespaces and not (crossing or rules.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or any(p.type == 4 for p in proto.pieces))
        joined = {c for p in several for c in p}
        lone = "".join(c for c in "\n\t\r" if c not in joined)
        # a run of marks with what follows up to the next mark; line ends and tabs stand alone where no longer piece holds them
        self.segment = re.compile(f"[{lone}]|{MARK}*[^{MARK}{lone}]+|{MARK}+" if lone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type in (2, 3) else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        self.sizes = np.array([len(x) for x in self.surface], np.int64)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pieces_of(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment, as int32; segments that the memo lacks go to the library together, line ends between them."""
        memo, old = self.memo, self.old
        found = [memo.get(s) for s in segments]
        if None not in found:
            return found
        fresh = {s: old.get(s) for s, ids in zip(segments, found, strict=True) if ids is None}
        if "\n" in fresh:
            fresh["\n"] = self.line.tobytes()
        unknown = [s for s, ids in fresh.items() if ids is None]
        for at in range(0, len(unknown), BATCH):
            some = unknown[at : at + BATCH]
            # the dummy prefix is ours already: encode after a line end, which stays a piece of its own, then drop it
            ids = np.array(self.library.encode("\n" + "\n".join(some).replace(MARK, " "))[self.lead :], np.int32)
            ends, packed = np.append(np.flatnonzero(ids == self.line), len(ids)).tolist(), ids.tobytes()
            fresh.update(zip(some, (packed[4 * a : 4 * b] for a, b in zip([0, *(x + 1 for x in ends)], ends, strict=False)), strict=True))
        for s, ids in fresh.items():
            if len(s) <= 64:
                if len(self.memo) >= MEMO:  # what is asked for again comes back from the old half
                    self.old, self.memo = self.memo, {}
                self.memo[s] = ids
        return [fresh[s] if ids is None else ids for s, ids in zip(segments, found, strict=True)]

    def encode(self, text: str) -> tuple[list[int], str, np.ndarray]:
        """(ids, decoded text, source byte where each piece begins, and the end)."""
        if not text:
            return [], "", np.zeros(1, np.int64)
        if not self.plain or "\0" in text or MARK in text:
            return self.whole(text)
        data, source = self.chars.normalise(text.encode())
        marked = data.decode().replace(" ", MARK)
        packed = np.frombuffer(b"".join(self.pieces_of(self.segment.findall(MARK + marked if self.prefix else marked))), np.int32)
        ids = packed.tolist()
        starts = np.concatenate(([0], np.cumsum(self.sizes[packed])))
        if self.prefix:
            starts = np.maximum(starts - 1, 0)
        return ids, self.library.decode(ids), source[np.minimum(starts, len(source) - 1)]

    def whole(self, text: str) -> tuple[list[int], str, np.ndarray]:
        """The library's own pieces and offsets of the whole text."""
        pieces = self.library.encode_as_proto(text).pieces
        ids = [p.id for p in pieces]
        return ids, self.library.decode(ids), np.array([*(p.begin for p in pieces), len(text.encode())])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(batch: pa.RecordBatch, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with ``most`` bytes of text or a single row."""
    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)])
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, side="right")))
        yield batch.slice(at, n)
        at += n


def _lists(rows: list[np.ndarray], kind: type) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, kind)))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_pieces: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 and, if asked for, ids and starts (source bytes; one more than ids)."""

    def encoded(batches):
        one = encoder(model)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for texts in slices(batch):  # what leaves at once stays small, however many pieces a batch has
                ids, columns = [], [[], [], [], []]
                starts = []
                for value in texts.column(1):
                    found, decoded, at = one.encode(value.as_py() or "")
                    said = str(found)[1:-1].replace(" ", "")  # the ids with commas between
                    for column, x in zip(columns, (len(found), digest(said.encode()), digest(decoded.encode("utf-8", "surrogatepass")), digest(at.astype("<i8").tobytes())), strict=True):
                        column.append(x)
                    if with_pieces:
                        ids.append(np.array(found, np.int32))
                        starts.append(at.astype(np.int32))
                lists = [_lists(ids, np.int32), _lists(starts, np.int32)] if with_pieces else []
                arrays = [texts.column(0), *(pa.array(c, f.type) for c, f in zip(columns, fields, strict=False)), *lists]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f.name for f in fields)])

    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = [pa.field("n_tokens", pa.int64()), *(pa.field(f"{x}_sha256", pa.string()) for x in ("ids", "decoded", "spans"))]
    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    if with_pieces:
        fields += [pa.field("ids", pa.list_(pa.int32())), pa.field("starts", pa.list_(pa.int32()))]
        shape += ", ids array<int>, starts array<int>"
    return docs.mapInArrow(encoded, shape)
