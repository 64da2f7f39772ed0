"""Operator 4, media columns: payloads as PNG images in binary columns, and a low-frequency cosine-transform hash of each.

The payload (a text's UTF-8 bytes, filled up with zero bytes to a positive multiple of 64) becomes an 8-bit grey image, 64
samples wide. Encoding picks the row filter None, Sub or Up with the smallest summed differences; decoding
tests the checksum of every chunk, inflates, and undoes all five PNG filters with numpy.
The feature is a perceptual hash: the decoded image's box means on a 32 x 32 grid, their two-dimensional cosine transform,
and one bit for each of the 8 x 8 lowest frequencies: above the median or not.

Defined cases: null counts as empty, an image of 64 zero samples; texts of any length are stored whole; equal texts give
equal values; a damaged image raises an error that names the chunk. Identifiers may be of any type; other columns are not read. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, GRID, LOW, LEVEL = 64, 32, 8, 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | bytes | None) -> bytes:
    data = text.encode() if isinstance(text, str) else text or b""
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, level: int = LEVEL) -> bytes:
    """A grey 8-bit PNG of the payload, 64 samples a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    left, up = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], up[1:] = rows[:, :-1], rows[:-1]
    options = [rows, rows - left, rows - up]
    kind = min(range(3), key=lambda k: int(np.minimum(options[k], -options[k]).sum(dtype=np.int64)))
    raw = np.concatenate([np.full((len(rows), 1), kind, np.uint8), options[kind]], axis=1).tobytes()
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Samples of filtered lines: runs of one filter at a time; None, Sub and Up work on whole runs."""
    out, above = np.empty_like(lines), np.zeros(lines.shape[1], np.uint8)
    bounds = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if a == b:
            continue
        kind, part = int(kinds[a]), lines[a:b]
        if kind == 0:
            out[a:b] = part
        elif kind == 1:
            out[a:b] = np.add.accumulate(part, axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.add.accumulate(np.concatenate([above[None], part]), axis=0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for i in range(a, b):
                _sequential(kind, lines[i].tolist(), (out[i - 1] if i else above).tolist(), out[i])
        else:
            raise ValueError(f"PNG row {a}: unknown filter {kind}")
        above = out[b - 1]
    return out


def _sequential(kind: int, line: list[int], above: list[int], into: np.ndarray) -> None:
    """Average and Paeth: each sample needs the one before it."""
    left = corner = 0
    for x, (value, up) in enumerate(zip(line, above, strict=True)):
        if kind == 3:
            guess = (left + up) >> 1
        else:
            a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if a <= b and a <= c else up if b <= c else corner
        left = (value + guess) & 255
        into[x], corner = left, up


def decode(image: bytes) -> np.ndarray:
    """The samples (rows x width) of a grey 8-bit PNG, after testing every chunk's checksum."""
    if image[:8] != SIGNATURE:
        raise ValueError("not a PNG: wrong signature")
    at, header, packed, ended = 8, None, [], False
    while at < len(image) and not ended:
        (size,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        data = image[at + 8 : at + 8 + size]
        if len(data) < size or at + 12 + size > len(image) or struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError(f"PNG chunk {kind!r}: wrong checksum or cut off")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        ended, at = kind == b"IEND", at + 12 + size
    if header is None or not ended or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("PNG: no header or end, or not a plain 8-bit grey image")
    width, height = header[:2]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return unfilter(raw[:, 0], raw[:, 1:])


_WAVES = np.cos(np.pi / GRID * (np.arange(GRID)[None] + 0.5) * np.arange(LOW)[:, None])


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: for each of the 8 x 8 lowest frequencies whether it is above their median."""
    grid = samples.astype(np.float64)
    for axis in (0, 1):
        n = grid.shape[axis]
        if n >= GRID:  # box means
            edges = np.arange(GRID) * n // GRID
            counts = np.diff([*edges, n])
            grid = np.add.reduceat(grid, edges, axis=axis) / (counts[:, None] if axis == 0 else counts)
        else:
            grid = grid.take(np.arange(GRID) * n // GRID, axis=axis)
    low = np.round(_WAVES @ grid @ _WAVES.T, 6).ravel()
    return np.packbits(low > np.median(low)).tobytes().hex()


COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a PNG in a binary column."""

    def stored(batches):
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(stored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """What the stored images hold: sizes, hashes, checksums and the cosine feature of the decoded bytes."""

    def read(batches):
        for batch in batches:
            rows = []
            for image in batch.column(2):
                image = image.as_py()
                samples = decode(image)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), cosine_hash(samples)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))])

    return stored.mapInArrow(read, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")
