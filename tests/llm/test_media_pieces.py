"""PNG columns and SentencePiece: exact round trips against the standard library and the sentencepiece library."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from lintel.llm import media, pieces, queries

TEXTS = ("", "a", "Hello  world\n\n\ttabs é ▁mark", "x" * 5000, "ﬁ ① ½ ​ zero", "日本語 🙂", " lead and trail ", "a\0b", "".join(map(chr, range(1, 700))), "퟿", "  ▁▁  ")


def brute_png(image):
    """Decodes a grey 8-bit PNG sample by sample."""
    at, data, size = 8, b"", None
    while at < len(image):
        n, kind = struct.unpack_from(">I", image, at)[0], image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        assert struct.unpack_from(">I", image, at + 8 + n)[0] == zlib.crc32(kind + body)
        size = struct.unpack(">II", body[:8]) if kind == b"IHDR" else size
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, out = zlib.decompress(data), []
    for y in range(size[1]):
        kind, line = raw[y * (size[0] + 1)], raw[y * (size[0] + 1) + 1 : (y + 1) * (size[0] + 1)]
        row = []
        for x, v in enumerate(line):
            a, b, c = row[x - 1] if x else 0, out[-1][x] if out else 0, out[-1][x - 1] if out and x else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((v + (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out.append(row)
    return bytes(v for row in out for v in row)


@pytest.mark.parametrize("text", TEXTS)
def test_png_round_trip(text):
    payload = media.payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64
    image = media.encode(payload)
    assert media.decode(image).tobytes() == brute_png(image) == payload


def test_all_filters_and_damage():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 256, (10, 64), dtype=np.uint8)
    kinds = np.array([0, 1, 2, 3, 4] * 2, np.uint8)
    lines = rng.integers(0, 256, (10, 64), dtype=np.uint8)
    raw = np.concatenate([kinds[:, None], lines], axis=1).tobytes()
    chunk = media._chunk
    image = media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 10, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert media.decode(image).tobytes() == brute_png(image)
    good = media.encode(rows.tobytes())
    for at in (3, 20, len(good) // 2, len(good) - 5):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode(bytes(bad))
    with pytest.raises(ValueError):
        media.decode(good[:-20])


def test_cosine_hash_keeps_to_low_frequencies():
    rng = np.random.default_rng(1)
    y, x = np.mgrid[:256, :64] / np.array([256, 64])[:, None, None]
    waves = sum(rng.normal() * np.cos(np.pi * a * y) * np.cos(np.pi * b * x) for a in range(8) for b in range(8))
    smooth = (127 + 100 * waves / np.abs(waves).max()).astype(np.uint8)
    noisy = np.clip(smooth + np.random.default_rng(1).integers(-3, 4, smooth.shape), 0, 255).astype(np.uint8)
    bits = lambda s: bin(int(media.cosine_hash(s), 16))[2:].zfill(64)
    apart = lambda a, b: sum(p != q for p, q in zip(bits(a), bits(b), strict=True))
    assert apart(smooth, noisy) <= 20 < apart(smooth, smooth[::-1] ^ 255)


def brute_feature(data):
    """The hash by its definition: box means, cosine sums one by one, bits above the median."""
    import math

    rows = [data[i : i + 64] for i in range(0, len(data), 64)]
    h, n = len(rows), media.GRID
    cut = lambda k, size: range(k * size // n, (k + 1) * size // n) if size >= n else range(k * size // n, k * size // n + 1)
    grid = [[sum(rows[y][x] for y in cut(i, h) for x in cut(j, 64)) / (len(cut(i, h)) * len(cut(j, 64))) for j in range(n)] for i in range(n)]
    wave = [[math.cos(math.pi / n * (x + 0.5) * u) for x in range(n)] for u in range(media.LOW)]
    low = [round(sum(grid[i][j] * wave[u][i] * wave[v][j] for i in range(n) for j in range(n)), 6) for u in range(media.LOW) for v in range(media.LOW)]
    middle = sorted(low)
    median = (middle[31] + middle[32]) / 2
    return f"{int(''.join('1' if x > median else '0' for x in low), 2):016x}"


def test_feature_against_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = {r["doc_id"]: r["feature"] for r in queries.op4_media(spark, sf_dir).collect()}
    assert found.keys() == texts.keys()
    for i in sorted(texts)[::5]:
        assert found[i] == brute_feature(media.payload_of(texts[i])), i


def test_op4_rows(spark, awkward, clashing):
    found = media.read_back(media.store(clashing(awkward))).collect()
    texts = [(r["doc_id"], (r["text"] or "").encode()) for r in awkward.collect()]
    want = sorted(((i, len(t), hashlib.sha256(media.payload_of(t)).hexdigest(), zlib.crc32(media.payload_of(t)[-64:])) for i, t in texts), key=str)
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found), key=str) == want
    assert len({r["media_sha256"] for r in found if r["doc_id"] in (4, 5)}) == 1
    assert media.read_back(media.store(awkward.limit(0))).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    return queries.tokenizer_path(spark, "piece_bpe_32k.model")


def test_pieces_equal_the_library(spark, documents, clashing, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = clashing(documents(*enumerate(t for t in TEXTS if "\0" not in t), (90, None), (91, "word " * 30_000), (92, "same"), (92, "same")))
    for r in pieces.encode(docs, model).collect():
        text = dict([*enumerate(t for t in TEXTS if "\0" not in t), (90, ""), (91, "word " * 30_000), (92, "same")])[r["doc_id"]]
        ids = library.encode(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert len(r["starts"]) == len(ids) + 1 and r["starts"] == sorted(r["starts"]) and r["starts"][-1] == len(text.encode())
    assert pieces.encode(docs.limit(0), model).count() == 0


def test_spans_cover_their_pieces(model):
    one = pieces.Encoder(model)
    text = "The quick brown fox, né à Paris\nnext line"
    data = text.encode()
    ids, decoded, starts = one.encode(text)
    assert decoded == text and len(starts) == len(ids) + 1
    for i, a, b in zip(ids, starts, starts[1:], strict=False):
        surface = one.surface[i]
        assert data[a:b] == (surface if a else surface.lstrip(b" "))


def test_character_map_takes_the_longest_prefix():
    """A small compiled map made here: "a" -> "1", "ab" -> "2", so "abac" becomes "21c" and each byte knows its source."""
    units = [0] * 1024
    offset = lambda base, node: (base ^ node) << 10
    # root's children at base 256: node of 'a' = 256 ^ ord('a'); its children at base 512
    units[0] = 256 << 10
    a = 256 ^ ord("a")
    units[a] = offset(512, a) | 1 << 8 | ord("a")
    units[512] = 1 << 31 | 0
    ab = 512 ^ ord("b")
    units[ab] = offset(768, ab) | 1 << 8 | ord("b")
    units[768] = 1 << 31 | 2
    blob = struct.pack("<I", 4096) + struct.pack("<1024I", *units) + b"1\x002\x00"
    chars = pieces.CharacterMap(blob)
    data, source = chars.normalise("abac é".encode())
    assert data == "21c é".encode()
    assert source.tolist() == [0, 2, 3, 4, 5, 5, 7]


def test_normalised_text_keeps_its_source(model):
    """Encoding takes one path for every text: with a map that rewrites, pieces still point at the bytes they came from."""
    one = pieces.Encoder(model)
    assert not one.chars.units  # this model's own map is empty: the identity
    one.chars.normalise = lambda data: (b"the cat", np.array([0, 1, 2, 3, 4, 7, 10, 13]))  # c, a and t from three bytes each
    ids, decoded, starts = one.encode("the \u24d2\u24d0\u24e3")
    assert decoded == "the cat" and starts[0] == 0 and starts[-1] == 13
    assert [one.library.id_to_piece(i) for i in ids] == ["\u2581the", "\u2581cat"] and starts.tolist() == [0, 3, 13]


def test_op5_whole_table(spark, sf_dir, model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op5_pieces(spark, sf_dir).collect():
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
