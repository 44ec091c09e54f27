import hashlib
import struct
import zlib

import numpy as np
import pytest

from tesserax.llm import media


def filtered(kind, image):
    """A PNG whose lines all use one filter, made pixel by pixel."""
    h, w, c = image.shape
    out = bytearray()
    for y in range(h):
        out.append(kind)
        for x in range(w):
            for k in range(c):
                a = int(image[y, x - 1, k]) if x else 0
                b = int(image[y - 1, x, k]) if y else 0
                d = int(image[y - 1, x - 1, k]) if x and y else 0
                p = a + b - d
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                out.append((int(image[y, x, k]) - [0, a, b, (a + b) // 2, near][kind]) % 256)
    colour = {1: 0, 3: 2, 2: 4, 4: 6}[c]
    z = zlib.compress(bytes(out))
    return media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + media._chunk(b"IDAT", z[:5]) + media._chunk(b"IDAT", z[5:]) + media._chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_all_filters(kind, channels):
    image = np.random.default_rng(kind).integers(0, 256, (7, 11, channels), dtype=np.uint8)
    assert (media.read_png(filtered(kind, image)) == image).all()


def test_damage_is_found():
    good = media.write_png(np.arange(576, dtype=np.uint8).reshape(1, 576))
    assert media.read_png(good).tobytes() == bytes(np.arange(576, dtype=np.uint8))
    for at in range(len(good)):
        bad = good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]
        with pytest.raises(ValueError):
            media.read_png(bad)
    with pytest.raises(ValueError):
        media.read_png(good[:-5])


def test_rows(spark):
    texts = [(1, None), (2, ""), (3, "a"), (4, "é" * 288), (5, "x" * 577), (6, "long " * 50_000), (None, "a"), (3, "a")]
    df = spark.createDataFrame([(t, i, "z") for i, t in texts], "text string, doc_id long, media string")
    rows = media.read_media(media.to_media(df), payload=True).collect()
    assert len(rows) == len(texts)
    by = {r.n_bytes: r for r in rows}
    for _, t in texts:
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = by[len(raw)]
        assert bytes(r.payload) == full and r.payload_bytes == len(full) and r.error is None
        assert r.payload_sha256 == hashlib.sha256(full).hexdigest() and r.tail_crc32 == zlib.crc32(full[-32:])
        assert len(r.phash) == 8
    broken = spark.createDataFrame([(1, 5, None), (2, 5, bytearray(b"no"))], "doc_id long, n_bytes long, media binary")
    assert sorted(r.error for r in media.read_media(broken).collect()) == ["not a PNG", "null"]
    assert media.read_media(media.to_media(df.limit(0))).count() == 0


def test_like_pictures_have_like_hashes():
    a = np.kron(np.random.default_rng(3).integers(10, 240, (8, 8)), np.ones((8, 8), dtype=int)).astype(np.uint8)
    noisy = np.clip(a.astype(int) + np.random.default_rng(1).integers(-6, 7, a.shape), 0, 255).astype(np.uint8)
    bits = lambda i: int.from_bytes(media.perceptual_hash(i), "big")
    assert (bits(a) ^ bits(noisy)).bit_count() < 12 < (bits(a) ^ bits(np.rot90(a).copy())).bit_count()
