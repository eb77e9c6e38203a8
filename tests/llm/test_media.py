import struct
import zlib

import numpy as np
import pytest

from sparkloom.llm import media


def filtered(image, kinds):
    """Filter rows by the definition, sample by sample."""
    out = np.zeros((len(image), image.shape[1] + 1), np.uint8)
    for y, kind in enumerate(kinds):
        out[y, 0] = kind
        for x in range(image.shape[1]):
            a = int(image[y, x - 1]) if x else 0
            b = int(image[y - 1, x]) if y else 0
            c = int(image[y - 1, x - 1]) if x and y else 0
            p = a + b - c
            near = min((a, b, c), key=lambda v, p=p: abs(p - v))
            out[y, x + 1] = (int(image[y, x]) - [0, a, b, (a + b) // 2, near][kind]) % 256
    return out


def test_all_filters_are_undone():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (12, 9), dtype=np.uint8)
    for kinds in ([0] * 12, [1] * 12, [2] * 12, [3] * 12, [4] * 12, [2, 2, 0, 4, 4, 1, 3, 2, 2, 2, 0, 1]):
        raw = filtered(image, kinds)
        assert (media.unfilter(raw[:, 0], raw[:, 1:]) == image).all()


def test_round_trip_and_checksums():
    for data in (b"", b"x", "é日😀".encode() * 100, bytes(range(256)) * 7):
        payload = media.padded(data)
        assert len(payload) % 64 == 0 and len(payload) >= 64
        png = media.encode_png(payload)
        assert media.decode_png(png).tobytes() == payload
        broken = bytearray(png)
        broken[len(png) // 2] ^= 1
        with pytest.raises((ValueError, zlib.error, struct.error)):
            media.decode_png(bytes(broken))
    with pytest.raises(ValueError):
        media.decode_png(b"nonsense")


def test_hash_is_of_low_frequencies():
    image = np.kron(np.random.default_rng(1).integers(40, 210, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    noisy = np.clip(image.astype(int) + np.random.default_rng(0).integers(-6, 7, image.shape), 0, 255).astype(np.uint8)
    distance = bin(int(media.cosine_hash(image), 16) ^ int(media.cosine_hash(noisy), 16)).count("1")
    assert distance <= 12 and len(media.cosine_hash(image)) == 16


def test_columns(odd, none):
    rows = media.read_png(media.to_png(odd)).collect()
    texts = [(r.doc_id, media.padded((r.text or "").encode())) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(repr, texts)) == sorted(repr((r.doc_id, bytes(r.payload))) for r in rows)
    same = {bytes(r.media) for r in rows if r.doc_id in (1, 4)}
    assert len(same) == 1
    assert media.read_png(media.to_png(none)).count() == 0
