import hashlib
import zlib

import numpy as np
import pytest

from heristat.llm import media, webp


def test_column(documents, no_documents):
    got = media.query(documents).collect()
    texts = [r.text for r in documents.collect()]
    assert len(got) == len(texts) and media.query(no_documents).collect() == []
    by = sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got)
    pads = [media.padded((t or "").encode()) for t in texts]
    assert by == sorted((len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for t, p in zip(texts, pads))
    same = [r for r in got if r.n_bytes == 0]
    assert len({(r.media_sha256, r.feature) for r in same}) == 1 and len(same) == 3
    pixels = media.decode_column(media.encode_column(documents)).filter("doc_id = 10").first().pixels
    assert bytes(pixels) == media.padded(("é" * 60 + " 日本語 " + "é" * 60).encode())


def test_sample_batches_are_independent():
    rng = np.random.default_rng(0)
    pads = [media.padded(bytes(rng.integers(0, k, n, dtype=np.uint8))) for k, n in ((1, 0), (2, 64), (3, 700), (9, 5000), (17, 64), (256, 20_000), (256, 4096))] + [b"abcdefgh" * 2048, b"\xff" * 64 * 70]
    files = webp.encode_samples(pads)
    assert [webp.encode_samples([p])[0] for p in pads] == files
    assert [x[2] for x in webp.decode_samples(files)] == pads
    for p, f in zip(pads, files):  # the general decoder reads the same
        assert ((webp.decode(f) >> 8) & 255).astype(np.uint8).tobytes() == p


@pytest.mark.parametrize("seed", range(12))
def test_every_feature(seed):
    rng = np.random.default_rng(seed)
    h, w, s = int(rng.integers(1, 30)), int(rng.integers(1, 30)), int(rng.integers(2, 5))
    tiles = (-(-h >> s), -(-w >> s))
    img = rng.integers(0, 2**32, 5 if seed % 2 else 400, dtype=np.uint32)[rng.integers(0, 5 if seed % 2 else 400, (h, w))]
    some = [(webp.PREDICTOR, s, rng.integers(0, 14, tiles)), (webp.CROSS_COLOUR, s, rng.integers(0, 2**24, tiles).astype(np.uint32) | np.uint32(0xFF000000)), (webp.SUBTRACT_GREEN,)]
    some = [some[i] for i in rng.permutation(3)[: seed % 4]]
    if seed in (5, 9):
        some = [(webp.INDEXING,)]
    meta = rng.integers(0, 3, (-(-h >> 3), -(-w >> 3))) if seed % 3 == 0 else None
    assert (webp.decode(webp.encode(img, tuple(some), seed % 8, meta, 3)) == img).all()


def test_each_predictor():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 2**32, (9, 11), dtype=np.uint32)
    for mode in range(14):
        assert (webp.decode(webp.encode(img, ((webp.PREDICTOR, 4, np.full((1, 1), mode)),))) == img).all()


def test_a_file_written_by_hand():
    """2 x 1 pixels, alpha 255: green 5 and 9 by a two-symbol code, other channels constant."""
    bits = webp.BitWriter()
    bits.write(0x2F | 1 << 8 | 0 << 22, 40)
    bits.write(0, 3)
    bits.write(1 | 1 << 1 | 1 << 2 | 5 << 3 | 9 << 11, 19)  # two symbols, the first of eight bits
    for symbol in (1, 2, 255, 0):
        bits.write(1 | 0 << 1 | 1 << 2 | symbol << 3, 11)
    bits.write(0b10, 2)
    assert webp.decode(webp.wrap([(0, 0, 2, 1, bits.bytes())], 2, 1)).tolist() == [[0xFF010502, 0xFF010902]]


def test_broken_files():
    good = webp.encode_samples([b"a" * 64 + b"b" * 64])[0]
    for bad in (b"", good[:20], b"RIFX" + good[4:], good[:20] + b"\0" + good[21:]):
        with pytest.raises(Exception):
            webp.decode(bad)
    with pytest.raises(webp.WebPError):
        webp.encode_samples([b"abc"])
