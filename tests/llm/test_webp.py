import hashlib

import numpy as np
import pytest

from tidegrid.llm import webp

rng = np.random.default_rng(0)


def images():
    for h, w in ((1, 1), (3, 5), (9, 64), (20, 33)):
        yield rng.integers(0, 1 << 32, (h, w), dtype=np.uint64).astype(np.uint32)
        smooth = np.cumsum(rng.integers(0, 3, (h, w, 4)), axis=1).astype(np.uint8)
        yield np.ascontiguousarray(smooth).view("<u4").reshape(h, w).astype(np.uint32)
        yield rng.integers(0, 7, (h, w)).astype(np.uint32) * np.uint32(0x30201) | np.uint32(0xFF000000)


OPTIONS = [{}, {"cache_bits": 1}, {"cache_bits": 9}, {"subtract_green": True}, {"cross": (5, -9, 77)}, *({"predictor": m} for m in range(14)), {"cross": (-3, 8, 1), "subtract_green": True, "predictor": 11, "cache_bits": 4}]


@pytest.mark.parametrize("options", OPTIONS, ids=str)
def test_round_trip(options):
    for image in images():
        for palette in (False, True):
            data = webp.encode_image(image, palette=palette, **options)
            assert (webp.decode_image(data) == image).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes(colours):
    image = rng.integers(0, colours, (9, 13)).astype(np.uint32) * np.uint32(0x010101) | np.uint32(0xFF000000)
    assert (webp.decode_image(webp.encode_image(image)) == image).all()


@pytest.mark.parametrize("cache_bits", [0, 5])
def test_back_references(cache_bits):
    flat = rng.integers(0, 1 << 32, 640, dtype=np.uint64).astype(np.uint32)
    flat[100:200], flat[300:600] = flat[0:100], flat[299]
    image = flat.reshape(10, 64)
    data = webp.encode_image(image, palette=False, copies=[(100, 100, 100), (300, 300, 1)], cache_bits=cache_bits)
    assert (webp.decode_image(data) == image).all() and len(data) < len(webp.encode_image(image, palette=False))


def test_short_distances_and_bad_data():
    assert len(webp.NEAR) == 120 and webp.NEAR[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)] and webp.NEAR[-1] == (8, 7)
    with pytest.raises(ValueError):
        webp.decode_image(b"RIFF0000WEBPVP8 ....." + b"\0" * 20)


def test_operator(spark):
    texts = [None, "", "a", "ż" * 200, "line that repeats itself\n" * 50, "x" * (webp.WIDTH * webp.MAX_ROWS + 5), "same", "same", "\0" * 64, "".join(map(chr, range(32, 400)))]
    df = spark.createDataFrame([(i, t, i, "m") for i, t in enumerate(texts)] + [(None, "null id", 1, "m")], "doc_id long, text string, n_bytes long, media string")
    got = webp.stored_media(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        raw = ("null id" if r["doc_id"] is None else texts[r["doc_id"]] or "").encode()
        want = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert r["n_bytes"] == len(raw) and bytes(r["samples"]) == want and webp.features(want) == r["feature"]
        assert bytes(r["media"][:4]) == b"RIFF"
    same = [hashlib.sha256(r["media"]).hexdigest() for r in got if r["doc_id"] in (6, 7)]
    assert same[0] == same[1]
    assert webp.stored_media(df.limit(0)).count() == 0
