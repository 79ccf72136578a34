"""Lossless WebP: round trips of every feature, and the store of texts."""

import hashlib
import zlib

import numpy as np
import pytest

from lintel.llm import webp, webp_encode
from tests.llm import brute

P, X, G, C = webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN, webp.PALETTE


def picture(kind, rng):
    h, w = rng.integers(1, 20, 2)
    colours = rng.integers(0, 1 << 32, 1 << 16, dtype=np.uint64).astype(np.uint32)
    if kind == 0:
        return rng.choice(colours, (h, w))
    if kind == 1:
        return rng.choice(colours[: rng.integers(1, 300)], (h, w))
    if kind == 2:
        return np.tile(rng.choice(colours, (1, w)), (h, 1))
    return np.full((h, w), colours[0])


@pytest.mark.parametrize("transforms", [(), (P,), (X,), (G,), (G, X, P), (P, X, G), (C,), (C, P)])
@pytest.mark.parametrize("cache", [0, 1, 6])
@pytest.mark.parametrize("copies", [False, True])
def test_round_trip(transforms, cache, copies):
    rng = np.random.default_rng(len(transforms) + cache)
    for k in range(8):
        a = picture(k % 4, rng)
        if C in transforms and len(np.unique(a)) > 256:
            continue
        for shift in (0, 2):
            assert (webp.decode(webp_encode.encode(a, transforms, cache, copies, shift, k)) == a).all()


def test_near_offsets_are_the_formats():
    first = [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0)]
    last = [(6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7)]
    assert webp.plane_offsets()[:14] == first and webp.plane_offsets()[-9:] == last and len(webp.plane_offsets()) == 120


def test_long_codes():
    freq = np.zeros(280, np.int64)
    a, b = 1, 1
    for k in range(40):
        freq[k], a, b = a, b, a + b
    lengths = webp.code_lengths(freq)
    assert lengths.max() <= 15 and sum(2.0 ** -int(n) for n in lengths if n) == 1


@pytest.mark.parametrize("cut", [12, 21, 30, 60])
def test_broken_files(cut):
    media = webp_encode.encode(np.arange(400, dtype=np.uint32).reshape(20, 20))
    with pytest.raises((ValueError, IndexError)):
        webp.decode(media[:cut])
    with pytest.raises(ValueError):
        webp.decode(b"RIFFxxxxWEBPVP8 " + media[16:])


def test_store(spark):
    rows = [*brute.prose(2, 60), (700, "x" * 64), (701, "y" * 65), (702, "é" * 700_000), (703, "".join(map(chr, range(256))))]
    got = webp_encode.store_texts(brute.messy(spark, rows)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        raw = (r.text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        w = r.webp
        assert (w.n_bytes, w.payload_bytes, w.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (w.tail_crc32, w.media_bytes, w.media_sha256) == (zlib.crc32(payload[-64:]), len(w.media), hashlib.sha256(w.media).hexdigest())
        assert by_text.setdefault(raw, (w.media_sha256, w.feature)) == (w.media_sha256, w.feature)
        assert webp_encode.read_back(bytes(w.media)).tobytes() == payload
    assert webp_encode.store_texts(brute.messy(spark, rows[:1]).where("false")).count() == 0


def traits(media):
    """Which features of the format a file uses, read by a decoder that notes them."""
    seen = set()
    bits = webp.Bits(media[20 : 20 + int.from_bytes(media[16:20], "little")])
    bits.at = 40
    kinds, width = [], (int.from_bytes(media[20:25], "little") >> 8 & 16383) + 1
    height = (int.from_bytes(media[20:25], "little") >> 22 & 16383) + 1
    while bits.read(1):
        kind = bits.read(2)
        kinds.append(kind)
        if kind in (P, X):
            shift = bits.read(3) + 2
            tiles = webp.read_image(bits, width + (1 << shift) - 1 >> shift, height + (1 << shift) - 1 >> shift, False)
            seen |= {("mode", int(m) >> 8 & 15) for m in np.unique(tiles)} if kind == P else {("cross", bool(v & 0xFFFFFF)) for v in tiles.tolist()}
        elif kind == C:
            count = bits.read(8) + 1
            webp.read_image(bits, count, 1, False)
            width = -(-width // (8 if count <= 2 else 4 if count <= 4 else 2 if count <= 16 else 1))
    seen |= {("transform", k) for k in kinds}
    cache = bits.read(4) if bits.read(1) else 0
    seen.add(("cache", cache > 0))
    bits.read(1)
    codes = [webp.read_code(bits, n) for n in (280 + (1 << cache if cache else 0), 256, 256, 256, 40)]
    i = 0
    while i < width * height:
        s = codes[0].read(bits)
        if s < 256:
            [c.read(bits) for c in codes[1:4]]
            i += 1
        elif s < 280:
            i += webp._extended(s - 256, bits)
            webp._extended(codes[4].read(bits), bits)
            seen.add("copy")
        else:
            seen.add("cached")
            i += 1
    return seen


def test_the_store_uses_the_whole_format(spark, sf_dir):
    seen, counts = set(), {}
    for r in webp_encode.store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(2000)).select("webp.media").collect():
        own = traits(bytes(r.media))
        seen |= own
        for x in own:
            counts[x] = counts.get(x, 0) + 1
    assert {"copy", "cached", ("transform", P), ("transform", X), ("transform", C), ("cache", True), ("cross", True)} <= seen, counts
    assert len([x for x in seen if x[0] == "mode"]) >= 3


def test_pixels_of_a_column(spark):
    a = np.arange(12, dtype=np.uint32).reshape(3, 4) * 1234567
    df = spark.createDataFrame([(1, webp_encode.encode(a, (G, P), 3, True)), (2, b"junk"), (3, None)], "id int, media binary")
    got = {r.id: r.image for r in webp_encode.read_pixels(df).collect()}
    assert (got[1].width, got[1].height) == (4, 3) and bytes(got[1].pixels) == a.astype("<u4").tobytes()
    assert got[2].error and got[3] is None


def test_steps_go_by_content_not_by_length(monkeypatch):
    """Long payloads take the transforms, cache and copies that short ones of the same kind take."""
    seen, plain = [], webp_encode.encode
    monkeypatch.setattr(webp_encode, "encode", lambda argb, *a, **k: seen.append((argb.shape[1], *a)) or plain(argb, *a, **k))
    line = b"The same line comes again and again, %d\n"
    for n in (30, 3000):
        long, few = (webp_encode.payload_of(np.frombuffer(x, np.uint8)) for x in (b"".join(line % (i % 7) for i in range(n)), b"abcdabca" * 40 * n))
        files = webp_encode.encode_payloads([long, few])
        assert [webp_encode.samples_of(f).tobytes() for f in files] == [long.tobytes(), few.tobytes()]
        assert seen[-2:] == [(16, (webp.PREDICTOR, webp.CROSS_COLOUR), webp_encode.CACHE_BITS, True), (64, (webp.PALETTE,), 0, True)]
    assert len(few) > webp_encode.FILE_BYTES // 16


def test_plain_files_are_read_in_runs_of_symbols(monkeypatch):
    text = b"The files of the store have one code, so its runs are looked up together. \xc3\xa9\xff" * 3
    payloads = [webp_encode.payload_of(np.frombuffer(text[k:] + bytes([k]), np.uint8)) for k in range(4)]
    files = webp_encode.encode_samples(payloads)
    webp_encode.samples_of(files[0])
    monkeypatch.setattr(webp, "token_lengths", lambda *_: pytest.fail("every bit offset was looked at"))
    for p, f in zip(payloads, files):
        assert (webp_encode.samples_of(f) == p).all()
    size = int.from_bytes(files[0][16:20], "little")
    for cut in (1, 2, 40):
        stream = files[0][20 : 20 + size - cut - 1]
        with pytest.raises(ValueError):
            webp.decode(webp_encode.container(stream))


@pytest.mark.parametrize("mode", range(16))
def test_single_pixels_are_predicted_as_arrays(mode):
    near = np.random.default_rng(mode).integers(0, 256, (4, 300, 4))
    near[:, :100] //= 64
    whole = webp._join(webp.predict(mode, *near))
    assert [webp.predicted(mode, *p) for p in webp._join(near).T.tolist()] == whole.tolist()
