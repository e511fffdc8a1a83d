import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from parlance.llm import gif as G

ODD = [None, "", "é" * 288, "a" * 575, "b" * 576, "c" * 577, "text " * 3000, "text " * 3000]


def payload(t):
    b = (t or "").encode()
    return b + b"\xff" * ((-len(b)) % 576 if b else 576)


def test_texts_come_back():
    r = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(r.choice("ab é\n") for _ in range(r.randrange(3000))) for _ in range(20)]
    for t, g in zip(texts, G.decode_all(G.store_texts(texts)), strict=True):
        assert g.error is None
        assert b"".join(f.raster.tobytes() for f in g.frames) == payload(t)


@pytest.mark.parametrize("shape,bits", [((300, 200), 8), ((40, 30), 2), ((7, 5), 1), ((100, 60), 4)])
def test_rasters_of_any_size(shape, bits):
    w, h = shape
    r = np.random.default_rng(0)
    rasters = [r.integers(0, 1 << bits, w * h, np.uint8).tobytes(), bytes(w * h)]
    g = G.decode(G.encode(rasters, w, h, os.urandom(3 << bits)))
    assert [f.raster.tobytes() for f in g.frames] == rasters


def image(blocks, w=2, h=2, flags=0x80, palette=bytes([0, 0, 0, 255, 255, 255])):
    return b"GIF89a" + bytes([w, 0, h, 0, flags, 0, 0]) + palette + b"".join(blocks) + b";"


def frame(raster, w=2, h=2, x=0, y=0, disposal=0, transparent=None, delay=5, flags=0, palette=b""):
    gce = b"!\xf9\x04" + bytes([disposal << 2 | (transparent is not None), delay, 0, transparent or 0, 0])
    return gce + b"," + bytes([x, 0, y, 0, w, 0, h, 0, flags]) + palette + bytes([2]) + G.blocks(G.lzw_encode([raster], 2)[0])


def shown(data):
    g = G.decode(data)
    return g, [(c >> 24 != 0).astype(int).tolist() + (c & 255).tolist() for c in G.compose(g)]


def test_disposal_and_transparency():
    first = frame(bytes([1, 1, 1, 1]))
    g, c = shown(image([first, frame(bytes([0, 1, 1, 0]), transparent=1, disposal=3), frame(bytes([1]), 1, 1, 1, 1, disposal=2), frame(bytes([1]), 1, 1)]))
    assert c[0] == [[1, 1], [1, 1], [255, 255], [255, 255]]
    assert c[1] == [[1, 1], [1, 1], [0, 255], [255, 0]]
    assert c[2] == c[0]  # the second was taken back before
    assert c[3] == [[1, 1], [1, 0], [255, 255], [255, 0]]  # the third's area was cleared
    assert [f.delay_cs for f in g.frames] == [5] * 4


def test_interlace_and_own_palette():
    raster = bytes(range(4)) * 2
    own = bytes(x for i in range(4) for x in (i, i, i))
    g = G.decode(image([frame(bytes([0, 2, 1, 3]), 1, 4, flags=0x40 | 0x81, palette=own)], 1, 4))
    # passes give rows 0, then 2 (every fourth from 2), then 1 and 3
    assert g.frames[0].raster.tolist() == [0, 1, 2, 3] and raster
    assert (g.frames[0].palette[:4] & 255).tolist() == [0, 1, 2, 3]


def test_faults_are_reported():
    good = G.encode([bytes(576), bytes([7]) * 576], 24, 24, G.tile_palette())
    assert G.decode(b"PNG").error and G.decode(None).frames == []
    cut = G.decode(good[:-40])
    assert cut.error and len(cut.frames) >= 1
    assert G.decode(good[:12]).error
    with pytest.raises(ValueError):
        G.lzw_decode(G.pack_runs([[5, 300]], 8), 8)


def test_query(spark, sf):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    texts = {r.doc_id: r.text for r in docs.collect()}
    from parlance.llm import common

    keep = common.documents
    try:
        G.documents = lambda *_: docs
        rows = G.op1_gif_frames(spark, sf).collect()
    finally:
        G.documents = keep
    assert len(rows) == len(ODD)
    for r in rows:
        p = payload(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len((texts[r.doc_id] or "").encode()), len(p))
        assert r.payload_sha256 == hashlib.sha256(p).hexdigest() and r.tail_crc32 == zlib.crc32(p[-32:])
        assert sum(r.colour_histogram) == len(p) and r.frames == len(p) // 576 and r.duration_ms == r.frames * 100
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id >= 6}) == 1


def test_frame_table(spark):
    data = image([frame(bytes([1, 1, 1, 1])), frame(bytes([0]), 1, 1, 1, 0)])
    df = spark.createDataFrame([(1, bytearray(data), "x"), (2, None, "y"), (3, bytearray(b"no"), "z"), (1, bytearray(data), "x")], "id long, media binary, frame string")
    rows = sorted(G.frame_table(df, "media", "id").collect(), key=lambda r: (r.id, r.frame or 0))
    assert [(r.id, r.frame, r.start_ms) for r in rows] == [(1, 0, 0), (1, 0, 0), (1, 1, 50), (1, 1, 50), (3, None, None)]
    assert rows[0].histogram[63] == 4 and rows[2].histogram[63] == 3 and rows[2].histogram[0] == 1
    assert rows[4].error
    assert G.frame_table(df.filter("false"), "media", "id").count() == 0
