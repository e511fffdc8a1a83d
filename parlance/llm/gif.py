"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

``decode`` reads any GIF87a or GIF89a stream, ``compose`` applies the drawing rules, ``encode`` writes one, and
``frame_table`` turns a binary column into one row for each frame. Rows are decoded on their own in Arrow batches: no
shuffle, and memory for one image at a time.

Defined cases: a null image gives no frames; a broken or cut stream gives the frames before the fault and a message in
``error`` (an image without a whole frame gives one row with null frame columns); missing pixels of a cut raster are index
0; an image without palette uses grey levels; repeated rows are each decoded; an empty table gives an empty result; of the
table's other columns only the id is read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parlance.llm.common import documents, map_arrow, text_of

SIDE = 24
TILE = SIDE * SIDE
PAD = 255
DELAY_CS = 10
BINS = 64
MOST_CODES = 4096


NO_RASTER = np.zeros(0, np.uint8)


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    raster: np.ndarray
    palette: np.ndarray
    transparent: int = -1
    disposal: int = 0
    delay_cs: int = 0


@dataclass
class Gif:
    width: int = 0
    height: int = 0
    background: int = 0
    frames: list[Frame] = field(default_factory=list)
    loops: int | None = None
    error: str | None = None


@lru_cache(maxsize=64)
def layout(min_size: int, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and bit places of the codes that follow a clear code: a code is as wide as the table's size then needs."""
    size = np.minimum((1 << min_size) + 2 + np.maximum(np.arange(codes) - 1, 0), MOST_CODES - 1)
    widths = np.maximum(np.floor(np.log2(size)).astype(np.int64) + 1, min_size + 1)
    return widths, np.concatenate([[0], np.cumsum(widths)])


def room(n: int) -> int:
    """Code counts are rounded up, so that few layouts are kept."""
    return 1 << max(9, (n - 1).bit_length())


@lru_cache(maxsize=16)
def roots(min_size: int) -> list[bytes]:
    return [bytes([i]) for i in range(1 << min_size)] + [b"", b""]


def lzw_codes(data: bytes, min_size: int) -> Iterator[list[int]]:
    """The code runs between clear codes, up to the end code; all codes of a run are cut out of the bits at once."""
    clear, total, at = 1 << min_size, len(data) * 8, 0
    bits = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    while at + min_size < total:
        most = room(min(MOST_CODES * 2, (total - at) // (min_size + 1) + 2))
        while True:
            widths, places = layout(min_size, most)
            n = int(np.searchsorted(places, total - at, side="right")) - 1
            pos = at + places[:n]
            k = pos >> 3
            codes = ((bits[k] | bits[k + 1] << 8 | bits[k + 2] << 16) >> (pos & 7).astype(np.uint32)) & ((1 << widths[:n]) - 1).astype(np.uint32)
            stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stops) or n < most:
                break
            most *= 2
        end = int(stops[0]) if len(stops) else n
        if end:
            yield codes[:end].tolist()
        if not len(stops) or codes[end] == clear + 1:
            return
        at += int(places[end + 1])


def lzw_decode(data: bytes, min_size: int) -> bytes:
    """The palette indices of a code stream; raises ValueError at a code that cannot be."""
    out: list[bytes] = []
    for codes in lzw_codes(data, min_size):
        table = roots(min_size).copy()
        n, put, add = len(table), out.append, table.append
        if codes[0] >= n - 2:
            raise ValueError("a run starts with a code that is no colour")
        prev = table[codes[0]]
        put(prev)
        for c in codes[1 : MOST_CODES - n + 1]:
            if c < n:
                e = table[c]
                add(prev + e[:1])
            elif c == n:
                e = prev + prev[:1]
                add(e)
            else:
                raise ValueError(f"code {c} is not in a table of {n}")
            n += 1
            put(e)
            prev = e
        out.extend([table[c] for c in codes[MOST_CODES - len(roots(min_size)) + 1 :]])
    return b"".join(out)


def lzw_runs(raster: bytes, min_size: int) -> list[list[int]]:
    """Greedy LZW codes, a list for each table; a new table starts when one is full."""
    first, runs, at = (1 << min_size) + 2, [], 0
    while at < len(raster):
        table: dict[int, int] = {}
        get, codes, n, p = table.get, [], first, raster[at]
        put = codes.append
        rest = raster[at + 1 :] if at else memoryview(raster)[1:]
        used = 1
        for b in rest:
            key = p << 8 | b
            c = get(key)
            if c is None:
                put(p)
                p = b
                if n == MOST_CODES:
                    break
                table[key] = n
                n += 1
            else:
                p = c
            used += 1
        else:
            put(p)
        at += used
        runs.append(codes)
    return runs


def slots(rasters: np.ndarray, min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy LZW codes of equally long rasters that cannot fill a table, all rasters in step: codes and how many of each row.

    Each raster has an open hash table of (prefix code, next index) pairs; a step looks one more index up in every table.
    """
    rows, length = rasters.shape
    size = 1 << max(4, int(length * 1.7).bit_length())
    keys, values = np.full(rows * size, -1, np.int32), np.zeros(rows * size, np.int16)
    base, n = np.arange(rows, dtype=np.int64) * size, np.full(rows, (1 << min_size) + 2, np.int16)
    columns = np.ascontiguousarray(rasters.T).astype(np.int32)
    out, used, p = np.zeros((rows, length), np.int16), np.zeros(rows, np.int64), columns[0].copy()
    flat, start = out.reshape(-1), np.arange(rows, dtype=np.int64) * length
    shift = np.int64(32 - (size.bit_length() - 1))
    for k in range(1, length):
        b = columns[k]
        key = p << 8 | b
        at = base + ((key.astype(np.int64) * 2654435761 & 0xFFFFFFFF) >> shift)
        held = keys[at]
        odd = np.flatnonzero((held != key) & (held >= 0))
        while len(odd):  # the next slot of those that met another pair
            to = at[odd] + 1
            to -= np.where(to == base[odd] + size, size, 0)
            at[odd] = to
            now = keys[to]
            held[odd] = now
            odd = odd[(now != key[odd]) & (now >= 0)]
        new = np.flatnonzero(held < 0)
        flat[start[new] + used[new]] = p[new]
        used[new] += 1
        spot = at[new]
        keys[spot] = key[new]
        values[spot] = n[new]
        n[new] += 1
        p = values[at].astype(np.int32)
        p[new] = b[new]
    flat[start + used] = p
    return out, used + 1


def pack(codes: np.ndarray, used: np.ndarray, min_size: int) -> list[bytes]:
    """The bit streams of many rows of codes, with a clear code before and an end code after each, in one pass."""
    clear, rows = 1 << min_size, len(codes)
    most = int(used.max()) + 2
    whole = np.full((rows, most), clear, np.int64)
    whole[:, 1:-1] = codes[:, : most - 2]
    whole[np.arange(rows), used + 1] = clear + 1
    _, places = layout(min_size, room(most))
    places = np.concatenate([[0], min_size + 1 + places[:most]])
    size = (places[used + 2] + 7) >> 3
    ends = np.cumsum(size)
    keep = np.arange(most) < (used + 2)[:, None]
    pos = (places[:most] + ((ends - size) * 8)[:, None])[keep]
    v = whole[keep] << (pos & 7)
    k, out = pos >> 3, np.zeros(int(ends[-1]) + 3, np.uint8)
    if min_size >= 7:  # codes of a byte or more start at different bytes
        out[k] |= (v & 255).astype(np.uint8)
        out[k + 1] |= (v >> 8 & 255).astype(np.uint8)
        out[k + 2] |= (v >> 16).astype(np.uint8)
    else:
        for i in range(3):
            np.bitwise_or.at(out, k + i, (v >> 8 * i & 255).astype(np.uint8))
    data, cuts = out.tobytes(), [0, *ends.tolist()]
    return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def pack_runs(runs: list[list[int]], min_size: int) -> bytes:
    """The bit stream of one raster whose table was full and started again."""
    clear, at, bits = 1 << min_size, 0, 0
    for i, codes in enumerate([[], *runs]):
        own = [*codes, clear if i < len(runs) else clear + 1]
        widths, places = layout(min_size, room(len(own)))
        for code, place in zip(own, places.tolist(), strict=False):
            bits |= code << (at + place)
        at += int(places[len(own)])
    return bits.to_bytes((at + 7) >> 3, "little")


def lzw_encode(rasters: list[bytes], min_size: int) -> list[bytes]:
    """The code streams of rasters."""
    same = rasters and len({len(r) for r in rasters}) == 1 and 0 < len(rasters[0]) < MOST_CODES - (1 << min_size) - 2
    if not same:
        return [pack_runs(lzw_runs(r, min_size), min_size) for r in rasters]
    out = []
    for i in range(0, len(rasters), 2048):
        part = rasters[i : i + 2048]
        out += pack(*slots(np.frombuffer(b"".join(part), np.uint8).reshape(len(part), -1), min_size), min_size)
    return out


def lzw_decode_all(streams: list[bytes], min_size: int) -> list[bytes | None]:
    """The indices of many code streams at once; None for those that need ``lzw_decode``: with faults, or several tables.

    The entry that code j of a table adds is the text of code j and the first index of code j + 1, which is a piece of the
    output from where code j starts. So each index of the output points to an earlier one, and following the pointers,
    twice as far each time, ends at a code that is an index itself.
    """
    clear, rows = 1 << min_size, len(streams)
    total = np.array([len(x) * 8 for x in streams])
    bits = np.frombuffer(b"".join(streams) + b"\0\0\0", np.uint8).astype(np.uint32)
    base = np.cumsum(total) - total
    most = int(total.max() if rows else 0) // (min_size + 1) + 2
    if not rows or most > 2 * TILE:
        return [None] * rows
    _, places = layout(min_size, room(most))
    at = min_size + 1
    head = (bits[base >> 3] | bits[(base >> 3) + 1] << 8) & ((1 << at) - 1) if at <= 16 else np.zeros(rows)
    pos = base[:, None] + at + places[:most]
    widths = np.diff(places)[:most].astype(np.uint32)
    inside = at + places[1 : most + 1] <= total[:, None]
    k = np.minimum(pos >> 3, len(bits) - 3)
    codes = ((bits[k] | bits[k + 1] << 8 | bits[k + 2] << 16) >> (pos & 7).astype(np.uint32)) & ((1 << widths) - 1)
    stop = inside & ((codes == clear) | (codes == clear + 1))
    used = stop.argmax(1)
    fine = (head == clear) & stop.any(1) & (codes[np.arange(rows), used] == clear + 1) & (used > 0)
    keep = (np.arange(most) < used[:, None]) & fine[:, None]
    c, n_codes = codes[keep].astype(np.int32), np.where(fine, used, 0)
    first = np.repeat(np.cumsum(n_codes) - n_codes, n_codes).astype(np.int32)
    me = np.arange(len(c), dtype=np.int32)
    literal = c < clear
    ref = np.where(literal, me, first + c - clear - 2)
    bad = ~literal & (ref >= me)
    if bad.any():
        fine &= np.bincount(np.repeat(np.arange(rows), n_codes)[bad], minlength=rows) == 0
        return [x if ok else None for x, ok in zip(spread(lzw_decode_all([s for s, ok in zip(streams, fine, strict=True) if ok], min_size), fine), fine, strict=True)]
    size, to = (~literal).astype(np.int32), ref
    while True:
        step = size[to]
        if not step.any():
            break
        size, to = size + step, to[to]
    size += 1
    ends = np.cumsum(size, dtype=np.int64)
    start = (ends - size).astype(np.int32)
    src = np.repeat(np.where(literal, 0, start[ref] - start), size) + np.arange(int(ends[-1]) if len(c) else 0, dtype=np.int32)
    while True:
        nxt = src[src]
        if np.array_equal(nxt, src):
            break
        src = nxt
    value = np.repeat(c, size).astype(np.uint8)
    data = value[src].tobytes()
    cuts = [0, *np.concatenate([[0], ends])[np.cumsum(n_codes)].tolist()]
    return [data[a:b] if ok else None for a, b, ok in zip(cuts, cuts[1:], fine, strict=False)]


def spread(some: list, where: np.ndarray) -> list:
    """``some`` at the true places, None at the others."""
    it = iter(some)
    return [next(it) if ok else None for ok in where]


def blocks(stream: bytes) -> bytes:
    """A stream as sub-blocks of at most 255 bytes and the empty one that ends them."""
    return b"".join(x for i in range(0, len(stream), 255) for x in (bytes([min(255, len(stream) - i)]), stream[i : i + 255])) + b"\0"


@lru_cache(maxsize=1)
def tile_palette() -> bytes:
    """256 colours by rule, all different: three bits of red and green, two of blue."""
    return bytes(x for i in range(256) for x in ((i >> 5) * 36, ((i >> 2) & 7) * 36, (i & 3) * 85))


def encode_all(images: list[list[bytes]], width: int, height: int, palette: bytes, delay_cs: int = DELAY_CS, transparent: int | None = None, disposal: int = 1) -> list[bytes]:
    """GIF89a streams of full frames, each with one global palette of 2, 4, ... 256 colours; the frames of all are coded together."""
    depth = max(1, (len(palette) // 3 - 1).bit_length())
    min_size = max(2, depth)
    head = b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF0 | (depth - 1), 0, 0) + palette + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"
    lead = b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent is not None), delay_cs, transparent or 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + bytes([min_size])
    streams = iter(lzw_encode([r for rasters in images for r in rasters], min_size))
    return [head + b"".join([lead + blocks(next(streams)) for _ in rasters]) + b"\x3b" for rasters in images]


def encode(rasters: list[bytes], width: int, height: int, palette: bytes, **rules) -> bytes:
    """One GIF89a stream; see ``encode_all``."""
    return encode_all([rasters], width, height, palette, **rules)[0]


def colours(table: bytes) -> np.ndarray:
    """Colours as 0xFFRRGGBB; entries past the table's end are black."""
    rgb = np.frombuffer(table, np.uint8).reshape(-1, 3).astype(np.uint32)
    out = np.full(256, 0xFF000000, np.uint32)
    out[: len(rgb)] |= rgb[:, 0] << 16 | rgb[:, 1] << 8 | rgb[:, 2]
    return out


@lru_cache(maxsize=1)
def greys() -> bytes:
    return bytes(x for i in range(256) for x in (i, i, i))


def rows_of(height: int) -> np.ndarray:
    """Where the rows of an interlaced raster go."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes | None) -> Gif:
    """All frames up to the end or the first fault."""
    return decode_all([data])[0]


def decode_all(images: list[bytes | None]) -> list[Gif]:
    """Many images; the code streams of all are decoded together."""
    parsed = [parse(x) for x in images]
    fill(parsed)
    return [gif for gif, _ in parsed]


def parse(data: bytes | None) -> tuple[Gif, list[tuple[bytes, int, bool]]]:
    """Frames without rasters, and each frame's code stream, code size and whether its rows are interlaced."""
    out, coded = Gif(), []
    if data is None:
        return out, coded
    try:
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("no GIF signature")
        out.width, out.height, flags, out.background, _ = struct.unpack_from("<HHBBB", data, 6)
        at, shared = 13, greys()
        if flags & 0x80:
            shared, at = data[13 : 13 + (3 << ((flags & 7) + 1))], 13 + (3 << ((flags & 7) + 1))
            if len(shared) != at - 13:
                raise ValueError("the palette is cut")
        shared_colours = colours(shared)
        transparent, disposal, delay = -1, 0, 0

        def chained(at: int) -> tuple[bytes, int]:
            parts = []
            while n := data[at]:
                parts.append(data[at + 1 : at + 1 + n])
                at += n + 1
            return b"".join(parts), at + 1

        while (kind := data[at]) != 0x3B:
            if kind == 0x21:
                label = data[at + 1]
                body, at = chained(at + 2)
                if label == 0xF9 and len(body) >= 4:
                    f, delay, t = struct.unpack_from("<BHB", body)
                    disposal, transparent = f >> 2 & 7, t if f & 1 else -1
                elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                    out.loops = struct.unpack_from("<H", body, 12)[0]
            elif kind == 0x2C:
                left, top, w, h, f = struct.unpack_from("<HHHHB", data, at + 1)
                at, own = at + 10, shared_colours
                if f & 0x80:
                    size = 3 << ((f & 7) + 1)
                    own, at = colours(data[at : at + size]), at + size
                min_size = data[at]
                if not 1 <= min_size <= 11:
                    raise ValueError(f"code size {min_size}")
                stream, at = chained(at + 1)
                coded.append((stream, min_size, bool(f & 0x40)))
                out.frames.append(Frame(left, top, w, h, NO_RASTER, own, transparent, disposal, delay))
                transparent, disposal, delay = -1, 0, 0
            else:
                raise ValueError(f"block {kind:#x}")
    except (ValueError, IndexError, struct.error) as e:
        out.error = str(e) or "the stream is cut"
    return out, coded


def fill(parsed: list[tuple[Gif, list[tuple[bytes, int, bool]]]]) -> None:
    """Decode the frames' code streams into their rasters; a fault drops an image's frames from there on."""
    every = [x for _, coded in parsed for x in coded]
    quick: dict[int, bytes] = {}
    for size in {m for _, m, _ in every}:
        own = [i for i, x in enumerate(every) if x[1] == size]
        for k in range(0, len(own), 1024):
            part = own[k : k + 1024]
            quick |= {i: x for i, x in zip(part, lzw_decode_all([every[i][0] for i in part], size), strict=True) if x is not None}
    at = 0
    for gif, coded in parsed:
        for i, (stream, min_size, woven) in enumerate(coded):
            f = gif.frames[i]
            try:
                pixels = (quick[at + i] if at + i in quick else lzw_decode(stream, min_size))[: f.width * f.height]
            except ValueError as e:
                gif.error = str(e)
                del gif.frames[i:]
                break
            if len(pixels) < f.width * f.height:
                gif.error = "a raster is cut"
                pixels += bytes(f.width * f.height - len(pixels))
            f.raster = np.frombuffer(pixels, np.uint8)
            if woven and f.height:
                rows = np.empty((f.height, f.width), np.uint8)
                rows[rows_of(f.height)] = f.raster.reshape(f.height, f.width)
                f.raster = rows.reshape(-1)
        at += len(coded)


def compose(gif: Gif) -> Iterator[np.ndarray]:
    """The canvas (0xAARRGGBB, alpha 0 where nothing is drawn) as shown with each frame. It holds until the next is asked for."""
    canvas = np.zeros((gif.height, gif.width), np.uint32)
    for f in gif.frames:
        y, x = slice(f.top, min(gif.height, f.top + f.height)), slice(f.left, min(gif.width, f.left + f.width))
        area = canvas[y, x]
        before = canvas.copy() if f.disposal == 3 else None
        drawn = f.raster.reshape(f.height, f.width)[: area.shape[0], : area.shape[1]]
        if f.transparent < 0:
            area[...] = f.palette[drawn]
        else:
            np.copyto(area, f.palette[drawn], where=drawn != f.transparent)
        yield canvas
        if f.disposal == 2:
            area[...] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of 64 colours (two bits of each channel) of what is drawn."""
    c = canvas.ravel()
    if not c.size or int(c.min()) >> 24 == 0:
        c = c[c >> 24 != 0]
    return np.bincount((c >> 18 & 48) | (c >> 12 & 12) | (c >> 6 & 3), minlength=BINS)


FRAMES = "frame int, start_ms long, delay_ms long, left int, top int, width int, height int, disposal int, transparent int, raster binary, canvas binary, histogram array<long>, error string"


def frame_table(df: DataFrame, media_col: str, id_col: str) -> DataFrame:
    """One row for each frame: its place and time, rules, indices, the composed canvas as RGBA and its colour histogram."""
    kind = df.schema[id_col].dataType
    types = pa.schema([("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), *[(n, pa.int32()) for n in ("left", "top", "width", "height", "disposal", "transparent")], ("raster", pa.binary()), ("canvas", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                gif, start, own = decode(b.column(1)[i].as_py()), 0, []
                for k, (f, canvas) in enumerate(zip(gif.frames, compose(gif), strict=True)):
                    rgba = np.stack([canvas >> s & 255 for s in (16, 8, 0, 24)], -1).astype(np.uint8)
                    own.append({"frame": k, "start_ms": start, "delay_ms": f.delay_cs * 10, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "disposal": f.disposal, "transparent": f.transparent, "raster": f.raster.tobytes(), "canvas": rgba.tobytes(), "histogram": histogram(canvas).tolist(), "error": gif.error})
                    start += f.delay_cs * 10
                if not own and gif.error:
                    own = [{"error": gif.error}]
                if own:
                    out = pa.RecordBatch.from_pylist(own, types)
                    ids = pa.array([b.column(0)[i].as_py()] * len(own), b.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([ids, *out.columns], names=[id_col, *types.names])

    return map_arrow(df.select(id_col, media_col), rows, f"`{id_col}` {kind.simpleString()}, {FRAMES}", 32)


def store_texts(texts: list[str]) -> list[bytes]:
    """The texts' UTF-8 bytes as animations of 24 x 24 tiles, each byte one sample."""
    images = []
    for t in texts:
        payload = t.encode("utf-8", "surrogatepass")
        payload += bytes([PAD]) * (-len(payload) % TILE if payload else TILE)
        images.append([payload[i : i + TILE] for i in range(0, len(payload), TILE)])
    return encode_all(images, SIDE, SIDE, tile_palette())


STORED = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "frames": pa.int64(), "duration_ms": pa.int64(), "colour_histogram": pa.list_(pa.int64())}


def digest(n_bytes: int, media: bytes, gif: Gif) -> tuple:
    """The columns of op1, all but n_bytes from the stored form and what was decoded of it."""
    if gif.error:
        raise ValueError(f"a stored text can't be read back: {gif.error}")
    payload = b"".join(f.raster.tobytes() for f in gif.frames)
    ms = sum(f.delay_cs for f in gif.frames) * 10
    hist = histogram(np.concatenate([c.copy() for c in compose(gif)]))
    feature = f"{len(gif.frames)}x{gif.width}x{gif.height};{ms};" + ",".join(map(str, hist.tolist()))
    return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(gif.frames), ms, hist.tolist()


def op1_gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an animated GIF and read back; a text that comes again at once is not coded again."""
    docs = documents(spark, sf_dir)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            own = list(dict.fromkeys(texts))
            media = store_texts(own)
            seen = {t: digest(len(t.encode("utf-8", "surrogatepass")), m, g) for t, m, g in zip(own, media, decode_all(media), strict=True)}
            found = [seen[t] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in found], kind) for i, kind in enumerate(STORED.values())]], names=["doc_id", *STORED])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames long, duration_ms long, colour_histogram array<long>"
    return map_arrow(docs.select("doc_id", text_of(docs).alias("text")), rows, schema)


QUERIES = {"op1_gif_frames": op1_gif_frames}
