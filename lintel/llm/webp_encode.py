"""Writing lossless WebP, and the store of text payloads as 8-bit samples.

`encode` writes any pixels with any of the format's transforms, a colour cache,
copies and several prefix-code groups. The store writes a payload by what it holds,
so that equal payloads have equal files:

* few different bytes: an image 64 pixels wide with a palette, several indexes to a
  pixel, and copies;
* mostly repetition: an image 16 pixels wide with four samples to a pixel,
  predictor and cross-colour tiles of the least residuals, a colour cache and copies;
* some repetition: the bytes as green samples, 64 to a row, with copies, under a
  fixed prefix code;
* all else: the same without copies; these files are written a batch at a time.

What is taken goes by content alone, never by length. All of them are read by
`webp.decode`.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintel.llm import common, webp
from lintel.llm.webp import CROSS_COLOUR, PALETTE, PREDICTOR, SIGNATURE, SUBTRACT_GREEN, Writer

WIDTH = 64
#: Bytes of payload in one file: the format's tallest image at this width.
FILE_BYTES = WIDTH * webp.MAX_SIDE


def container(stream: bytes) -> bytes:
    """A VP8L stream as a file."""
    pad = b"\0" * (len(stream) % 2)
    return b"RIFF" + (12 + len(stream) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + pad


def tokens_of(argb: np.ndarray, width: int, cache_bits: int, copies: bool) -> list[tuple[int, int, int]]:
    """(kind, a, b) of each token: 0 a plain pixel, 1 a copy (length, distance), 2 a cache slot."""
    flat, out, i = argb.reshape(-1).tolist(), [], 0
    size = len(flat)
    three = list(zip(flat, flat[1:], flat[2:])) if copies else []
    last: dict = {}
    cache = [0] * (1 << cache_bits) if cache_bits else None
    slots = webp.colour_slot(argb.reshape(-1), cache_bits).tolist() if cache_bits else []
    while i < size:
        j = last.get(three[i]) if i < len(three) else None
        if j is not None:
            n, most = 3, min(4096, size - i)
            while n < most and flat[j + n] == flat[i + n]:
                n += 1
            out.append((1, n, i - j))
        else:
            n = 1
            hit = cache is not None and cache[slots[i]] == flat[i]
            out.append((2, slots[i], 0) if hit else (0, flat[i], 0))
        if copies:
            last.update(zip(three[i : i + n], range(i, i + n)))
        if cache is not None:
            for k in range(i, i + n):
                cache[slots[k]] = flat[k]
        i += n
    return out


@lru_cache(8)
def _near_codes(width: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, (dx, dy) in enumerate(webp.plane_offsets()):
        out.setdefault(max(1, dx + dy * width), k + 1)
    return out


def distance_code(far: int, width: int) -> int:
    """The short code of a distance, if the format has one."""
    return _near_codes(width).get(far, far + 120)


def _tiles(cost: np.ndarray, shift: int) -> np.ndarray:
    """Costs by pixel summed over tiles."""
    side = 1 << shift
    h, w = cost.shape
    cost = np.pad(cost, ((0, -h % side), (0, -w % side)))
    return cost.reshape(cost.shape[0] // side, side, -1, side).sum((1, 3))


def _size(residual: np.ndarray) -> np.ndarray:
    """How far residuals are from 0, around 256, over the channels."""
    r = residual & 255
    return np.minimum(r, 256 - r).sum(-1)


def best_modes(pixels: np.ndarray, shift: int) -> np.ndarray:
    """The predictor of the least residuals for each tile."""
    return np.argmin([_tiles(_size(pixels - webp.guesses(pixels, m)), shift) for m in range(14)], axis=0).astype(np.uint32)


#: Multipliers that are tried, in 32nds: of green for red, of green for blue, of red for blue.
CROSS = [(0, 0, 0), (32, 32, 0), (32, 0, 32), (16, 16, 0), (-32, -32, 0)]


def best_crosses(argb: np.ndarray, shift: int) -> np.ndarray:
    """The multipliers of the least residuals for each tile, as pixels of their image."""
    tile = lambda m: np.uint32(255 << 24 | (m[2] & 255) << 16 | (m[1] & 255) << 8 | m[0] & 255)
    shape = tuple((x + (1 << shift) - 1) >> shift for x in argb.shape)
    cost = [_tiles(_size(webp.cross_colour_pass(webp._channels(argb), np.full(shape, tile(m), np.uint32), shift, False)[..., ::2]), shift) for m in CROSS]
    return np.array([tile(m) for m in CROSS], np.uint32)[np.argmin(cost, axis=0)]


def write_image(w: Writer, argb: np.ndarray, main: bool, cache_bits: int = 0, copies: bool = False, group_shift: int = 0) -> None:
    """An entropy-coded image; group_shift gives each tile column a code group of its own."""
    height, width = argb.shape
    w.put(int(cache_bits > 0), 1)
    w.put(cache_bits, 4 if cache_bits else 0)
    tiles = None
    if main:
        w.put(int(group_shift > 0), 1)
        if group_shift:
            w.put(group_shift - 2, 3)
            across, down = (width + (1 << group_shift) - 1) >> group_shift, (height + (1 << group_shift) - 1) >> group_shift
            tiles = np.tile(np.arange(across) % 2, (down, 1)).astype(np.uint32)
            write_image(w, tiles << np.uint32(8), False)
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    count = 1 if tiles is None else int(tiles.max()) + 1
    kind, a, b = np.array(tokens_of(argb, width, cache_bits, copies), np.int64).reshape(-1, 3).T
    plain, copy = kind == 0, np.flatnonzero(kind == 1)
    # up to four symbols a token, each with its channel's code and extra bits
    channel = np.tile(np.arange(4), (len(kind), 1))
    symbol, extra, more = (np.zeros(channel.shape, np.int64) for _ in range(3))
    symbol[:] = np.stack([a >> 8 & 255, a >> 16 & 255, a & 255, a >> 24], 1)
    symbol[kind == 2, 0] = 280 + a[kind == 2]
    use = np.ones(channel.shape, bool)
    use[~plain, 1:] = False
    if len(copy):
        use[copy, 1], channel[copy, 1] = True, 4
        far = [distance_code(x, width) for x in b[copy].tolist()]
        for c, values in enumerate((a[copy].tolist(), far)):
            symbol[copy, c], extra[copy, c], more[copy, c] = np.array([webp.split_prefix(x) for x in values], np.int64).T
        symbol[copy, 0] += 256
    size = np.where(kind == 1, a, 1)
    at = np.cumsum(size) - size
    group = np.zeros(len(kind), np.int64) if tiles is None else tiles[(at // width) >> group_shift, (at % width) >> group_shift].astype(np.int64)
    table = (5 * group[:, None] + channel)[use]
    symbol, extra, more = symbol[use], extra[use], more[use]
    codes, lengths = [], []
    for k in range(5 * count):
        x = webp.code_lengths(np.bincount(symbol[table == k], minlength=sizes[k % 5]))
        webp.write_code(w, x)
        codes.append(webp.canonical(x))
        lengths.append(x if (x > 0).sum() > 1 else x * 0)
    first = np.cumsum([0, *map(len, codes)])[table] + symbol
    code, length = np.concatenate(codes)[first], np.concatenate(lengths)[first]
    w.codes(np.where(length > 0, code, 0) | extra << length, length + more)


def encode(argb: np.ndarray, transforms: tuple = (), cache_bits: int = 0, copies: bool = False, group_shift: int = 0, seed: int | None = 0) -> bytes:
    """A file of (height, width) ARGB pixels; transforms in the order they are applied.

    Predictor modes and cross-colour multipliers are drawn from `seed`, for variety,
    or taken by the least residuals of each tile if it is None.
    """
    argb = np.ascontiguousarray(argb, np.uint32)
    height, width = argb.shape
    rng, w = np.random.default_rng(seed), Writer()
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        across, down, shift = (argb.shape[1] + 3) >> 2, (height + 3) >> 2, 2
        if kind == PREDICTOR:
            w.put(0, 3)
            modes = best_modes(webp._channels(argb), shift) if seed is None else rng.integers(0, 14, (down, across)).astype(np.uint32)
            write_image(w, modes << np.uint32(8), False)
            argb = webp._join(webp.predictor_pass(webp._channels(argb), modes, shift, False))
        elif kind == CROSS_COLOUR:
            w.put(0, 3)
            tiles = best_crosses(argb, shift) if seed is None else rng.integers(0, 1 << 24, (down, across)).astype(np.uint32)
            write_image(w, tiles, False)
            argb = webp._join(webp.cross_colour_pass(webp._channels(argb), tiles, shift, False))
        elif kind == SUBTRACT_GREEN:
            c = webp._channels(argb)
            for k in (0, 2):
                c[..., k] = c[..., k] - c[..., 1] & 255
            argb = webp._join(c)
        elif kind == PALETTE:
            colours, index = np.unique(argb, return_inverse=True)
            index = index.reshape(argb.shape)
            if len(colours) > 256:
                raise ValueError("too many colours for a palette")
            w.put(len(colours) - 1, 8)
            c = webp._channels(colours)
            write_image(w, webp._join(np.diff(c, axis=0, prepend=0) & 255)[None, :], False)
            pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            index = np.pad(index, ((0, 0), (0, -index.shape[1] % (1 << pack))))
            index = (index.reshape(height, -1, 1 << pack) << (8 >> pack) * np.arange(1 << pack)).sum(2)
            argb = index.astype(np.uint32) << np.uint32(8)
    w.put(0, 1)
    write_image(w, argb, True, cache_bits, copies, group_shift)
    return container(w.bytes())


@lru_cache(2)
def fixed_lengths(copies: bool = False) -> np.ndarray:
    """The store's prefix code: lengths from rough byte frequencies of prose in UTF-8, and of copies' lengths."""
    freq = np.ones(280, np.int64)
    freq[256:] = 0
    freq[32:127] = 12
    freq[128:192] = 8
    for chars, weight in (("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ.,", 24), ("bcdfgkmpquvwxyzj", 80), ("lhdu", 200), ("etaoinsr", 480), (" ", 900), ("\n", 60), ("\0", 40), ("\xc3", 100)):
        for c in chars:
            freq[ord(c)] = weight
    if copies:
        freq[256:280] = 40
    return webp.code_lengths(freq, 12)


@lru_cache(2)
def fixed_codes(copies: bool = False) -> tuple[np.ndarray, np.ndarray]:
    return webp.canonical(fixed_lengths(copies)).astype(np.int64), fixed_lengths(copies).astype(np.int64)


@lru_cache(1)
def fixed_distances() -> tuple[np.ndarray, np.ndarray]:
    """The code of copies' distances: all alike."""
    lengths = webp.code_lengths(np.ones(40, np.int64))
    return webp.canonical(lengths).astype(np.int64), lengths.astype(np.int64)


@lru_cache(2)
def fixed_head(copies: bool = False) -> tuple[np.ndarray, int]:
    """The bits between the sizes and the pixels, as bytes, and their number."""
    w = Writer()
    for value, n in ((0, 1), (0, 1), (0, 1)):  # no transform, no cache, one group
        w.put(value, n)
    webp.write_code(w, fixed_lengths(copies))
    for s in (0, 0, 255):
        webp.write_code(w, np.bincount([s], minlength=256))
    webp.write_code(w, fixed_distances()[1] if copies else np.bincount([0], minlength=40))
    return np.frombuffer(w.bytes(), np.uint8), w.bits()


def _sizes_field(payload: np.ndarray) -> bytes:
    return (SIGNATURE | (WIDTH - 1) << 8 | (len(payload) // WIDTH - 1) << 22).to_bytes(5, "little")


def encode_samples(payloads: list[np.ndarray]) -> list[bytes]:
    """A file of each payload (a multiple of WIDTH, at most FILE_BYTES long), plain samples under the fixed code."""
    if not payloads:
        return []
    code, length = fixed_codes()
    head, head_bits = fixed_head()
    data = np.concatenate(payloads)
    sizes = np.array([len(p) for p in payloads])
    bits = length[data]
    first = np.cumsum(sizes) - sizes
    total = np.add.reduceat(bits, first) + head_bits
    room = (total + 7 >> 3) + 8
    start = np.cumsum(room) - room
    ends = np.cumsum(bits)
    at = ends - bits
    at += np.repeat(8 * start + head_bits - at[first], sizes)
    sums = np.bincount(at >> 3, weights=code[data] << (at & 7), minlength=int(room.sum())).astype(np.int64)
    out = sums & 255
    out[1:] += sums[:-1] >> 8 & 255
    out[2:] += sums[:-2] >> 16
    out = out.astype(np.uint8)
    files = []
    for k, n in enumerate(total):
        lo = start[k]
        out[lo : lo + len(head)] |= head
        files.append(container(_sizes_field(payloads[k]) + out[lo : lo + (int(n) + 7 >> 3)].tobytes()))
    return files


def earlier(payload: np.ndarray) -> np.ndarray:
    """For each place the last one before it with the same eight bytes, -1 for none."""
    n = len(payload) - 7
    w = np.lib.stride_tricks.sliding_window_view(payload, 8).copy().view("<u8")[:, 0]
    mixed = np.sort(common.mix64(w) >> np.uint64(20) << np.uint64(20) | np.arange(n, dtype=np.uint64))  # a file has at most 2^20 bytes
    place = (mixed & np.uint64((1 << 20) - 1)).astype(np.int64)
    same = np.flatnonzero(mixed[1:] >> np.uint64(20) == mixed[:-1] >> np.uint64(20))
    same = same[w[place[same + 1]] == w[place[same]]]
    out = np.full(n, -1)
    out[place[same + 1]] = place[same]
    return out


def encode_copies(payload: np.ndarray, before: np.ndarray) -> bytes:
    """A file of samples and copies of eight or more under the fixed codes."""
    code, length = fixed_codes(True)
    far_code, far_length = fixed_distances()
    head, head_bits = fixed_head(True)
    n, i, k = len(payload), 0, 0
    places = np.flatnonzero(before >= 0)
    back = places - before[places]
    # places in a row with one distance continue one match
    ends = np.flatnonzero(np.append((np.diff(places) != 1) | (np.diff(back) != 0), True)) if len(places) else np.zeros(0, np.int64)
    last = places[ends][np.searchsorted(ends, np.arange(len(places)))]
    run = (np.minimum(last - places, 4088) + 8).tolist()
    found, back = places.tolist(), back.tolist()
    at, many, far = [], [], []
    while k < len(found):
        i = found[k]
        at.append(i)
        many.append(run[k])
        far.append(back[k])
        i += run[k]
        k += 1
        while k < len(found) and found[k] < i:
            k = bisect_left(found, i, k)
    at, many, far = (np.array(x, np.int64) for x in (at, many, far))
    edge = np.zeros(n + 1, np.int64)
    edge[at] += 1
    edge[at + many] -= 1
    plain = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    near = _near_codes(WIDTH)
    prefix = [np.array([webp.split_prefix(x) for x in v], np.int64).reshape(-1, 3) for v in (many.tolist(), [near.get(x, x + 120) for x in far.tolist()])]
    (s, x, sx), (t, y, ty) = (p.T for p in prefix)
    # four fields at each copy's place among the single ones of the plain samples
    place = np.concatenate([4 * plain, *(4 * at + c for c in range(4))])
    value = np.concatenate([code[payload[plain]], code[256 + s], x, far_code[t], y])
    width = np.concatenate([length[payload[plain]], length[256 + s], sx, far_length[t], ty])
    order = np.argsort(place, kind="stable")
    w = Writer()
    w.parts.append(np.unpackbits(head, bitorder="little")[:head_bits])
    w.codes(value[order], width[order])
    return container(_sizes_field(payload) + w.bytes())


#: Different bytes up to which a palette is taken; the share of places whose eight bytes came before from which on copies are, and four samples a pixel.
PALETTE_MOST, SOME_REPEATS, MUCH_REPEATED = 16, 0.1, 0.5
#: The colour cache of payloads with four samples a pixel.
CACHE_BITS = 6


def encode_payloads(payloads: list[np.ndarray]) -> list[bytes]:
    """A file of each payload, by what it holds (see above)."""
    files: list = [None] * len(payloads)
    plain = []
    for k, p in enumerate(payloads):
        if (np.bincount(p, minlength=256) > 0).sum() <= PALETTE_MOST:
            files[k] = encode(p.astype(np.uint32).reshape(-1, WIDTH) << np.uint32(8) | np.uint32(255 << 24), (PALETTE,), 0, True, seed=None)
            continue
        before = earlier(p)
        repeated = np.count_nonzero(before >= 0) / len(p)
        if repeated >= MUCH_REPEATED:
            files[k] = encode(p.view("<u4").reshape(-1, WIDTH // 4), (PREDICTOR, CROSS_COLOUR), CACHE_BITS, True, seed=None)
        elif repeated >= SOME_REPEATS:
            files[k] = encode_copies(p, before)
        else:
            plain.append(k)
    for k, f in zip(plain, encode_samples([payloads[k] for k in plain])):
        files[k] = f
    return files


def samples_of(media: bytes) -> np.ndarray:
    """The samples of a stored file: green ones, or all four of each pixel where the image is narrow."""
    argb = webp.decode(media)
    if argb.shape[1] == WIDTH:
        return (argb >> np.uint32(8)).astype(np.uint8).reshape(-1)
    return argb.astype("<u4").reshape(-1).view(np.uint8)


def payload_of(text: np.ndarray) -> np.ndarray:
    """A text's bytes with zeros up to a positive multiple of 64."""
    size = max(64, -(-len(text) // 64) * 64)
    out = np.zeros(size, np.uint8)
    out[: len(text)] = text
    return out


def feature_of(samples: np.ndarray) -> str:
    """Mean and variance of the samples in thousandths, and which columns are above the mean."""
    columns = samples.reshape(-1, WIDTH).sum(0, dtype=np.int64)
    total, n = int(columns.sum()), len(samples)
    square = int((np.bincount(samples, minlength=256) * np.arange(256) ** 2).sum())
    mean = total * 1000 // n
    variance = (square * n - total * total) * 1000 // (n * n)
    above = np.packbits(columns * WIDTH > total).tobytes().hex()
    return f"h{n // WIDTH}-m{mean}-v{variance}-{above}"


def media_of(texts: pa.Array) -> list[bytes]:
    """The stored form of each text; long payloads become several files, one after another."""
    buf, off = common.flat(texts)
    chunks, owner = [], []
    for i in range(len(off) - 1):
        payload = payload_of(buf[off[i] : off[i + 1]])
        for j in range(0, len(payload), FILE_BYTES):
            chunks.append(payload[j : j + FILE_BYTES])
            owner.append(i)
    media: list[list[bytes]] = [[] for _ in range(len(off) - 1)]
    for i, f in zip(owner, encode_payloads(chunks)):
        media[i].append(f)
    return [b"".join(m) for m in media]


def read_back(media: bytes) -> np.ndarray:
    """The samples of all files of a stored form."""
    parts, at = [], 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        parts.append(samples_of(media[at : at + n]))
        at += n
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


FIGURES = T.StructType(
    [T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
)
MEDIA = T.StructType([*FIGURES.fields, T.StructField("media", T.BinaryType())])


def store_texts(docs: DataFrame, text: str = "text", out: str = "webp", columns: list[str] | None = None) -> DataFrame:
    """`docs` with a struct column `out` (MEDIA): the text as lossless WebP, and what is read back from the stored bytes.

    Of the other columns `columns` are kept, or all. The files are written to the shared folder first, as a checkpoint, and read
    from there. A null text counts as empty; equal texts give equal values; an
    empty table gives an empty one. A column already named `out` is replaced. No
    shuffle.
    """
    common.ship(docs.sparkSession)
    rest = [c for c in (docs.columns if columns is None else columns) if c != out]
    src = docs.select(F.struct(*[docs[f"`{c}`"] for c in rest]).alias("r"), docs[f"`{text}`"].cast("string").alias("t"))

    def write(batches):
        for batch in batches:
            for part in common.pieces(batch, "t", 256 << 10):
                texts = part.column("t")
                size = np.diff(common.flat(texts)[1])
                yield pa.RecordBatch.from_arrays([part.column("r"), pa.array(size, pa.int64()), pa.array(media_of(texts), pa.binary())], ["r", "n", "m"])

    stored = common.checkpoint(src.mapInArrow(write, T.StructType([src.schema["r"], T.StructField("n", T.LongType()), T.StructField("m", T.BinaryType())])))

    def read(batches):
        for batch in batches:
            for part in common.pieces(batch, "m", 256 << 10):
                rows = []
                for n, media in zip(part.column("n").to_pylist(), part.column("m").to_pylist()):
                    samples = read_back(media)
                    raw = samples.tobytes()
                    rows.append((n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples), media))
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                s = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], MEDIA.names)
                yield pa.RecordBatch.from_arrays([part.column("r"), s], ["r", "s"])

    return stored.mapInArrow(read, T.StructType([src.schema["r"], T.StructField("s", MEDIA)])).select("r.*", F.col("s").alias(out))


PIXELS = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType())])


def read_pixels(df: DataFrame, media: str = "media", out: str = "image") -> DataFrame:
    """`df` with a struct column `out`: width, height, little-endian ARGB pixels, or what is wrong with the file.

    A null file gives a null struct.
    """
    common.ship(df.sparkSession)
    src = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns if c != out]).alias("r"), df[f"`{media}`"].alias("m"))

    def one(data):
        if data is None:
            return None
        try:
            argb = webp.decode(data)
            return {"width": argb.shape[1], "height": argb.shape[0], "pixels": argb.astype("<u4").tobytes(), "error": None}
        except (ValueError, IndexError) as e:
            return {"width": None, "height": None, "pixels": None, "error": str(e)}

    kind = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "m", 256 << 10):
                s = pa.array([one(x) for x in part.column("m").to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([part.column("r"), s], ["r", "s"])

    return src.mapInArrow(run, T.StructType([src.schema["r"], T.StructField("s", PIXELS)])).select("r.*", F.col("s").alias(out))
