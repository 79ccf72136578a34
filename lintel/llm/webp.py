"""Lossless WebP (VP8L): a decoder for the whole bitstream, and an encoder.

Decoding a prefix-coded stream is sequential: where a symbol starts is known only
when the one before it has been read. The decoder here reads every bit offset as
if a pixel started there, all at once with numpy (code lookup, extra bits,
distance, total length), and then only walks the chain of starts. Of images whose
pixels differ in green alone, without copies, as many pixels as 16 bits hold are
looked up together. Images with several prefix-code groups, where the tables depend
on the pixel's place, or with a colour cache are read pixel by pixel.

The container is RIFF/WEBP with one VP8L chunk.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH_MULTIPLIER = 0x1E35A7BD
SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
MAX_SIDE = 16384
MAX_BITS = 15
#: Bits whose symbols are looked up together: one symbol at least.
RUN = 16


@lru_cache(1)
def plane_offsets() -> list[tuple[int, int]]:
    """The format's 120 near offsets (dx, dy): by distance, then |dx|, then dx > 0 first."""
    near = [(dx, dy) for dy in range(8) for dx in range(-7, 9) if dy > 0 or dx > 0]
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


class Bits:
    """Reads little-endian bit fields."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("truncated VP8L stream")
        byte, shift = divmod(self.at, 8)
        out = int.from_bytes(self.data[byte : byte + 8], "little") >> shift & (1 << n) - 1
        self.at += n
        return out


class Writer:
    """Writes little-endian bit fields; `put` takes one, `codes` many at once."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.value, self.size = 0, 0  # fields put since the last part

    def put(self, value: int, n: int) -> None:
        self.value |= int(value) << self.size
        self.size += n
        if self.size > 4096:
            self.flush()

    def flush(self) -> None:
        if self.size:
            raw = np.frombuffer(self.value.to_bytes((self.size + 7) // 8, "little"), np.uint8)
            self.parts.append(np.unpackbits(raw, bitorder="little")[: self.size])
            self.value = self.size = 0

    def codes(self, value: np.ndarray, n: np.ndarray) -> None:
        self.flush()
        n = n.astype(np.int64)
        which = np.repeat(np.arange(len(n)), n)
        start = np.cumsum(n) - n
        self.parts.append((value.astype(np.uint64)[which] >> (np.arange(len(which)) - start[which]).astype(np.uint64) & np.uint64(1)).astype(np.uint8))

    def bits(self) -> int:
        self.flush()
        return sum(map(len, self.parts))

    def bytes(self) -> bytes:
        self.flush()
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes() if self.parts else b""


def code_lengths(freq: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Huffman code lengths of at most `most` bits; a lone symbol gets length 1."""
    freq = np.asarray(freq, np.int64)
    used = np.flatnonzero(freq)
    out = np.zeros(len(freq), np.int64)
    if len(used) == 1:
        out[used] = 1
    floor = 1
    while len(used) > 1:  # until the tree is shallow enough
        heap = [(max(f, floor), k) for k, f in enumerate(freq[used].tolist())]
        heapify(heap)
        up, n = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            a, x = heappop(heap)
            b, y = heappop(heap)
            up[x] = up[y] = n
            heappush(heap, (a + b, n))
            n += 1
        depth = [0] * n
        for k in range(n - 2, -1, -1):
            depth[k] = depth[up[k]] + 1
        out[used] = depth[: len(used)]
        if out.max() <= most:
            break
        floor *= 2  # flatter counts make a shallower tree
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Bit-reversed canonical codes, as they lie in the stream."""
    lengths = np.asarray(lengths, np.int64)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    out, code, last = np.zeros(len(lengths), np.int64), 0, 0
    values = []
    for n in lengths[used].tolist():
        code <<= n - last
        values.append(code)
        code, last = code + 1, n
    if values:
        out[used] = _reversed_bits()[np.array(values, np.int64)] >> 16 - lengths[used]
    return out


@lru_cache(1)
def _reversed_bits() -> np.ndarray:
    """Each 16-bit integer with its bits in the other order."""
    v = np.arange(1 << 16)
    out = np.zeros(1 << 16, np.int64)
    for k in range(16):
        out |= (v >> k & 1) << 15 - k
    return out


class Code:
    """A prefix code as a lookup table over the next `width` bits."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        used = np.flatnonzero(lengths)
        self.width, self.again, self._runs = 0, False, None
        self.symbol, self.length = np.zeros(1, np.int64), np.zeros(1, np.int64)
        if len(used) == 1:
            self.symbol[0] = used[0]
        elif len(used) > 1:
            if sum(1 << MAX_BITS - int(n) for n in lengths[used]) != 1 << MAX_BITS:
                raise ValueError("incomplete prefix code")
            self.width = int(lengths.max())
            order = used[np.argsort(lengths[used], kind="stable")]
            which = np.repeat(np.arange(len(order)), 1 << self.width - lengths[order])  # by the codes' first bits first
            which = which[_reversed_bits()[: 1 << self.width] >> 16 - self.width]
            self.symbol, self.length = order[which], lengths[order][which]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits, number, symbols) of the whole symbols below 256 that each value of RUN bits begins with."""
        if self._runs is None:
            used, count = np.zeros(1 << RUN, np.int64), np.zeros(1 << RUN, np.uint8)
            symbols = np.zeros((1 << RUN, RUN // int(self.length.min())), np.uint8)
            for k in range(symbols.shape[1]):  # bits beyond the run count as 0: a symbol that needs them is too long
                at = np.arange(1 << RUN) >> used & (1 << self.width) - 1
                size = self.length[at]
                fits = used + size <= RUN
                symbols[fits, k] = self.symbol[at[fits]]
                count[fits] = k + 1
                used = np.where(fits, used + size, RUN)
            ends = self._ends(symbols, count)
            self._runs = ends.astype(np.uint8), count, symbols
        return self._runs

    def sizes(self) -> np.ndarray:
        """The bits of each symbol."""
        out = np.zeros(int(self.symbol.max()) + 1, np.int64)
        out[self.symbol] = self.length
        return out

    def _ends(self, symbols: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.where(np.arange(symbols.shape[1]) < count[:, None], self.sizes()[symbols], 0).sum(1)

    def read(self, bits: Bits) -> int:
        if not self.width:
            return int(self.symbol[0])
        byte, shift = divmod(bits.at, 8)
        at = int.from_bytes(bits.data[byte : byte + 8], "little") >> shift & (1 << self.width) - 1
        bits.at += int(self.length[at])
        if bits.at > bits.size:
            raise ValueError("truncated VP8L stream")
        return int(self.symbol[at])


#: Codes read lately, by alphabet: (bits of their description, its value, code). Files of one store often share codes.
_READ: dict[int, list[tuple[int, int, Code]]] = {}
_READ_MOST, _READ_BYTES = 6, 200


def read_code(bits: Bits, size: int) -> Code:
    """A prefix code; one described by the same bits as a code read lately is not built again."""
    byte, shift = divmod(bits.at, 8)
    head = int.from_bytes(bits.data[byte : byte + _READ_BYTES], "little") >> shift
    known = _READ.setdefault(size, [])
    for k, (n, value, code) in enumerate(known):
        if head & (1 << n) - 1 == value and bits.at + n <= bits.size:
            bits.at += n
            code.again = True
            known.insert(0, known.pop(k))
            return code
    start = bits.at
    code = _parsed_code(bits, size)
    n = bits.at - start
    if n <= 8 * _READ_BYTES - 8:
        known.insert(0, (n, head & (1 << n) - 1, code))
        del known[_READ_MOST:]
    return code


def _parsed_code(bits: Bits, size: int) -> Code:
    """A prefix code's lengths, in the simple or the run-length form."""
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    meta = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        meta[CODE_LENGTH_ORDER[i]] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    code, i, last = Code(meta), 0, 8
    while i < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[i] = s
            last, i = s or last, i + 1
            continue
        run = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
        if i + run > size:
            raise ValueError("code lengths run over")
        lengths[i : i + run] = last if s == 16 else 0
        i += run
    return Code(lengths)


def write_code(w: Writer, lengths: np.ndarray) -> None:
    """The lengths of a prefix code: simple for up to two symbols, else run by run."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (len(used) == 0 or used.max() < 256):
        first = int(used[0]) if len(used) else 0
        w.put(1, 1)
        w.put(int(len(used) == 2), 1)
        w.put(1, 1)
        w.put(first, 8)
        if len(used) == 2:
            w.put(int(used[1]), 8)
        return
    tokens = []
    edges = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)]
    for value, run in zip(np.asarray(lengths)[edges[:-1]].tolist(), np.diff(edges).tolist()):
        while value == 0 and run >= 3:
            n = min(run, 138)
            tokens.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
            run -= n
        while run:
            tokens.append((value, 0, 0))
            run -= 1
            while value and run >= 3:
                n = min(run, 6)
                tokens.append((16, n - 3, 2))
                run -= n
    meta = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    if (meta > 0).sum() == 1:  # a lone symbol's code takes no bits, so give it a partner
        meta[0 if meta[0] == 0 else 1] = 1
    codes = canonical(meta)
    w.put(0, 1)
    count = max(k for k, s in enumerate(CODE_LENGTH_ORDER) if meta[s] or k < 4) + 1
    w.put(count - 4, 4)
    for s in CODE_LENGTH_ORDER[:count]:
        w.put(int(meta[s]), 3)
    w.put(0, 1)
    for s, extra, n in tokens:
        w.put(int(codes[s]), int(meta[s]))
        w.put(extra, n)


def split_prefix(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra value, extra bits) of a length or distance of 1 or more."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    high = v >> n  # 2 or 3
    return 2 * n + 2 + (high & 1), v & (1 << n) - 1, n


def _extended(symbol: int, bits: Bits) -> int:
    """A length or distance from its prefix symbol and the extra bits that follow."""
    if symbol < 4:
        return symbol + 1
    n = symbol - 2 >> 1
    return (2 + (symbol & 1) << n) + bits.read(n) + 1


def _joined(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base value, extra bits) of prefix symbols."""
    n = np.maximum(symbol - 2, 0) >> 1
    return np.where(symbol < 4, symbol + 1, (2 + (symbol & 1) << n) + 1), np.where(symbol < 4, 0, n)


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = plane_offsets()[code - 1]
    return max(1, dx + dy * width)


def colour_slot(argb, bits: int):
    """The colour cache's slot of a pixel."""
    return (np.asarray(argb, np.uint64) * np.uint64(HASH_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)


def windows(data: np.ndarray, first: int, last: int) -> np.ndarray:
    """The next 57 or more bits at each bit offset in first..last-1, as 64-bit integers."""
    lo, hi = first >> 3, last + 7 >> 3
    n = hi - lo + 1
    padded = np.concatenate([data[lo:hi], np.zeros(24, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view("<u8")
    return (words >> np.arange(8, dtype=np.uint64)).reshape(-1)[first - 8 * lo : last - 8 * lo]


def _look(code: Code, window: np.ndarray) -> np.ndarray:
    return (window & np.uint64((1 << code.width) - 1)).astype(np.int64)


def token_lengths(codes: list[Code], window: np.ndarray) -> np.ndarray:
    """How many bits the pixel or copy takes that would start at each offset.

    A token is at most 4 x 15 bits, or a length and a distance with their extra
    bits (15 + 10 + 15 + 18), so it is followed through shifted windows.
    """
    green, red, blue, alpha, dist = codes
    at = _look(green, window)
    total = green.length[at]
    n = len(window)
    if not (red.width or blue.width or alpha.width) and green.symbol.max() < 256:
        return total
    symbol, place = green.symbol[at], np.arange(n)
    get = lambda p: window[np.minimum(p, n - 1)]
    plain = symbol < 256
    here = np.where(plain, total, 0)
    for code in (red, blue, alpha):
        here = here + np.where(plain, code.length[_look(code, get(place + here))], 0)
    copy = (symbol >= 256) & (symbol < 280)
    _, extra = _joined(np.where(copy, symbol - 256, 0))
    far = total + extra
    at = _look(dist, get(place + far))
    _, more = _joined(dist.symbol[at])
    return np.where(plain, here, np.where(copy, far + dist.length[at] + more, total))


def _chain(step: np.ndarray, n: int) -> np.ndarray:
    """The places below n on the chain that leads from 0 by `step`; walked in strides of four. Place n leads to itself."""
    two = step[step]
    four = two[two]
    out, p, next_ = [], 0, memoryview(four)
    add = out.append
    while p < n:
        add(p)
        p = next_[p]
    a = np.array(out, np.int64)
    b = two[a]
    return np.stack([a, step[a], b, step[b]], 1).reshape(-1)


def _read_pixels(bits: Bits, width: int, height: int, cache_bits: int, groups: list[list[Code]], choose, shift: int) -> np.ndarray:
    """Pixel by pixel; `choose` has the group of each tile, or is None."""
    total = width * height
    out: list[int] = []
    cache = [0] * (1 << cache_bits) if cache_bits else None
    cached = i = 0
    data, size, p = bits.data, bits.size, bits.at
    tables = [[((1 << c.width) - 1, memoryview(c.symbol), memoryview(c.length)) for c in group] for group in groups]
    table = tables[0]
    while i < total:
        if choose is not None:
            table = tables[int(choose[(i // width) >> shift, (i % width) >> shift])]
        word = int.from_bytes(data[p >> 3 : (p >> 3) + 10], "little") >> (p & 7)  # a token has 60 bits at most
        mask, symbol, length = table[0]
        s, used = symbol[word & mask], length[word & mask]
        if s < 256:
            v = s << 8
            for at, (mask, symbol, length) in zip((16, 0, 24), table[1:4]):
                if mask:
                    look = word >> used & mask
                    v |= symbol[look] << at
                    used += length[look]
                else:
                    v |= symbol[0] << at
            out.append(v)
            p, i = p + used, i + 1
        elif s < 280:
            bits.at = p + used
            many = _extended(s - 256, bits)
            far = _distance(_extended(groups[tables.index(table)][4].read(bits), bits), width)
            p = bits.at
            if far > i or i + many > total:
                raise ValueError("copy outside the image")
            out += out[i - far : i - far + many] if far >= many else (out[i - far :] * (many // far + 1))[:many]
            i += many
        else:
            if cache is None or s - 280 >= len(cache):
                raise ValueError("no such colour cache slot")
            for v in out[cached:]:
                cache[(v * HASH_MULTIPLIER & 0xFFFFFFFF) >> 32 - cache_bits] = v
            cached = i
            out.append(cache[s - 280])
            p, i = p + used, i + 1
        if p > size:
            raise ValueError("truncated VP8L stream")
    bits.at = p
    return np.array(out, np.uint32)


def _read_greens(bits: Bits, total: int, green: Code, rest: int) -> np.ndarray:
    """Pixels that differ in green alone, a run of them at a time; `rest` holds the other channels."""
    data = np.frombuffer(bits.data, np.uint8)[bits.at >> 3 :]
    data = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.uint32)
    three = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    window = np.empty((len(three), 8), np.uint16)
    for k in range(8):
        window[:, k] = three >> np.uint32(k)
    window = window.reshape(-1)[bits.at & 7 :]
    n = len(window)
    used, count, symbols = green.runs()
    step, starts, p = used[window].tobytes(), [], 0
    add = starts.append
    while p < n:
        add(p)
        p += step[p]
    starts = np.array(starts, np.int64)
    run = window[starts]
    ends = np.cumsum(count[run], dtype=np.int64)
    last = int(np.searchsorted(ends, total))
    if last >= len(ends):
        raise ValueError("truncated VP8L stream")
    run = run[: last + 1]
    out = symbols[run][np.arange(symbols.shape[1]) < count[run][:, None]]
    left = total - int(ends[last - 1] if last else 0)
    if starts[last] + green.sizes()[out[total - left : total]].sum() > n:  # the stream's end cuts it
        raise ValueError("truncated VP8L stream")
    return out[:total].astype(np.uint32) << np.uint32(8) | np.uint32(rest)


def _read_at_once(bits: Bits, width: int, height: int, codes: list[Code]) -> np.ndarray:
    """One group, no colour cache: all offsets at once, then the chain of starts."""
    total = width * height
    if not any(c.width for c in codes[:4]) and codes[0].symbol[0] < 256:
        g, r, b, a = (int(c.symbol[0]) for c in codes[:4])
        return np.full(total, a << 24 | r << 16 | g << 8 | b, np.uint32)
    if not any(c.width for c in codes[1:4]) and codes[0].symbol.max() < 256 and (codes[0].again or total >= 1 << RUN):
        r, b, a = (int(c.symbol[0]) for c in codes[1:4])
        return _read_greens(bits, total, codes[0], a << 24 | r << 16 | b)
    data = np.frombuffer(bits.data, np.uint8)
    window = windows(data, bits.at, bits.size)
    n = len(window)
    if not n:
        raise ValueError("truncated VP8L stream")
    length = token_lengths(codes, window)
    step = np.append(np.minimum(np.arange(n) + length, n + 1), n)
    beyond = step > n  # tokens that the stream's end cuts
    step[beyond] = n
    starts = _chain(step, n)
    starts = starts[starts < n]
    symbol = codes[0].symbol[_look(codes[0], window[starts])]
    copy = np.flatnonzero(symbol >= 256)
    many = np.ones(len(starts), np.int64)
    far = np.zeros(0, np.int64)
    if len(copy):
        at = starts[copy]
        used = codes[0].length[_look(codes[0], window[at])]
        many[copy], used = _extended_at(symbol[copy] - 256, window[at], used)
        at = np.minimum(at + used, n - 1)
        look = _look(codes[4], window[at])
        far, _ = _extended_at(codes[4].symbol[look], window[at], codes[4].length[look])
        near = far <= 120
        offsets = np.array([max(1, dx + dy * width) for dx, dy in plane_offsets()])
        far = np.where(near, offsets[np.minimum(far, 120) - 1], far - 120)
    ends = np.cumsum(many)
    last = int(np.searchsorted(ends, total))
    if last >= len(ends) or beyond[starts[last]]:
        raise ValueError("truncated VP8L stream")
    copy, far = copy[copy <= last], far[: int(np.searchsorted(copy, last, side="right"))]
    if ends[last] != total:
        raise ValueError("copy outside the image")
    place = ends - many
    plain = np.flatnonzero(symbol[: last + 1] < 256)
    if len(plain) == total:
        return _literals(codes, window, starts[:total], length)
    out = np.zeros(total, np.uint32)
    out[place[plain]] = _literals(codes, window, starts[plain], length)
    if (far > place[copy]).any():
        raise ValueError("copy outside the image")
    for i, k, d in zip(place[copy].tolist(), many[copy].tolist(), far.tolist()):
        if d >= k:
            out[i : i + k] = out[i - d : i - d + k]
        else:
            out[i : i + k] = np.resize(out[i - d : i], k)
    return out


def _extended_at(symbol: np.ndarray, window: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths or distances, bits used with their extra bits) of prefix symbols whose extra bits follow `used` bits of windows."""
    base, extra = _joined(symbol)
    value = (window >> used.astype(np.uint64)).astype(np.int64) & (1 << extra) - 1
    return base + value, used + extra


def _literals(codes: list[Code], window: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    n, at, parts = len(window), starts, []
    for code in codes[:4]:
        look = _look(code, window[np.minimum(at, n - 1)])
        parts.append(code.symbol[look])
        at = at + code.length[look]
    g, r, b, a = (x.astype(np.uint32) for x in parts)
    return a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image, the main one with its prefix-code groups."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    choose, shift, count = None, 0, 1
    if main and bits.read(1):
        shift = bits.read(3) + 2
        tiles = read_image(bits, (width + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift, False)
        choose = (tiles >> np.uint32(8) & np.uint32(0xFFFF)).reshape(-1, (width + (1 << shift) - 1) >> shift)
        count = int(choose.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[read_code(bits, n) for n in sizes] for _ in range(count)]
    if choose is None and not cache_bits:
        # sub-images are followed by more of the stream, so their length must be known
        if main:
            return _read_at_once(bits, width, height, groups[0])
    return _read_pixels(bits, width, height, cache_bits, groups, choose, shift)


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(argb, np.uint32).view(np.uint8).reshape(*argb.shape, 4).astype(np.int64)  # b, g, r, a


def _join(c: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(c.astype(np.uint8)).view(np.uint32)[..., 0]


def predict(mode: int, left, top, top_left, top_right):
    """The format's predictors, on channel arrays (the channels last)."""
    half = lambda x, y: (x + y) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        to_left, to_top = abs(top - top_left).sum(-1), abs(left - top_left).sum(-1)
        return np.where((to_left < to_top)[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = half(left, top)
        step = mean - top_left
        return np.clip(mean + np.trunc(step / 2).astype(np.int64), 0, 255)
    return np.broadcast_to(np.array([0, 0, 0, 255]), left.shape)


def _half(x: int, y: int) -> int:
    """The mean of each channel, rounded down."""
    return (x & y) + ((x ^ y) >> 1 & 0x7F7F7F7F)


def predicted(mode: int, left: int, top: int, top_left: int, top_right: int) -> int:
    """What `predict` gives, of single pixels as ARGB integers."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _half(_half(left, top_right), top)
    if mode == 6:
        return _half(left, top_left)
    if mode == 7:
        return _half(left, top)
    if mode == 8:
        return _half(top_left, top)
    if mode == 9:
        return _half(top, top_right)
    if mode == 10:
        return _half(_half(left, top_left), _half(top, top_right))
    if mode not in (11, 12, 13):
        return 0xFF000000
    if mode == 13:
        left, top = _half(left, top), 0
    to_left = to_top = out = 0
    for at in (0, 8, 16, 24):
        x, y, z = left >> at & 255, top >> at & 255, top_left >> at & 255
        if mode == 11:
            to_left, to_top = to_left + abs(y - z), to_top + abs(x - z)
        else:
            v = x + y - z if mode == 12 else x + (x - z + (x < z) >> 1)
            out |= (0 if v < 0 else 255 if v > 255 else v) << at
    if mode == 11:
        return left if to_left < to_top else top
    return out


def guesses(pixels: np.ndarray, mode: int) -> np.ndarray:
    """What a mode predicts for each pixel from its neighbours, all known."""
    height, width, _ = pixels.shape
    wide = np.zeros((height + 1, width + 2, 4), np.int64)
    wide[1:, 1:-1] = pixels
    wide[1:, -1] = np.concatenate([pixels[1:, 0], pixels[-1:, 0]])  # right of the last pixel of a row is the first of the next
    out = predict(mode, wide[1:, :-2], wide[:-1, 1:-1], wide[:-1, :-2], wide[:-1, 2:]).copy()
    out[:, 0] = wide[:-1, 1]
    out[0] = wide[1, :-2]
    out[0, 0] = (0, 0, 0, 255)
    return out


def predictor_pass(pixels: np.ndarray, modes: np.ndarray, shift: int, undo: bool) -> np.ndarray:
    """Adds (undo) or subtracts the predictions; channel arrays of shape (h, w, 4)."""
    height, width, _ = pixels.shape
    if not undo:
        which = np.repeat(np.repeat(modes, 1 << shift, 0), 1 << shift, 1)[:height, :width]
        out = pixels.copy()
        for mode in np.unique(which):
            at = which == mode
            out[at] = (pixels - guesses(pixels, int(mode)))[at] & 255
        return out
    residual, which, seen = _join(pixels & 255).reshape(-1).tolist(), modes.tolist(), []
    for y in range(height):
        row = which[y >> shift]
        for x in range(width):
            i = y * width + x
            if x == 0 or y == 0:
                guess = seen[i - width] if y else seen[i - 1] if x else 0xFF000000
            else:  # right of the last pixel of a row is the first of the next
                guess = predicted(row[x >> shift], seen[i - 1], seen[i - width], seen[i - width - 1], seen[i - width + 1])
            v = residual[i]
            seen.append((v & 0xFF00FF00) + (guess & 0xFF00FF00) & 0xFF00FF00 | (v & 0xFF00FF) + (guess & 0xFF00FF) & 0xFF00FF)
    return _channels(np.array(seen, np.uint32).reshape(height, width))


def cross_colour_pass(pixels: np.ndarray, tiles: np.ndarray, shift: int, undo: bool) -> np.ndarray:
    """Adds (undo) or subtracts what green and red tell of red and blue."""
    height, width, _ = pixels.shape
    t = _channels(np.repeat(np.repeat(tiles, 1 << shift, 0), 1 << shift, 1)[:height, :width])
    signed = lambda v: (v & 255 ^ 128) - 128
    delta = lambda m, c: signed(m) * signed(c) >> 5
    to_red, green_blue, red_blue = t[..., 0], t[..., 1], t[..., 2]
    out, sign = pixels.copy(), 1 if undo else -1
    green, red = pixels[..., 1], pixels[..., 2]
    out[..., 2] = red + sign * delta(to_red, green) & 255
    plain_red = out[..., 2] if undo else red
    out[..., 0] = pixels[..., 0] + sign * (delta(green_blue, green) + delta(red_blue, plain_red)) & 255
    return out


def decode(media: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file, as a (height, width) array of ARGB integers."""
    if media[:4] != b"RIFF" or media[8:12] != b"WEBP" or media[12:16] != b"VP8L":
        raise ValueError("not a lossless WebP file")
    size = int.from_bytes(media[16:20], "little")
    bits = Bits(media[20 : 20 + size])
    if bits.read(8) != SIGNATURE:
        raise ValueError("not a VP8L stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown VP8L version")
    transforms, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (t[0] for t in transforms):
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            across = (inner + (1 << shift) - 1) >> shift
            tiles = read_image(bits, across, (height + (1 << shift) - 1) >> shift, False)
            transforms.append((kind, shift, tiles.reshape(-1, across), inner))
        elif kind == PALETTE:
            count = bits.read(8) + 1
            colours = _join(np.cumsum(_channels(read_image(bits, count, 1, False)), 0) & 255)
            shift = 3 if count <= 2 else 2 if count <= 4 else 1 if count <= 16 else 0
            transforms.append((kind, shift, colours, inner))
            inner = (inner + (1 << shift) - 1) >> shift
        else:
            transforms.append((kind, 0, None, inner))
    argb = read_image(bits, inner, height, True).reshape(height, inner)
    for kind, shift, extra, across in reversed(transforms):
        if kind == SUBTRACT_GREEN:
            c = _channels(argb)
            c[..., 0] = c[..., 0] + c[..., 1] & 255
            c[..., 2] = c[..., 2] + c[..., 1] & 255
            argb = _join(c)
        elif kind == PREDICTOR:
            argb = _join(predictor_pass(_channels(argb), extra >> np.uint32(8) & np.uint32(15), shift, True))
        elif kind == CROSS_COLOUR:
            argb = _join(cross_colour_pass(_channels(argb), extra, shift, True))
        else:
            index = (argb >> np.uint32(8) & np.uint32(255)).astype(np.int64)
            if shift:
                each = 8 >> shift
                index = (index[..., None] >> each * np.arange(1 << shift) & (1 << each) - 1).reshape(height, -1)[:, :across]
            argb = np.where(index < len(extra), extra[np.minimum(index, len(extra) - 1)], np.uint32(0))
    return argb
