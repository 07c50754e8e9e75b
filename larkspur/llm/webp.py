"""Lossless WebP (VP8L) reading and writing with numpy.

The reader covers the format: prefix codes (simple, and coded by code lengths), meta prefix
codes, back-references with the two-dimensional distance map, the colour cache, and the inverse
predictor, cross-colour, subtract-green and palette (with pixel bundling) transforms. Streams of literals
with codes of one fixed length, as :func:`encode_grey` writes them, are unpacked in one numpy step;
all others symbol by symbol, or many images in step (:mod:`larkspur.llm.webp_many`).
"""

from __future__ import annotations

import struct
from functools import lru_cache
from typing import NamedTuple

import numpy as np

SIDE = 16384  # the format's largest width and height

# Fixed values of the format, in its order.
# Order in which the lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Offsets (x, y) of the first 120 distance codes: neighbours by distance.
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1),
    (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4),
    (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6),
    (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5),
    (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


class BadImage(ValueError):
    """Not a lossless WebP image, or a damaged one."""


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise BadImage("the stream ends early")
        out = self.peek(n) if n else 0
        self.at += n
        return out


class Code:
    """A canonical prefix code. ``width`` is the length that all its symbols share, or None."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.lone = used[0][1] if len(used) == 1 else None
        self.width, self.symbols, self.table = None, None, None
        if not used:
            raise BadImage("a prefix code without symbols")
        if self.lone is not None:
            self.width = 0
            return
        used.sort()
        if sum(1 << (15 - n) for n, _ in used) != 1 << 15:
            raise BadImage("a prefix code that isn't complete")
        self.longest = used[-1][0]
        if used[0][0] == self.longest:
            self.width, self.symbols = self.longest, np.array([s for _, s in used])
        self.used = used

    def _fill(self) -> None:
        # by the next `longest` bits: symbol and length
        size = 1 << self.longest
        table: list = [None] * size
        code, before = 0, self.used[0][0]
        for n, s in self.used:
            code <<= n - before
            before = n
            turned = int(format(code, f"0{n}b")[::-1], 2)
            table[turned :: 1 << n] = [(s, n)] * (size >> n)
            code += 1
        self.table = table

    def read(self, bits: Bits) -> int:
        if self.lone is not None:
            return self.lone
        if self.table is None:
            self._fill()
        s, n = self.table[bits.peek(self.longest)]
        bits.at += n
        if bits.at > bits.end:
            raise BadImage("the stream ends early")
        return s


@lru_cache(maxsize=512)
def _code(lengths: bytes) -> Code:
    return Code(list(lengths))


def _read_code(bits: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        for s in (first, bits.read(8)) if two else (first,):
            if s >= alphabet:
                raise BadImage("a symbol outside its alphabet")
            lengths[s] = 1
        return _code(bytes(lengths))
    of_lengths = [0] * len(LENGTH_ORDER)
    for k in range(4 + bits.read(4)):
        of_lengths[LENGTH_ORDER[k]] = bits.read(3)
    coder = _code(bytes(of_lengths))
    left = alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        if left > alphabet:
            raise BadImage("too many code lengths")
    s, before = 0, 8
    # no length takes more than 7 + 7 bits
    begin = bits.at >> 3
    word = int.from_bytes(bits.data[begin : begin + 2 * alphabet + 8], "little") >> (bits.at & 7)
    if coder.lone is None and coder.table is None:
        coder._fill()
    table, mask, used = coder.table or [(coder.lone, 0)], (1 << coder.longest) - 1 if coder.lone is None else 0, 0
    while s < alphabet and left:
        left -= 1
        n, size = table[word >> used & mask]
        used += size
        if n < 16:
            lengths[s] = n
            s += 1
            before = n or before
            continue
        size, least = ((2, 3), (3, 3), (7, 11))[n - 16]
        repeat = least + (word >> used & ((1 << size) - 1))
        used += size
        if s + repeat > alphabet:
            raise BadImage("too many code lengths")
        lengths[s : s + repeat] = [before if n == 16 else 0] * repeat
        s += repeat
    bits.at += used
    if bits.at > bits.end:
        raise BadImage("the stream ends early")
    return _code(bytes(lengths))


def _extra(bits: Bits, symbol: int) -> int:
    """Value of a length or distance prefix symbol."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def _unpack_fixed(bits: Bits, codes: list[Code], n: int) -> np.ndarray | None:
    """All pixels at once, if each has the same number of bits."""
    green, red, blue, alpha, _ = codes
    four = [green, red, blue, alpha]
    if any(c.width is None for c in four) or (green.lone if green.lone is not None else int(green.symbols.max())) > 255:
        return None
    total = sum(c.width for c in four)
    if bits.at + n * total > bits.end:
        raise BadImage("the stream ends early")
    planes = []
    if total:
        byte, skip = bits.at >> 3, bits.at & 7
        flat = np.unpackbits(np.frombuffer(bits.data, np.uint8, (skip + n * total + 7) // 8, byte), bitorder="little")[skip : skip + n * total].reshape(n, total)
    at = 0
    for c in four:
        if c.lone is not None:
            planes.append(c.lone)
            continue
        if c.width <= 8:
            code = np.packbits(flat[:, at : at + c.width], axis=1).ravel() >> (8 - c.width)
        else:
            code = flat[:, at : at + c.width] @ (1 << np.arange(c.width - 1, -1, -1, dtype=np.uint16))
        planes.append(c.symbols.astype(np.uint32)[code])
        at += c.width
    bits.at += n * total
    g, r, b, a = (p if isinstance(p, np.ndarray) else np.uint32(p) for p in planes)
    out = np.empty(n, np.uint32)
    out[:] = (a << np.uint32(24)) | (r << np.uint32(16)) | (g << np.uint32(8)) | b
    return out


class Entropy(NamedTuple):
    """What stands before entropy-coded pixels: colour cache, meta codes and groups of five prefix codes."""

    cache_bits: int
    shift: int
    meta: list[int] | None
    groups: list[list[Code]]


def read_codes(bits: Bits, width: int, height: int, top: bool) -> Entropy:
    cache_bits = 0
    if bits.read(1):
        cache_bits = bits.read(4)
        if not 1 <= cache_bits <= 11:
            raise BadImage("a colour cache of no valid size")
    groups, meta, shift = 1, None, 0
    if top and bits.read(1):
        shift = bits.read(3) + 2
        meta_width = -(-width >> shift)
        found = _pixels(bits, meta_width, -(-height >> shift), False)
        meta = ((found >> np.uint32(8)) & np.uint32(0xFFFF)).astype(int).tolist()
        groups = max(meta) + 1
    cache_size = (1 << cache_bits) if cache_bits else 0
    return Entropy(cache_bits, shift, meta, [[_read_code(bits, size) for size in (256 + 24 + cache_size, 256, 256, 256, 40)] for _ in range(groups)])


def read_symbols(bits: Bits, entropy: Entropy, width: int, height: int) -> np.ndarray:
    """The pixels that follow, as ARGB, row by row."""
    cache_bits, shift, meta, all_codes = entropy
    n, meta_width = width * height, -(-width >> shift)
    if len(all_codes) == 1 and not cache_bits and (fast := _unpack_fixed(bits, all_codes[0], n)) is not None:
        return fast
    out = [0] * n
    cache = [0] * ((1 << cache_bits) if cache_bits else 0)
    codes, cached, at = all_codes[0], 0, 0
    while at < n:
        if meta is not None:
            codes = all_codes[meta[((at // width) >> shift) * meta_width + ((at % width) >> shift)]]
        s = codes[0].read(bits)
        if s < 256:
            r, b, a = codes[1].read(bits), codes[2].read(bits), codes[3].read(bits)
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 256 + 24:
            length = _extra(bits, s - 256)
            back = _extra(bits, codes[4].read(bits))
            if back > 120:
                back -= 120
            else:
                x, y = NEIGHBOURS[back - 1]
                back = max(1, x + y * width)
            if back > at or at + length > n:
                raise BadImage("a back-reference outside the image")
            if back >= length:
                out[at : at + length] = out[at - back : at - back + length]
            else:
                once = out[at - back : at]
                out[at : at + length] = (once * (length // back + 1))[:length]
            at += length
        else:
            if cached < at:  # late inserts: only what a lookup can see
                for p in out[cached:at]:
                    cache[((CACHE_FACTOR * p) & 0xFFFFFFFF) >> (32 - cache_bits)] = p
                cached = at
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, dtype=np.uint32)


def _pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    return read_symbols(bits, read_codes(bits, width, height, top), width, height)


def _split(argb: np.ndarray) -> np.ndarray:
    """Channels A, R, G, B as the last axis."""
    return argb.astype(">u4").view(np.uint8).reshape(*argb.shape, 4)


def _join(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels).view(">u4").reshape(channels.shape[:-1]).astype(np.uint32)


def _average(a, b):
    return (a + b) >> 1


def _select(left, top, corner):
    # whichever of left and top is nearer to left + top - corner, by the sum over the channels
    near_left = np.abs(top - corner).sum(-1, keepdims=True)
    near_top = np.abs(left - corner).sum(-1, keepdims=True)
    return np.where(near_left < near_top, left, top)


def _half(a, b):
    # clamped a + (a - b) / 2, the halving towards zero
    d = a - b
    return np.clip(a + (np.abs(d) >> 1) * np.sign(d), 0, 255)


#: Predictors 0 to 13 from left, top, top right and top left neighbours; integer channels.
_PREDICTORS = (
    lambda L, T, R, C: np.broadcast_to(np.array([255, 0, 0, 0]), T.shape),
    lambda L, T, R, C: L,
    lambda L, T, R, C: T,
    lambda L, T, R, C: R,
    lambda L, T, R, C: C,
    lambda L, T, R, C: _average(_average(L, R), T),
    lambda L, T, R, C: _average(L, C),
    lambda L, T, R, C: _average(L, T),
    lambda L, T, R, C: _average(C, T),
    lambda L, T, R, C: _average(T, R),
    lambda L, T, R, C: _average(_average(L, C), _average(T, R)),
    lambda L, T, R, C: _select(L, T, C),
    lambda L, T, R, C: np.clip(L + T - C, 0, 255),
    lambda L, T, R, C: _half(_average(L, T), C),
)
#: Those that don't read the left neighbour: a whole block row of them is one addition.
_NO_LEFT = {0, 2, 3, 4, 8, 9}


def predict(argb: np.ndarray, modes: np.ndarray, shift: int, inverse: bool = True) -> np.ndarray:
    """Undo (or, for writing, apply) the predictor transform. ``modes``: by block."""
    height, width = argb.shape
    got = _split(argb).astype(np.int32)
    if not inverse:
        out = got.copy()
        full = got
    else:
        full = np.zeros_like(got)
    for y in range(height):
        for x0 in range(0, width, 1 << shift):
            x1 = min(width, x0 + (1 << shift))
            spans = [(x0, x1, int(modes[y >> shift, x0 >> shift]) % 16)]
            if y == 0:
                spans = [(0, 1, 0)] * (x0 == 0) + [(max(1, x0), x1, 1)] * (x1 > max(1, x0))
            elif x0 == 0:
                spans = [(0, 1, 2), (1, x1, spans[0][2])]
            for a, b, mode in spans:
                if b <= a:
                    continue
                use = _PREDICTORS[mode if mode < 14 else 0]

                def around(i, j):
                    zero = np.zeros((j - i, 4), np.int32)
                    left = full[y, i - 1 : j - 1] if i else zero
                    if not y:
                        return left, zero, zero, zero
                    # right of the last column stands the first pixel of the row that is being made
                    above = np.concatenate([full[y - 1], full[y, :1]])
                    return left, above[i:j], above[i + 1 : j + 1], above[i - 1 : j - 1] if i else zero

                if not inverse:
                    out[y, a:b] = (got[y, a:b] - use(*around(a, b))) & 255
                elif mode in _NO_LEFT or mode > 13:
                    full[y, a:b] = (got[y, a:b] + use(*around(a, b))) & 255
                elif mode == 1:
                    start = full[y, a - 1]
                    full[y, a:b] = (np.cumsum(got[y, a:b], axis=0) + start) & 255
                else:
                    for x in range(a, b):
                        full[y, x] = (got[y, x] + use(*around(x, x + 1))[0]) & 255
    return _join((full if inverse else out).astype(np.uint8))


def cross_colour(argb: np.ndarray, factors: np.ndarray, shift: int, inverse: bool = True) -> np.ndarray:
    """Undo (or apply) the cross-colour transform; ``factors``: ARGB by block."""
    height, width = argb.shape
    if factors.size == 1 and inverse:
        return _one_factor(argb, int(factors[0, 0]))
    by_pixel = factors[np.arange(height)[:, None] >> shift, np.arange(width)[None, :] >> shift]
    f = _split(by_pixel).view(np.int8).astype(np.int32)
    red_to_blue, green_to_blue, green_to_red = f[..., 1], f[..., 2], f[..., 3]
    c = _split(argb).copy()
    delta = lambda k, v: (k * v.view(np.int8).astype(np.int32)) >> 5
    red, green, blue = (np.ascontiguousarray(c[..., k]) for k in (1, 2, 3))
    sign = 1 if inverse else -1
    new_red = ((red + sign * delta(green_to_red, green)) & 255).astype(np.uint8)
    new_blue = (blue + sign * delta(green_to_blue, green) + sign * delta(red_to_blue, new_red if inverse else red)) & 255
    c[..., 1], c[..., 3] = new_red, new_blue.astype(np.uint8)
    return _join(c)


def _one_factor(argb: np.ndarray, factor: int) -> np.ndarray:
    """The inverse where all pixels share their factors: what to add is looked up by colour."""
    signed = np.arange(256, dtype=np.uint8).view(np.int8).astype(np.int32)
    red_to_blue, green_to_blue, green_to_red = ((((((factor >> k) & 255) ^ 128) - 128) * signed >> 5).astype(np.uint8) for k in (16, 8, 0))
    c = np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)  # B, G, R, A
    out = c.copy()
    green = c[..., 1]
    out[..., 2] += green_to_red[green]
    out[..., 0] += green_to_blue[green]
    if red_to_blue.any():
        out[..., 0] += red_to_blue[out[..., 2]]
    return out.view("<u4")[..., 0]


def subtract_green(argb: np.ndarray, inverse: bool = True) -> np.ndarray:
    c = _split(argb).copy()
    green = c[..., 2]
    for k in (1, 3):
        c[..., k] = c[..., k] + green if inverse else c[..., k] - green
    return _join(c)


def _bundle_shift(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _unbundle(argb: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    shift = _bundle_shift(len(palette))
    index = ((argb >> np.uint32(8)) & np.uint32(255)).astype(np.uint8)
    if shift:
        per, depth = 1 << shift, 8 >> shift
        parts = (index[..., None] >> (np.arange(per, dtype=np.uint8) * depth)) & ((1 << depth) - 1)
        index = parts.reshape(len(index), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


def read_transforms(bits: Bits, width: int, height: int) -> tuple[list, int]:
    """Transforms in the order of the stream, and the width of the image that they leave."""
    steps, seen = [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise BadImage("a transform that comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            w, h = -(-width >> shift), -(-height >> shift)
            steps.append((kind, _pixels(bits, w, h, False).reshape(h, w), shift))
        elif kind == PALETTE:
            deltas = _pixels(bits, bits.read(8) + 1, 1, False)
            palette = _join(np.cumsum(_split(deltas), axis=0, dtype=np.uint8))
            steps.append((kind, palette, width))
            width = -(-width >> _bundle_shift(len(palette)))
        else:
            steps.append((kind, None, 0))
    return steps, width


def undo(argb: np.ndarray, steps: list) -> np.ndarray:
    """The picture itself, from what the transforms left."""
    for kind, data, number in reversed(steps):
        if kind == PREDICTOR:
            argb = predict(argb, (data >> np.uint32(8)) & np.uint32(15), number)
        elif kind == CROSS_COLOUR:
            argb = cross_colour(argb, data, number)
        elif kind == SUBTRACT_GREEN:
            argb = subtract_green(argb)
        else:
            argb = _unbundle(argb, data, number)
    return argb


def opened(data: bytes) -> tuple[Bits, int, int]:
    """The stream after its header, width and height of a simple lossless WebP file."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise BadImage("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    bits = Bits(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise BadImage("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise BadImage("an unknown version")
    return bits, width, height


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels, uint32, of a simple lossless WebP file."""
    bits, width, height = opened(data)
    steps, inner = read_transforms(bits, width, height)
    return undo(_pixels(bits, inner, height, True).reshape(height, inner), steps)[:, :width]


class BitWriter:
    """Bits, least significant first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def lone_code(self, symbol: int) -> None:
        """A prefix code with one symbol, which then takes no bits."""
        self.put(1, 1)
        self.put(0, 1)
        self.put(1, 1)
        self.put(symbol, 8)

    def fixed_code(self, width: int) -> None:
        """A prefix code in which symbols 0 to 2**width - 1 have ``width`` bits each (2 to 8)."""
        at = LENGTH_ORDER.index(width)
        self.put(0, 1)
        self.put(max(0, at - 3), 4)
        for k in range(max(4, at + 1)):
            self.put(1 if k == at else 0, 3)
        count = 1 << width
        self.put(1, 1)
        bits = 2 * max(0, (max(1, (count - 2).bit_length()) - 1) // 2)
        self.put(bits // 2, 3)
        self.put(count - 2, 2 + bits)


def _packed(values: np.ndarray, width: int, skip: int) -> bytes:
    """Canonical codes of one fixed length, as bits after ``skip`` empty ones."""
    rows = np.unpackbits(values.astype(np.uint8)[:, None], axis=1)[:, 8 - width :]
    return np.packbits(np.concatenate([np.zeros(skip, np.uint8), rows.ravel()]), bitorder="little").tobytes()


def _riff(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def encode_grey(samples: np.ndarray) -> bytes:
    """A grey image as lossless WebP: a palette of the grey values that occur, bundled pixels where the
    palette is small, and literal codes of one fixed length. Pixels are (255, v, v, v)."""
    height, width = samples.shape
    if not (1 <= width <= SIDE and 1 <= height <= SIDE):
        raise ValueError("an image has 1 to 16384 rows and columns")
    present = np.flatnonzero(np.bincount(samples.ravel(), minlength=256))
    rank = np.zeros(256, np.uint8)
    rank[present] = np.arange(len(present))
    index = rank[samples]
    shift = _bundle_shift(len(present))
    if shift:
        per, depth = 1 << shift, 8 >> shift
        index = np.pad(index, ((0, 0), (0, -width % per))).reshape(height, -1, per)
        index = np.bitwise_or.reduce(index << (np.arange(per, dtype=np.uint8) * depth), axis=2)
    out = BitWriter()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 1 + 3)
    # the palette transform and its colours, stored as differences
    out.put(1, 1)
    out.put(PALETTE, 2)
    out.put(len(present) - 1, 8)
    out.put(0, 1)
    steps = np.diff(present, prepend=0)
    for _ in range(3):
        out.fixed_code(8)
    out.put(1, 1), out.put(1, 1), out.put(1, 1), out.put(0, 8), out.put(255, 8)
    out.lone_code(0)
    for k, v in enumerate(steps.tolist()):
        turned = int(format(v, "08b")[::-1], 2)
        out.put(turned * 0x010101, 24)
        out.put(int(k == 0), 1)
    # no more transforms, no colour cache, no meta codes
    out.put(0, 3)
    bits = 8 if shift else max(2, int(len(present) - 1).bit_length())
    lone = not index.any()
    if lone:
        out.lone_code(0)
    else:
        out.fixed_code(bits)
    out.lone_code(0), out.lone_code(0), out.lone_code(255), out.lone_code(0)
    head = out.value.to_bytes((out.n + 7) // 8, "little")
    if lone:
        return _riff(head)
    whole, skip = out.n >> 3, out.n & 7
    body = _packed(index.ravel(), bits, skip)
    if skip:
        head = head[:whole] + bytes([head[whole] | body[0]])
        body = body[1:]
    return _riff(head + body)
