"""Many grey images at a time, as lossless WebP.

*Writing.* A grey pixel (255, v, v, v) becomes (255, 0, v, 0) by a cross-colour transform whose factors take
green from red and from blue; what is left in green are literals and back-references to the last place with
the same four samples, in canonical prefix codes made for each image. Images of few grey values are smaller
with a palette and bundled pixels (:func:`larkspur.llm.webp.encode_grey`).

*Reading.* Symbols of one image depend on each other, those of different images don't: images that carry
one coded channel are read in step, one symbol of each a round, with numpy. The others, and the last few that are
left, go through the symbol reader.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np

from larkspur.llm import webp

#: Longest code the writer makes, and the reader takes into its tables.
LONGEST = 10
#: Fewer images than this are quicker one after the other.
FEW = 40
#: Images written and read at a time, which bounds memory for a long text.
WRITTEN, READ = 128, 4096
#: Shortest and longest back-reference.
SHORTEST, FARTHEST = 4, 4096
_GREEN, _BACK = 256 + 24, 40


# Writing


@lru_cache(maxsize=16)
def _turned(bits: int) -> np.ndarray:
    """Every number of so many bits with its bits in reverse order."""
    n = np.arange(1 << bits)
    out = np.zeros_like(n)
    for k in range(bits):
        out |= ((n >> k) & 1) << (bits - 1 - k)
    return out


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of an optimal prefix code, by symbol; rare symbols count for more until none is too long."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weights = counts[used].tolist()
    while True:
        n = len(weights)
        heap = [(w, k) for k, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = [0] * (2 * n - 1)
        for node in range(n, 2 * n - 1):
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = node
            heapq.heapreplace(heap, (a + b, node))
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= longest:
            out[used] = depth[:n]
            return out
        weights = [(w + 1) // 2 for w in weights]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by symbol, first bit lowest. A lone symbol has none."""
    out = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) > 1:
        order = used[np.lexsort((used, lengths[used]))]
        share = 1 << (15 - lengths[order])
        out[order] = _turned(15)[np.cumsum(share) - share]
    return out


def _put_code(out: webp.BitWriter, lengths: np.ndarray) -> None:
    """A prefix code, with runs of unused symbols put together."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 1:
        return out.lone_code(used[0] if used else 0)
    steps, at = [], 0
    for s in [*used, len(lengths)]:
        while at < s:
            gap = min(s - at, 138)
            steps.append((18, gap - 11, 7) if gap > 10 else (17, gap - 3, 3) if gap > 2 else (0, 0, 0))
            at += gap if gap > 2 else 1
        if s < len(lengths):
            steps.append((int(lengths[s]), 0, 0))
            at += 1
    of = code_lengths(np.bincount([k for k, _, _ in steps], minlength=19), 7)
    bits = canonical(of).tolist()
    sizes = of.tolist()
    stored = [sizes[k] for k in webp.LENGTH_ORDER]
    count = max(4, 1 + max(k for k, n in enumerate(stored) if n))
    out.put(0, 1)
    out.put(count - 4, 4)
    for n in stored[:count]:
        out.put(n, 3)
    out.put(0, 1)
    if sum(n > 0 for n in sizes) == 1:
        sizes = [0] * len(sizes)
    value, at = 0, 0
    for k, extra, n in steps:
        value |= (bits[k] | extra << sizes[k]) << at
        at += sizes[k] + n
    out.put(value, at)


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, number of further bits and their value, of lengths and distance codes from 1 on."""
    d = value - 1
    high = np.frexp(np.maximum(d, 1).astype(np.float64))[1] - 1
    more = np.where(d < 4, 0, high - 1)
    symbol = np.where(d < 4, d, 2 * high + ((d >> np.maximum(high - 1, 0)) & 1))
    return symbol, more, d & ((1 << more) - 1)


@lru_cache(maxsize=8)
def _near_codes(width: int) -> np.ndarray:
    """Distance codes by distance, as far as neighbours have some."""
    out = np.arange(8 * width + 9) + 120
    for code, (x, y) in reversed(list(enumerate(webp.NEIGHBOURS, 1))):
        if x + y * width > 0:
            out[x + y * width] = code
    return out


def _references(flat: np.ndarray, of: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By sample, the distance to the last place of the same four samples in its image, 0 for none, and
    how many samples are equal from there on."""
    n = len(flat)
    back = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(np.arange(n) + SHORTEST <= ends[of])
    four = np.zeros(len(at), np.uint64)
    for k in range(SHORTEST):
        four |= flat[at + k].astype(np.uint64) << np.uint64(8 * k)
    key = (of[at].astype(np.uint64) << np.uint64(32)) | four
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    back[at[order[same + 1]]] = at[order[same + 1]] - at[order[same]]
    last = np.append(np.flatnonzero(back[1:] != back[:-1]), n)  # of runs at one distance
    run = np.repeat(last, np.diff(last, prepend=-1))[:n]
    return back[:n], np.where(back[:n] > 0, np.minimum(run - np.arange(n) + SHORTEST, FARTHEST), 0)


def _header(width: int, height: int, green: np.ndarray, back: np.ndarray) -> tuple[int, int]:
    """All bits before the pixels, as a number, and how many."""
    out = webp.BitWriter()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 1 + 3)
    # cross-colour: blocks of 512 x 512, each with 32/32 of green in red and in blue
    out.put(1, 1)
    out.put(webp.CROSS_COLOUR, 2)
    out.put(7, 3)
    out.put(0, 1)
    for symbol in (32, 0, 32, 255, 0):
        out.lone_code(symbol)
    # no more transforms, no colour cache, no meta codes
    out.put(0, 3)
    _put_code(out, green)
    out.lone_code(0), out.lone_code(0), out.lone_code(255)
    _put_code(out, back)
    return out.value, out.n


def encode_many(images: list[np.ndarray]) -> list[bytes]:
    """A lossless WebP file for each grey image, all of one width."""
    return [f for k in range(0, len(images), WRITTEN) for f in _encode(images[k : k + WRITTEN])]


def _encode(images: list[np.ndarray]) -> list[bytes]:
    out: list = [None] * len(images)
    rich = []
    for k, image in enumerate(images):
        if np.count_nonzero(np.bincount(image.ravel(), minlength=256)) <= 16:
            out[k] = webp.encode_grey(image)
        else:
            rich.append(k)
    if not rich:
        return out
    width = images[rich[0]].shape[1]
    flat = np.concatenate([images[k].ravel() for k in rich])
    ends = np.cumsum([images[k].size for k in rich])
    of = np.repeat(np.arange(len(rich)), [images[k].size for k in rich])
    back, length = _references(flat, of, ends)
    onward = (np.arange(len(flat)) + np.maximum(length, 1)).tolist()
    places, at, n = [], 0, len(flat)
    while at < n:
        places.append(at)
        at = onward[at]
    v = np.array(places)
    image, far, long = of[v], back[v], length[v]
    ref = np.flatnonzero(long)
    symbol = flat[v].astype(np.int64)
    near = _near_codes(width)
    away = np.where(far[ref] < len(near), near[np.minimum(far[ref], len(near) - 1)], far[ref] + 120)
    long_symbol, long_bits, long_more = _prefix(long[ref])
    far_symbol, far_bits, far_more = _prefix(away)
    symbol[ref] = 256 + long_symbol
    greens = np.bincount(image * _GREEN + symbol, minlength=len(rich) * _GREEN).reshape(-1, _GREEN)
    backs = np.bincount(image[ref] * _BACK + far_symbol, minlength=len(rich) * _BACK).reshape(-1, _BACK)
    green_size = np.stack([code_lengths(c, LONGEST) for c in greens])
    back_size = np.stack([code_lengths(c, LONGEST) for c in backs])
    green_code = np.stack([canonical(c) for c in green_size])
    back_code = np.stack([canonical(c) for c in back_size])
    back_bits = np.where((back_size > 0).sum(1, keepdims=True) > 1, back_size, 0)  # a lone symbol takes no bits
    value = green_code[image, symbol]
    size = green_size[image, symbol]
    total = size.copy()
    for bits, more in ((long_bits, long_more), (back_bits[image[ref], far_symbol], back_code[image[ref], far_symbol]), (far_bits, far_more)):
        value[ref] |= more << total[ref]
        total[ref] += bits
    heads = [_header(width, images[k].shape[0], green_size[j], back_size[j]) for j, k in enumerate(rich)]
    first = np.searchsorted(image, np.arange(len(rich)))
    bits = np.array([n for _, n in heads]) + np.add.reduceat(total, first)
    base = np.cumsum((bits + 63) >> 6) - ((bits + 63) >> 6)  # each image begins a word
    lead = base * 64 + np.array([n for _, n in heads]) - (np.cumsum(total) - total)[first]
    stream = _words(value.view(np.uint64), total, lead[image] + np.cumsum(total) - total, int(((bits + 63) >> 6).sum()))
    for j, k in enumerate(rich):
        head = np.frombuffer(heads[j][0].to_bytes((heads[j][1] + 7) // 8, "little"), np.uint8)
        whole = stream[8 * base[j] : 8 * base[j] + (bits[j] + 7) // 8]
        whole[: len(head)] |= head
        out[k] = webp._riff(whole.tobytes())
    return out


def _words(value: np.ndarray, size: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """Bytes of so many 64-bit words in which each value stands at its bit, in rising order and apart."""
    out = np.zeros(count, "<u8")
    word, skip = at >> 6, (at & 63).astype(np.uint64)
    new = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[new]] = np.bitwise_or.reduceat(value << skip, new)
    over = np.flatnonzero((at & 63) + size > 64)
    out[word[over] + 1] |= value[over] >> (np.uint64(64) - skip[over])
    return out.view(np.uint8)


# Reading


def _in_step(entropy: webp.Entropy) -> bool:
    """Whether only green (and distances) take bits, in codes that fit the tables."""
    if entropy.cache_bits or len(entropy.groups) != 1:
        return False
    green, red, blue, alpha, back = entropy.groups[0]
    if green.width and green.symbols.max() < 256:
        return False  # unpacked at once
    return green.lone is None and green.longest <= LONGEST and all(c.lone is not None for c in (red, blue, alpha)) and (back.lone is not None or back.longest <= LONGEST)


def _tables(codes: list[webp.Code]) -> tuple[np.ndarray, int]:
    """By image, ``symbol << 4 | length`` for the next bits; and the mask of so many bits."""
    bits = max((c.longest for c in codes if c.lone is None), default=0)
    out = np.zeros((len(codes), 1 << bits), np.uint16)
    turned = _turned(bits)
    for k, c in enumerate(codes):
        if c.lone is not None:
            out[k] = c.lone << 4
        else:
            sizes, symbols = np.array(c.used).T
            out[k] = np.repeat((symbols << 4) | sizes, 1 << (bits - sizes))[turned]
    return out.ravel(), (1 << bits) - 1


_MORE = np.maximum(0, (np.arange(_BACK) - 2) >> 1)
_LEAST = np.where(np.arange(_BACK) < 4, np.arange(_BACK) + 1, ((2 + (np.arange(_BACK) & 1)) << _MORE) + 1)


def _finish(bits: webp.Bits, codes: list[webp.Code], width: int, out: np.ndarray, begin: int, at: int, end: int) -> None:
    """The rest of one image's green samples, symbol by symbol."""
    have = out[begin:end].tolist()
    at, n = at - begin, end - begin
    while at < n:
        s = codes[0].read(bits)
        if s < 256:
            have[at] = s
            at += 1
            continue
        length = webp._extra(bits, s - 256)
        back = webp._extra(bits, codes[4].read(bits))
        if back > 120:
            back -= 120
        else:
            x, y = webp.NEIGHBOURS[back - 1]
            back = max(1, x + y * width)
        if back > at or at + length > n:
            raise webp.BadImage("a back-reference outside the image")
        once = have[at - back : at]
        have[at : at + length] = (once * (length // back + 1))[:length]
        at += length
    out[begin:end] = have


def read_in_step(jobs: list[tuple[webp.Bits, list[webp.Code], int, int]]) -> list[np.ndarray]:
    """Green samples of images ``(stream, codes, width, pixels)``, one symbol of each at a time."""
    green, green_mask = _tables([codes[0] for _, codes, _, _ in jobs])
    far, far_mask = _tables([codes[4] for _, codes, _, _ in jobs])
    across = np.array([width for _, _, width, _ in jobs])
    near_x, near_y = np.array(webp.NEIGHBOURS).T
    data = np.frombuffer(b"".join([bits.data + bytes(8) for bits, *_ in jobs]), np.uint8)
    starts = np.cumsum([0] + [len(bits.data) + 8 for bits, *_ in jobs])[:-1]
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    ends = np.cumsum([n for *_, n in jobs])
    begins = ends - np.array([n for *_, n in jobs])
    out = np.zeros(int(ends[-1]), np.uint8)
    k = np.arange(len(jobs))
    bit = starts * 8 + np.array([bits.at for bits, *_ in jobs])
    limit = starts * 8 + np.array([bits.end for bits, *_ in jobs])
    at, end = begins.copy(), ends.copy()
    row, far_row = k * (green_mask + 1), k * (far_mask + 1)
    while len(k) > FEW:
        word = (words[np.minimum(bit >> 3, len(words) - 1)] >> (bit & 7).astype(np.uint64)).view(np.int64)
        entry = green[row + (word & green_mask)].astype(np.int64)
        size, symbol = entry & 15, entry >> 4
        out[at] = symbol & 255
        step = np.ones(len(k), np.int64)
        ref = np.flatnonzero(symbol > 255)
        if len(ref):
            rest, code, taken = word[ref] >> size[ref], symbol[ref] - 256, size[ref]
            length = _LEAST[code] + (rest & ((1 << _MORE[code]) - 1))
            rest, taken = rest >> _MORE[code], taken + _MORE[code]
            entry = far[far_row[ref] + (rest & far_mask)].astype(np.int64)
            rest, taken, code = rest >> (entry & 15), taken + (entry & 15), entry >> 4
            back = _LEAST[code] + (rest & ((1 << _MORE[code]) - 1))
            size[ref] = taken + _MORE[code]
            here = np.minimum(back, 120) - 1
            back = np.where(back > 120, back - 120, np.maximum(1, near_x[here] + near_y[here] * across[k[ref]]))
            if (back > at[ref] - begins[k[ref]]).any() or (length > end[ref] - at[ref]).any():
                raise webp.BadImage("a back-reference outside the image")
            step[ref] = length
            inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            to, back = np.repeat(at[ref], length), np.repeat(back, length)
            out[to + inner] = out[to - back + inner % back]
        bit += size
        at += step
        more = at < end
        if not more.all():
            if (bit > limit).any():
                raise webp.BadImage("the stream ends early")
            k, bit, limit, at, end, row, far_row = (a[more] for a in (k, bit, limit, at, end, row, far_row))
    for j, b, a in zip(k.tolist(), bit.tolist(), at.tolist()):
        bits, codes, width, _ = jobs[j]
        bits.at = b - int(starts[j]) * 8
        _finish(bits, codes, width, out, int(begins[j]), a, int(ends[j]))
    return [out[a:z] for a, z in zip(begins.tolist(), ends.tolist())]


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """:func:`larkspur.llm.webp.decode` of each file."""
    return [argb for k in range(0, len(files), READ) for argb in _decode(files[k : k + READ])]


def _decode(files: list[bytes]) -> list[np.ndarray]:
    left, jobs, of = [], [], []
    for k, data in enumerate(files):
        bits, width, height = webp.opened(data)
        steps, inner = webp.read_transforms(bits, width, height)
        entropy = webp.read_codes(bits, inner, height, True)
        argb = None
        if _in_step(entropy):
            of.append(k)
            jobs.append((bits, entropy.groups[0], inner, inner * height))
        else:
            argb = webp.read_symbols(bits, entropy, inner, height)
        left.append([argb, steps, width, height, inner, entropy])
    for k, green in zip(of, read_in_step(jobs) if jobs else []):
        _, red, blue, alpha, _ = left[k][5].groups[0]
        rest = np.uint32(alpha.lone << 24 | red.lone << 16 | blue.lone)
        left[k][0] = (green.astype(np.uint32) << np.uint32(8)) | rest
    return [webp.undo(argb.reshape(height, inner), steps)[:, :width] for argb, steps, width, height, inner, _ in left]
