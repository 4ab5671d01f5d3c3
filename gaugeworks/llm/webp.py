"""Lossless WebP (VP8L) written and read with numpy.

The reader follows the public bitstream specification: prefix codes with meta
groups, back-references, colour cache, and the predictor, cross-colour,
subtract-green and palette transforms. ``read_images`` reads the symbols of many
images in step, one of each at a time, whatever features they use;
``read_stream`` reads one image by itself.

The writer estimates for each image which transform, if any, makes its literals
shortest, refers back to repeated runs of pixels, and uses a colour cache where
it is hit often enough; its Huffman codes are the image's own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

#: Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTHS, DISTANCES, CACHE_MULTIPLIER, MAX_SIDE = 256, 24, 40, 0x1E35A7BD, 1 << 14
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Near distances: pixels above and to the left by growing distance, then column.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
#: Longest code the writer makes.
MAX_CODE = 12


# --- writing -------------------------------------------------------------------------------


class BitWriter:
    """Bits, least significant first, collected in one integer."""

    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.size
        self.size += bits

    def add(self, other: BitWriter) -> None:
        self.put(other.value, other.size)

    def tobytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


def code_lengths(counts: dict[int, int], limit: int = MAX_CODE) -> dict[int, int]:
    """Huffman code lengths; counts are flattened until no code exceeds the limit."""
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    symbols = sorted(counts, key=lambda s: (counts[s], s))
    weight = [counts[s] for s in symbols]
    while True:
        # Leaves rise in weight and so do inner nodes, so two queues replace a heap.
        n = len(weight)
        parent, leaf, node = [0] * (2 * n - 1), 0, 0
        # Weights of leaves and inner nodes end with one that is never the lesser.
        never = sum(weight) + 1
        leaves, inner = [*weight, never], [never] * n
        for new in range(n - 1):
            if leaves[leaf] <= inner[node]:
                total, parent[leaf] = leaves[leaf], n + new
                leaf += 1
            else:
                total, parent[n + node] = inner[node], n + new
                node += 1
            if leaves[leaf] <= inner[node]:
                total, parent[leaf] = total + leaves[leaf], n + new
                leaf += 1
            else:
                total, parent[n + node] = total + inner[node], n + new
                node += 1
            inner[new] = total
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if depth[0] <= limit:
            return dict(zip(symbols, depth[:n], strict=True))
        weight = [1 + w // 4 for w in weight]


@lru_cache(maxsize=16)
def _mirror(bits: int) -> np.ndarray:
    """All numbers of ``bits`` bits with their bits in reverse."""
    out = np.zeros(1, np.int64)
    for k in range(bits):
        out = np.concatenate([out, out | 1 << (bits - 1 - k)])
    return out


def _ranked(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols in the order of their codes, their lengths, the share of the code space of each, and the longest length."""
    symbol, length = (np.fromiter(x, np.int64, len(lengths)) for x in (lengths.keys(), lengths.values()))
    order = np.lexsort((symbol, length))
    symbol, length = symbol[order], length[order]
    longest = int(length[-1])
    return symbol, length, 1 << (longest - length), longest


def code_words(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with their codes as the stream holds them, first bit lowest, and the codes' lengths."""
    symbol, length, share, longest = _ranked(lengths)
    return symbol, _mirror(longest)[np.cumsum(share) - share], length


def canonical(lengths: dict[int, int]) -> dict[int, int]:
    """Each symbol's code as the stream holds it, first bit lowest."""
    symbol, word, _ = code_words(lengths)
    return dict(zip(symbol.tolist(), word.tolist(), strict=True))


#: The writer's code for code lengths: 13 symbols of four bits and six of five, which is complete.
_LENGTH_BITS = {s: 4 if s < 13 else 5 for s in range(19)}
_LENGTH_WORDS = [(word, _LENGTH_BITS[s]) for s, word in sorted(canonical(_LENGTH_BITS).items())]


def put_code(out: BitWriter, lengths: dict[int, int]) -> None:
    """Write a prefix code: simple if it has one small symbol, else by its lengths."""
    if len(lengths) <= 1 and max(lengths, default=0) < 256:
        symbol = next(iter(lengths), 0)
        out.put(1, 1)
        out.put(0, 1)
        out.put(1, 1)
        out.put(symbol, 8)
        return
    out.put(0, 1)
    out.put(len(CODE_LENGTH_ORDER) - 4, 4)
    for s in CODE_LENGTH_ORDER:
        out.put(_LENGTH_BITS[s], 3)
    # Words of the code lengths, each with the extra bits of a run of zeros before it.
    tokens: list[tuple[int, int]] = []
    at = 0
    for symbol in sorted(lengths):
        gap = symbol - at
        while gap:
            if gap < 3:
                tokens.append(_LENGTH_WORDS[0])
                gap -= 1
            elif gap < 11:
                word, bits = _LENGTH_WORDS[17]
                tokens.append((word | (gap - 3) << bits, bits + 3))
                gap = 0
            else:
                run = min(gap, 138)
                word, bits = _LENGTH_WORDS[18]
                tokens.append((word | (run - 11) << bits, bits + 7))
                gap -= run
        tokens.append(_LENGTH_WORDS[lengths[symbol]])
        at = symbol + 1
    # The count of tokens that follow ends the code early.
    if len(tokens) < 2:
        tokens.append(_LENGTH_WORDS[0])
    out.put(1, 1)
    out.put(5, 3)
    out.put(len(tokens) - 2, 12)
    value, size = out.value, out.size
    for word, bits in tokens:
        value |= word << size
        size += bits
    out.value, out.size = value, size


def container(stream: bytes) -> bytes:
    """The RIFF container of a VP8L stream."""
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def start(width: int, height: int, alpha: bool = False) -> BitWriter:
    """The stream's first bits, up to where transforms begin."""
    out = BitWriter()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int(alpha), 1)
    out.put(0, 3)
    return out


#: Pixels of the shortest run that is referred back to, and of the longest that one symbol can copy.
LEAST_RUN, MOST_RUN = 4, 4096
#: The writer's blocks of predictors and colour factors: 512 pixels square, so one covers an image.
BLOCK = 9
#: A colour cache is used if it spares at least this share of the literals.
CACHE_SHARE = 0.125
MOST_CACHE_BITS = 8


def write_images(samples: list[np.ndarray], width: int) -> list[bytes]:
    """Lossless images of 8-bit RGB samples (flat arrays, whole rows, at most 512), a bounded number at a time."""
    out: list[bytes] = []
    at = 0
    while at < len(samples):
        end, total = at, 0
        while end < len(samples) and (end == at or total + len(samples[end]) <= 1 << 20):
            total += len(samples[end])
            end += 1
        out += _write_some(samples[at:end], width)
        at = end
    return out


#: Bits of a pixel's place in a sorted key; a batch of images has fewer pixels than that.
#: Bits of a run's hash beside it, which leaves thirteen for the number of the image.
PLACE, HASH = 20, 31


def _grouped(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the order of (key, place), whether each has the key of the one before, and the sorted keys."""
    both = np.sort(keys.astype(np.uint64) << np.uint64(PLACE) | places.astype(np.uint64))
    ordered, key = (both & np.uint64((1 << PLACE) - 1)).astype(np.int64), both >> np.uint64(PLACE)
    same = np.zeros(len(both), bool)
    same[1:] = key[1:] == key[:-1]
    return ordered, same, key


def _spread(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Bits that each of ``n`` images needs for its 8-bit values at their entropy."""
    counts = np.bincount(owner * 256 + values, minlength=256 * n).reshape(n, 256)
    total = np.maximum(counts.sum(1), 1)
    return total * np.log2(total) - (counts * np.log2(np.maximum(counts, 1))).sum(1)


def _residuals(rgb: np.ndarray, local: np.ndarray, width: int, mode: int) -> np.ndarray:
    """Differences from the pixel to the left (mode 1) or above (mode 2), as the format treats the edges."""
    row = (local < width) | ((local % width != 0) if mode == 1 else False)
    back = np.where(row, 1, width)
    out = rgb - rgb[np.arange(len(rgb)) - back]
    out[local == 0] = rgb[local == 0]
    return out


def _factor(owner: np.ndarray, green: np.ndarray, other: np.ndarray, n: int) -> np.ndarray:
    """The slope of a channel over green for each image, in the format's 32nds."""
    count = np.maximum(np.bincount(owner, minlength=n), 1)
    mean_g, mean_o = (np.bincount(owner, v, n) / count for v in (green, other))
    dg, do = green - mean_g[owner], other - mean_o[owner]
    slope = np.bincount(owner, dg * do, n) / np.maximum(np.bincount(owner, dg * dg, n), 1e-9)
    return np.clip(np.rint(32 * slope), -128, 127).astype(np.int64)


def _write_some(samples: list[np.ndarray], width: int) -> list[bytes]:
    n = len(samples)
    rgb = np.concatenate(samples).reshape(-1, 3)
    if len(rgb) > 1 << PLACE:
        raise ValueError("an image is too large for the writer")
    size = np.array([len(s) // 3 for s in samples])
    owner = np.repeat(np.arange(n), size)
    local = np.arange(len(rgb)) - np.repeat(np.cumsum(size) - size, size)
    red, green, blue = (rgb[:, k].astype(np.int64) for k in range(3))
    signed = rgb.view(np.int8)[:, 1].astype(np.int64)
    to_red, to_blue = _factor(owner, signed, red, n), _factor(owner, signed, blue, n)
    variants = [rgb, np.stack([red - green, green, blue - green], 1), *(_residuals(rgb, local, width, m) for m in (1, 2))]
    variants.append(np.stack([red - (to_red[owner] * signed >> 5), green, blue - (to_blue[owner] * signed >> 5)], 1))
    variants = [v.astype(np.uint8) for v in variants]
    # Bits of literals and of what a transform adds to the head.
    cost = [sum(_spread(owner, v[:, c], n) for c in range(3)) + extra for v, extra in zip(variants, (0, 3, 64, 64, 96), strict=True)]
    colour = red << 16 | green << 8 | blue
    place, again, key = _grouped(owner << 24 | colour, np.arange(len(rgb)))
    distinct, index = key[~again].astype(np.int64), np.empty(len(rgb), np.int64)
    index[place] = np.cumsum(~again) - 1
    colours = np.bincount(distinct >> 24, minlength=n)
    first_colour = np.cumsum(colours) - colours
    index = index - first_colour[owner]
    cost.append(np.where(colours <= 256, _spread(owner, np.minimum(index, 255), n) / np.where(colours <= 2, 8, np.where(colours <= 4, 4, np.where(colours <= 16, 2, 1))) + 24 * colours + 64, np.inf))
    choice = np.argmin(cost, axis=0)
    heads, pixels, widths = [], [], []
    at = 0
    for k, m in enumerate(size.tolist()):
        head, kind = start(width, m // width), int(choice[k])
        part = slice(at, at + m)
        at += m
        now = width
        if kind:
            head.put(1, 1)
            head.put((0, SUBTRACT_GREEN, PREDICTOR, PREDICTOR, CROSS_COLOUR, PALETTE)[kind], 2)
        if kind in (2, 3, 4):
            head.put(BLOCK - 2, 3)
            put_literals(head, [0xFF000000 | ((kind - 1) << 8 if kind < 4 else (int(to_blue[k]) & 255) << 8 | int(to_red[k]) & 255)])
        if kind == 5:
            table = distinct[first_colour[k] : first_colour[k] + colours[k]] & 0xFFFFFF
            head.put(len(table) - 1, 8)
            steps = np.diff(_channels((table | 0xFF000000)[None]), axis=1, prepend=np.zeros((1, 1, 4), np.uint8)).astype(np.uint8)
            put_literals(head, _argb(steps)[0].tolist())
            bundle = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            now = -(-width >> bundle)
            cells = np.zeros((m // width, now << bundle), np.int64)
            cells[:, :width] = index[part].reshape(-1, width)
            green_of = (cells.reshape(-1, now, 1 << bundle) << (np.arange(1 << bundle) * (8 >> bundle))).sum(-1).ravel()
            pixels.append(0xFF000000 | green_of << 8)
        else:
            v = variants[kind][part].astype(np.int64)
            pixels.append((0 if kind in (2, 3) else 0xFF000000) | v[:, 0] << 16 | v[:, 1] << 8 | v[:, 2])
        head.put(0, 1)  # no further transform
        heads.append(head)
        widths.append(now)
    return _entropy(heads, pixels, widths)


def put_literals(out: BitWriter, pixels: list[int]) -> None:
    """A small image inside the head: literals only, without cache."""
    out.put(0, 1)
    channels = [[p >> s & 255 for p in pixels] for s in (8, 16, 0, 24)]
    lengths = []
    for c in channels:
        counts: dict[int, int] = {}
        for v in c:
            counts[v] = counts.get(v, 0) + 1
        lengths.append(code_lengths(counts))
        put_code(out, lengths[-1])
    put_code(out, {0: 1})
    codes = [canonical(x) if len(x) > 1 else None for x in lengths]
    for pixel in zip(*channels, strict=True):
        for v, code, bits in zip(pixel, codes, lengths, strict=True):
            if code:
                out.put(code[v], bits[v])


def _runs(p: np.ndarray, owner: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of pixels repeat earlier ones of their image: first pixel, length and distance, never overlapping."""
    at = np.flatnonzero(np.arange(len(p)) + LEAST_RUN <= end[owner])
    mixed = np.zeros(len(at), np.uint64)
    for k in range(LEAST_RUN):
        mixed = (mixed ^ p[at + k].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    # The image leads the key, so that what else is in the batch never changes an image's runs.
    bits = np.uint64(HASH)
    place, again, _ = _grouped(owner[at].astype(np.uint64) << bits | mixed >> np.uint64(64) - bits, at)
    here, there = place[1:][again[1:]], place[:-1][again[1:]]
    for k in range(LEAST_RUN):
        same = p[here + k] == p[there + k]
        here, there = here[same], there[same]
    order = np.argsort(here)
    here, far = here[order], (here - there)[order]
    new = np.ones(len(here), bool)
    new[1:] = (here[1:] != here[:-1] + 1) | (far[1:] != far[:-1]) | (owner[here[1:]] != owner[here[:-1]])
    begin = np.flatnonzero(new)
    last = np.r_[begin[1:], len(here)] - 1 if len(here) else begin
    first, length, distance = [], [], []
    free = 0
    for s, e, d in zip(here[begin].tolist(), (here[last] + LEAST_RUN).tolist(), far[begin].tolist(), strict=True):
        s = max(s, free)
        while e - s >= LEAST_RUN:
            take = min(e - s, MOST_RUN)
            first.append(s)
            length.append(take)
            distance.append(d)
            s = free = s + take
    return np.array(first, np.int64), np.array(length, np.int64), np.array(distance, np.int64)


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of lengths and distances (from 1)."""
    v = value - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    few = v < 4
    extra = np.where(few, 0, high - 1)
    return np.where(few, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1)), np.where(few, 0, v & ((1 << extra) - 1)), extra


def _entropy(heads: list[BitWriter], pixels: list[np.ndarray], widths: list[int]) -> list[bytes]:
    """Finish the streams: back-references, colour cache, codes and symbols of each image."""
    n = len(heads)
    p = np.concatenate(pixels)
    size = np.array([len(x) for x in pixels])
    owner, end = np.repeat(np.arange(n), size), np.cumsum(size)
    first, length, distance = _runs(p, owner, end)
    edge = np.bincount(first, minlength=len(p) + 1) - np.bincount(first + length, minlength=len(p) + 1)
    literal = np.cumsum(edge)[:-1] == 0
    # The colour cache holds the last pixel of each hash; a pixel that is there needs one symbol.
    cache_bits = np.clip(np.frexp(size.astype(np.float64))[1] - 4, 2, MOST_CACHE_BITS)
    slot = (CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)[owner]
    place, again, _ = _grouped(owner << MOST_CACHE_BITS | slot, np.arange(len(p)))
    hit = np.zeros(len(p), bool)
    hit[place[1:]] = again[1:] & (p[place[1:]] == p[place[:-1]])
    hit &= literal
    cached = np.bincount(owner[hit], minlength=n) >= np.maximum(1, CACHE_SHARE * np.bincount(owner[literal], minlength=n))
    hit &= cached[owner]
    # Tokens: literals, hits and the first pixels of runs, each of up to four code words.
    kept = literal.copy()
    kept[first] = True
    token = np.cumsum(kept) - 1
    at = np.flatnonzero(kept)
    mine, value = owner[at], p[at]
    run, plain = token[first], ~hit[at]
    plain[run] = False
    green = np.where(hit[at], LITERALS + LENGTHS + slot[at], value >> 8 & 255)
    prefix, extra, extra_bits = _prefix(length)
    green[run] = LITERALS + prefix
    near = np.zeros((max(widths) + 1, 8 * max(widths) + 16), np.int64)
    for w in set(widths):
        for code in range(len(NEAR), 0, -1):
            near[w, max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * w)] = code
    wide = np.array(widths)[owner[first]]
    code = np.where(distance < near.shape[1], near[wide, np.minimum(distance, near.shape[1] - 1)], 0)
    far, far_extra, far_bits = _prefix(np.where(code > 0, code, distance + len(NEAR)))
    alphabet = LITERALS + LENGTHS + (1 << MOST_CACHE_BITS)
    tables = [np.bincount(mine * alphabet + green, minlength=n * alphabet).reshape(n, -1)]
    red, blue = value >> 16 & 255, value & 255
    tables.append(sum(np.bincount(mine[plain] * 256 + c[plain], minlength=n * 256) for c in (red, blue)).reshape(n, -1))
    tables.append(np.bincount(mine[run] * DISTANCES + far, minlength=n * DISTANCES).reshape(n, -1))
    words, lengths = [np.zeros(t.shape, np.uint64) for t in tables], [np.zeros(t.shape, np.int64) for t in tables]
    for k, head in enumerate(heads):
        head.put(int(cached[k]), 1)
        if cached[k]:
            head.put(int(cache_bits[k]), 4)
        head.put(0, 1)  # no meta prefix codes
        for t, (table, word, bits) in enumerate(zip(tables, words, lengths, strict=True)):
            present = np.flatnonzero(table[k])
            own = code_lengths(dict(zip(present.tolist(), table[k, present].tolist(), strict=True)))
            written = BitWriter()
            put_code(written, own)
            head.add(written)
            if t == 1:
                head.add(written)
                put_code(head, {int(pixels[k][0]) >> 24: 1})
            if len(own) > 1:
                symbol, words_of, length_of = code_words(own)
                word[k, symbol], bits[k, symbol] = words_of, length_of
    placed, bits_of = np.zeros((len(at), 4), np.uint64), np.zeros((len(at), 4), np.int64)
    placed[:, 0], bits_of[:, 0] = words[0][mine, green], lengths[0][mine, green]
    for c, channel in ((1, red), (2, blue)):
        placed[plain, c], bits_of[plain, c] = words[1][mine[plain], channel[plain]], lengths[1][mine[plain], channel[plain]]
    placed[run, 1], bits_of[run, 1] = extra, extra_bits
    placed[run, 2], bits_of[run, 2] = words[2][mine[run], far], lengths[2][mine[run], far]
    placed[run, 3], bits_of[run, 3] = far_extra, far_bits
    return _emit(heads, 4 * np.bincount(mine, minlength=n), placed.ravel(), bits_of.ravel())


def _emit(heads: list[BitWriter], size: np.ndarray, code: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """Streams of images: headers, then all code words (``size`` of each image) placed by their running bit positions."""
    first = np.cumsum(size) - size
    used = np.add.reduceat(bits, first)
    head_bits = np.array([h.size for h in heads])
    words = (head_bits + used + 63) // 64 + 1
    base = (np.cumsum(words) - words) * 64
    ends = np.cumsum(bits)
    place = ends - bits - np.repeat(ends[first] - bits[first], size) + np.repeat(base + head_bits, size)
    word, shift = place >> 6, (place & 63).astype(np.uint64)
    stream = np.zeros(int(words.sum()) + 1, np.uint64)
    begin = np.r_[0, np.flatnonzero(np.diff(word)) + 1]
    stream[word[begin]] += np.add.reduceat(code << shift, begin)
    over = np.flatnonzero(shift.astype(np.int64) + bits > 64)
    np.add.at(stream, word[over] + 1, code[over] >> (np.uint64(64) - shift[over]))
    raw = stream.tobytes()
    out = []
    for head, n, b in zip(heads, used.tolist(), (base // 8).tolist(), strict=True):
        data = bytearray(raw[b : b + (head.size + n + 7) // 8])
        for i, byte in enumerate(head.tobytes()):
            data[i] |= byte
        out.append(container(bytes(data)))
    return out


# --- reading -------------------------------------------------------------------------------


class BitReader:
    """Bits of a stream, least significant first."""

    def __init__(self, data: bytes):
        self.value, self.at, self.end = int.from_bytes(data, "little"), 0, 8 * len(data)
        self.data = data + b"\0" * 8

    def get(self, n: int) -> int:
        byte, bit = self.at >> 3, self.at & 7
        if self.at + n > self.end:
            raise ValueError("the stream ends early")
        self.at += n
        return int.from_bytes(self.data[byte : byte + 8], "little") >> bit & ((1 << n) - 1)


class Code:
    """A prefix code as a table over its longest code: symbol and length of the code at the front."""

    def __init__(self, lengths: dict[int, int]):
        if len(lengths) == 1:
            self.bits, self.table = 0, np.array([next(iter(lengths)) << 4], np.uint32)
        else:
            symbol, length, share, self.bits = _ranked(lengths)
            filled = np.zeros(1 << self.bits, np.uint32)
            used = np.repeat(symbol << 4 | length, share)[: len(filled)]
            filled[: len(used)] = used
            self.table = filled[_mirror(self.bits)]
        self.plain = self.table.tolist() if self.bits <= 8 else None
        self.largest = max(lengths)

    def read(self, bits: BitReader) -> int:
        if not self.bits:
            return int(self.table[0]) >> 4
        byte, bit = bits.at >> 3, bits.at & 7
        got = int.from_bytes(bits.data[byte : byte + 4], "little") >> bit & ((1 << self.bits) - 1)
        entry = self.plain[got] if self.plain else int(self.table[got])
        bits.at += entry & 15
        return entry >> 4


def read_code(bits: BitReader, symbols: int) -> Code:
    """One prefix code of an alphabet of ``symbols``."""
    if bits.get(1):
        two = bits.get(1)
        found = [bits.get(8 if bits.get(1) else 1)]
        if two:
            found.append(bits.get(8))
        return Code(dict.fromkeys(found, 1))
    of_lengths = {}
    for s in CODE_LENGTH_ORDER[: 4 + bits.get(4)]:
        if n := bits.get(3):
            of_lengths[s] = n
    code = _code_of(tuple(of_lengths.items()))
    table, mask = code.table.tolist() if code.plain is None else code.plain, (1 << code.bits) - 1
    left = 2 + bits.get(2 + 2 * bits.get(3)) if bits.get(1) else symbols
    lengths: dict[int, int] = {}
    at, last, place, data = 0, 8, bits.at, bits.data
    while at < symbols and left > 0:
        left -= 1
        # A word of at most seven bits and its extra bits lie in three bytes.
        got = int.from_bytes(data[place >> 3 : (place >> 3) + 3], "little") >> (place & 7)
        entry = table[got & mask]
        place += entry & 15
        got >>= entry & 15
        entry >>= 4
        if entry < 16:
            if entry:
                lengths[at] = last = entry
            at += 1
        elif entry == 16:
            for _ in range(3 + (got & 3)):
                lengths[at] = last
                at += 1
            place += 2
        elif entry == 17:
            at += 3 + (got & 7)
            place += 3
        else:
            at += 11 + (got & 127)
            place += 7
    bits.at = place
    if place > bits.end:
        raise ValueError("the stream ends early")
    return Code(lengths or {0: 1})


@lru_cache(maxsize=256)
def _code_of(lengths: tuple[tuple[int, int], ...]) -> Code:
    """The code of code lengths, which many streams share."""
    return Code(dict(lengths))


def _amount(prefix: int, bits: BitReader) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.get(extra) + 1


def _groups(bits: BitReader, width: int, height: int, main: bool) -> tuple[int, np.ndarray | None, int, list[list[Code]]]:
    """Cache bits, the meta image with its block bits, and the groups of five codes."""
    cache = bits.get(4) if bits.get(1) else 0
    meta, block = None, 0
    if main and bits.get(1):
        block = bits.get(3) + 2
        image = read_entropy(bits, -(-width >> block), -(-height >> block), main=False)
        meta = (image >> 8 & 0xFFFF).astype(np.int64)
    n = int(meta.max()) + 1 if meta is not None else 1
    green = LITERALS + LENGTHS + (1 << cache if cache else 0)
    return cache, meta, block, [[read_code(bits, s) for s in (green, 256, 256, 256, DISTANCES)] for _ in range(n)]


def read_entropy(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as (height, width) ARGB integers."""
    cache_bits, meta, block, groups = _groups(bits, width, height, main)
    cache = [0] * (1 << cache_bits) if cache_bits else []
    out: list[int] = []
    total = width * height
    fresh = 0  # pixels not yet put into the cache
    codes = groups[0]
    while len(out) < total:
        if meta is not None:
            y, x = divmod(len(out), width)
            codes = groups[meta[y >> block, x >> block]]
        s = codes[0].read(bits)
        if s < LITERALS:
            red, blue, alpha = codes[1].read(bits), codes[2].read(bits), codes[3].read(bits)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < LITERALS + LENGTHS:
            length = _amount(s - LITERALS, bits)
            far = _amount(codes[4].read(bits), bits)
            if far > len(NEAR):
                back = far - len(NEAR)
            else:
                x, y = NEAR[far - 1]
                back = max(1, x + y * width)
            if back > len(out) or len(out) + length > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out.append(out[-back])
        else:
            for p in out[fresh:]:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            fresh = len(out)
            out.append(cache[s - LITERALS - LENGTHS])
    if bits.at > bits.end:
        raise ValueError("the stream ends early")
    return np.array(out, np.uint32).reshape(height, width)


def _channels(image: np.ndarray) -> np.ndarray:
    """(height, width, 4) bytes as blue, green, red, alpha."""
    return np.ascontiguousarray(image, "<u4").view(np.uint8).reshape(*image.shape, 4)


def _argb(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, np.uint8).view("<u4").reshape(channels.shape[:2])


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int32) + b) // 2


def _select(left: np.ndarray, top: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Whichever of left and top is nearer to left + top - corner, summed over channels."""
    to_left = np.abs(top.astype(np.int32) - corner).sum(-1, keepdims=True)
    to_top = np.abs(left.astype(np.int32) - corner).sum(-1, keepdims=True)
    return np.where(to_left < to_top, left, top)


def predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The predicted channels; ``right`` is the pixel above to the right, ``corner`` above to the left."""
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode in (6, 7, 8, 9):
        a, b = ((left, corner), (left, top), (corner, top), (top, right))[mode - 6]
        return _average(a, b)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return np.clip(left.astype(np.int32) + top - corner, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        half = mean - corner
        return np.clip(mean + np.where(half < 0, -(-half // 2), half // 2), 0, 255)
    return np.array([0, 0, 0, 255])


#: Predictors that do not look at the pixel to the left: whole rows follow from the row above.
_ROWWISE = {0, 2, 3, 4, 8, 9, 14, 15}


def undo_predictor(residual: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    """Add predictions back; the top row predicts from the left and the left column from the top."""
    height, width = residual.shape
    r = _channels(residual)
    out = np.zeros_like(r)
    mode = (modes >> 8 & 15).astype(np.int64)
    out[0] = np.cumsum(r[0], axis=0, dtype=np.uint8)
    out[0, :, 3] += 255
    for y in range(1, height):
        above = out[y - 1]
        out[y, 0] = r[y, 0] + above[0]
        # The pixel above to the right of the last one is the row's own first.
        right = np.concatenate([above[1:], out[y, :1]])
        row = mode[y >> block, np.arange(width) >> block]
        if (row[1:] == 1).all():
            out[y] = np.cumsum(np.concatenate([out[y, :1], r[y, 1:]]), axis=0, dtype=np.uint8)
        elif _ROWWISE.issuperset(row.tolist()):
            for m in set(row[1:].tolist()):
                at = np.flatnonzero(row[1:] == m) + 1
                out[y, at] = (r[y, at] + predict(m, above[at], above[at], right[at], above[at - 1])).astype(np.uint8)
        else:
            for x in range(1, width):
                out[y, x] = (r[y, x] + predict(int(row[x]), out[y, x - 1], above[x], right[x], above[x - 1])).astype(np.uint8)
    return _argb(out)


def undo_cross_colour(image: np.ndarray, factors: np.ndarray, block: int) -> np.ndarray:
    """Add the parts of red and blue that green and red explain, by block."""
    height, width = image.shape
    c = _channels(image).astype(np.int32)
    f = _channels(factors).view(np.int8).astype(np.int32)[np.arange(height)[:, None] >> block, np.arange(width)[None] >> block]
    green = c[..., 1].astype(np.uint8).view(np.int8).astype(np.int32)
    red = (c[..., 2] + (f[..., 0] * green >> 5)) & 255
    blue = (c[..., 0] + (f[..., 1] * green >> 5) + (f[..., 2] * red.astype(np.uint8).view(np.int8) >> 5)) & 255
    return _argb(np.stack([blue, c[..., 1], red, c[..., 3]], -1))


def undo_subtract_green(image: np.ndarray) -> np.ndarray:
    c = _channels(image).copy()
    c[..., 0] += c[..., 1]
    c[..., 2] += c[..., 1]
    return _argb(c)


def undo_palette(image: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    """Look indices up; small palettes hold several in one pixel's green."""
    bundle = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
    green = image >> 8 & 255
    depth = 8 >> bundle
    if bundle:
        green = np.stack([green >> (depth * k) & ((1 << depth) - 1) for k in range(1 << bundle)], -1).reshape(len(image), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[green]


def _payload(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The VP8L stream of the container at this offset, and where the container ends."""
    if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP image")
    size, own = struct.unpack_from("<I", data, at + 4)[0], struct.unpack_from("<I", data, at + 16)[0]
    return data[at + 20 : at + 20 + own], at + 8 + size


def _head(stream: bytes) -> tuple[BitReader, int, int, list[tuple], int]:
    """The reader after the transforms, the size, the transforms, and the width that they leave."""
    bits = BitReader(stream)
    if bits.get(8) != 0x2F:
        raise ValueError("not a VP8L stream")
    width, height = bits.get(14) + 1, bits.get(14) + 1
    bits.get(4)
    steps: list[tuple] = []
    now = width
    while bits.get(1):
        kind = bits.get(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.get(3) + 2
            steps.append((kind, read_entropy(bits, -(-now >> block), -(-height >> block), main=False), block))
        elif kind == PALETTE:
            n = bits.get(8) + 1
            table = _argb(np.cumsum(_channels(read_entropy(bits, n, 1, main=False)), axis=1, dtype=np.uint8))[0]
            steps.append((kind, table, now))
            now = -(-now >> (3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0))
        else:
            steps.append((kind,))
    return bits, width, height, steps, now


def _undo(image: np.ndarray, steps: list[tuple]) -> np.ndarray:
    """The image before its transforms, last one first."""
    for kind, *more in reversed(steps):
        if kind == PREDICTOR:
            image = undo_predictor(image, *more)
        elif kind == CROSS_COLOUR:
            image = undo_cross_colour(image, *more)
        elif kind == PALETTE:
            image = undo_palette(image, *more)
        else:
            image = undo_subtract_green(image)
    return image


def read_stream(stream: bytes) -> np.ndarray:
    """Any VP8L stream as (height, width) ARGB integers, read by itself."""
    bits, _, height, steps, now = _head(stream)
    return _undo(read_entropy(bits, now, height, main=True), steps)


def read_images(data: Iterable[bytes]) -> list[np.ndarray]:
    """Flat RGB samples of images of any kind, whose symbols are read in step with each other."""
    streams = [_payload(d)[0] for d in data]
    lanes = []
    for s in streams:
        bits, _, height, steps, now = _head(s)
        lanes.append((now, height, steps, None, *_groups(bits, now, height, main=True), bits.at))
    try:
        decoded = _in_step(lanes, streams)
    except IndexError:
        raise ValueError("a stream ends early") from None
    return [_channels(_undo(image, lane[2]))[..., 2::-1].reshape(-1) for image, lane in zip(decoded, lanes, strict=True)]


def _in_step(lanes: list[tuple], streams: list[bytes]) -> list[np.ndarray]:
    """The entropy-coded images of streams, one symbol of each at a time.

    A lane is one image. Literals, cache hits and back-references of a step are
    each done for all lanes that have one. Lanes at their end read an empty code
    into a spare pixel until an eighth of the lanes is done; then these leave.
    """
    if not lanes:
        return []
    raw = np.frombuffer(b"".join(s + bytes(8) for s in streams), np.uint8)
    window = raw[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        window |= raw[k : len(raw) - 3 + k].astype(np.uint32) << 8 * k
    size = np.array([len(s) + 8 for s in streams], np.int64)
    head = np.array([lane[-1] for lane in lanes], np.int64)
    at, stop = (np.cumsum(size) - size) * 8 + head, np.cumsum(size) * 8 - 64
    # The tables of all codes, one after the other; the first is an empty code of symbol 0.
    parts, known, total = [np.zeros(1, np.uint32)], {b"": 0}, 1
    offs, masks, first_group, meta_base, metas = [], [], [], [], [np.zeros(0, np.int64)]
    for lane in lanes:
        meta, groups = lane[5], lane[7]
        first_group.append(len(offs))
        for codes in groups:
            for code in codes:
                key = code.table.tobytes()
                if key not in known:
                    known[key] = total
                    parts.append(code.table)
                    total += len(code.table)
            offs.append([known[c.table.tobytes()] for c in codes])
            masks.append([len(c.table) - 1 for c in codes])
        meta_base.append(sum(map(len, metas)) if meta is not None else -1)
        if meta is not None:
            metas.append(meta.ravel())
    table = np.concatenate(parts).astype(np.int32)
    all_off, all_mask = np.array(offs, np.int64).T, np.array(masks, np.uint32).T
    first_group, meta_base, meta_of = np.array(first_group), np.array(meta_base), np.concatenate(metas)
    block = np.array([lane[6] for lane in lanes])
    wide = np.array([lane[0] for lane in lanes], np.int64)
    count = wide * np.array([lane[1] for lane in lanes], np.int64)
    spare = int(count.sum())
    out = np.zeros(spare + 1, np.uint32)
    ends = np.cumsum(count)
    begin, pos, end = ends - count, ends - count, ends.copy()
    cache_bits = np.array([lane[4] for lane in lanes], np.int64)
    cache = np.zeros(int((1 << cache_bits).sum()), np.uint32)
    slots, shift = np.cumsum(1 << cache_bits) - (1 << cache_bits), 32 - cache_bits
    lane_of, live = np.arange(len(lanes)), np.ones(len(lanes), np.int64)
    off, mask = all_off[:, first_group], all_mask[:, first_group]
    with_meta = bool((meta_base >= 0).any())
    near_x, near_y = (np.array([0, *(c[k] for c in NEAR)]) for k in range(2))

    def take(c: int, some: np.ndarray | slice) -> np.ndarray:
        here = at[some]
        entry = table[off[c, some] + ((window[here >> 3] >> (here & 7).astype(np.uint32)) & mask[c, some])]
        at[some] = here + (entry & 15)
        return entry >> 4

    def amount(prefix: np.ndarray, some: np.ndarray) -> np.ndarray:
        here, prefix = at[some], prefix.astype(np.int64)
        extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
        got = (window[here >> 3] >> (here & 7).astype(np.uint32)).astype(np.int64) & ((1 << extra) - 1)
        at[some] = here + extra
        return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + got) + 1

    def put(values: np.ndarray, place: np.ndarray, some: np.ndarray | slice) -> None:
        out[place] = values
        cache[slots[some] + ((CACHE_MULTIPLIER * values & 0xFFFFFFFF) >> shift[some])] = values

    done = 0
    while True:
        if with_meta:
            which = np.flatnonzero((meta_base[lane_of] >= 0) & (live > 0))
            lane = lane_of[which]
            y, x = np.divmod(pos[which] - begin[lane], wide[lane])
            across = -(-wide[lane] >> block[lane])
            group = first_group[lane] + meta_of[meta_base[lane] + (y >> block[lane]) * across + (x >> block[lane])]
            off[:, which], mask[:, which] = all_off[:, group], all_mask[:, group]
        symbol = take(0, slice(None)).astype(np.int64)
        literal = symbol < LITERALS
        if literal.all():
            some: np.ndarray | slice = slice(None)
            green = symbol
        else:
            some = np.flatnonzero(literal)
            green = symbol[some]
        red, blue = take(1, some).astype(np.int64), take(2, some)
        alpha = (take(3, some) if mask[3].any() else table[off[3, some]] >> 4).astype(np.int64)
        put(alpha << 24 | red << 16 | green << 8 | blue, pos[some], some)
        pos[some] += live[some]
        if not isinstance(some, slice):
            some = np.flatnonzero(symbol >= LITERALS + LENGTHS)
            out[pos[some]] = cache[slots[some] + symbol[some] - LITERALS - LENGTHS]
            pos[some] += 1
            some = np.flatnonzero(~literal & (symbol < LITERALS + LENGTHS))
            if len(some):
                length = amount(symbol[some] - LITERALS, some)
                far = amount(take(4, some), some)
                close = np.minimum(far, len(NEAR))
                lane = lane_of[some]
                back = np.where(far > len(NEAR), far - len(NEAR), np.maximum(1, near_x[close] + near_y[close] * wide[lane]))
                if (back > pos[some] - begin[lane]).any() or (pos[some] + length > end[some]).any():
                    raise ValueError("a back-reference leaves the image")
                own = np.repeat(np.arange(len(some)), length)
                step = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)
                # A run that reaches into itself repeats its first pixels.
                values = out[(pos[some] - back)[own] + step % back[own]].astype(np.int64)
                put(values, pos[some][own] + step, some[own])
                pos[some] += length
        over = pos >= end
        if over.any():
            gone = np.flatnonzero(over & (live > 0))
            if (at[gone] > stop[gone]).any():
                raise ValueError("a stream ends early")
            done += len(gone)
            if done == len(at):
                break
            live[gone], pos[gone], end[gone] = 0, spare, spare + 1
            off[:, gone], mask[:, gone] = 0, 0
            shift[gone], slots[gone] = 32, slots[gone]
            if 8 * done >= len(at):
                stay = live > 0
                at, stop, pos, end, slots, shift, lane_of, live = (v[stay] for v in (at, stop, pos, end, slots, shift, lane_of, live))
                off, mask, done = off[:, stay], mask[:, stay], 0
    return [out[e - c : e].reshape(-1, w) for e, c, w in zip(ends.tolist(), count.tolist(), wide.tolist(), strict=True)]


def split_images(data: bytes) -> list[bytes]:
    """The images of a stored form that holds several, one after the other."""
    out, at = [], 0
    while at < len(data):
        _, end = _payload(data, at)
        out.append(data[at:end])
        at = end
    return out
