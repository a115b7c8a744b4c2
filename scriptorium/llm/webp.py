"""Lossless WebP (operator 3): a decoder for all parts of the format, an encoder with back-references, and media columns in Spark.

Decoded are prefix codes (simple and normal, one or several groups), back-references, the colour cache, and the predictor,
cross-colour, subtract-green and palette transforms. Runs of literals are decoded by numpy: for every bit position the end of a
pixel that started there is looked up at once, then the chain of true pixel starts is followed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_python, table

#: Fixed values of the format: order of code-length codes, near-neighbour distances (x, y) of the 120 short distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
#: Bytes of a stream whose bit positions are looked up at once.
_CHUNK = 1 << 16
_EIGHT, _PLACES = np.arange(8), np.arange(8 * (_CHUNK + 24), dtype=np.intp)


def short_distances() -> list[tuple[int, int]]:
    """The 120 pixels before the current one in its neighbourhood, nearest first; ties: the smaller column offset first, then ahead of behind."""
    near = [(x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0]
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


_SHORT = short_distances()


class Bits:
    """Reads bits, least significant first; bits beyond the end are zero."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.p = data + bytes(8), at * 8

    def read(self, n: int) -> int:
        p = self.p
        self.p = p + n
        if p >> 3 > len(self.data) - 8:
            raise ValueError("the stream ends too early")
        return int.from_bytes(self.data[p >> 3 : (p >> 3) + 5], "little") >> (p & 7) & ((1 << n) - 1)


_FLIPPED = [int(f"{i:08b}"[::-1], 2) for i in range(256)]


def _reversed(code: int, n: int) -> int:
    """The n bits of a code (15 at most) in reverse."""
    return (_FLIPPED[code & 255] << 8 | _FLIPPED[code >> 8]) >> (16 - n)


def _trimmed(lengths: list[int]) -> tuple[int, ...]:
    """Without the zeros at the end, which make no difference."""
    n = len(lengths)
    while n and not lengths[n - 1]:
        n -= 1
    return tuple(lengths[:n])


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (bits in stream order, length)."""
    return _canonical(_trimmed(lengths))


@lru_cache(256)
def _canonical(lengths: tuple) -> dict[int, tuple[int, int]]:
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = (_reversed(code, n), n)
        code += 1
    return out


class Code:
    """A prefix code: tables over the next `width` bits give symbol and length."""

    def __init__(self, lengths):
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) < 2:
            self.width, self.symbol, self.length = 0, np.array(used or [0], np.int32), np.zeros(1, np.intp)
        else:
            codes = canonical(lengths)
            self.width = max(n for _, n in codes.values())
            if sum(1 << (self.width - n) for _, n in codes.values()) != 1 << self.width:
                raise ValueError("not a full prefix code")
            self.symbol, self.length = np.zeros(1 << self.width, np.int32), np.zeros(1 << self.width, np.intp)
            for s, (bits, n) in codes.items():
                self.symbol[bits :: 1 << n] = s
                self.length[bits :: 1 << n] = n
        self.symbols, self.lengths, self.mask = self.symbol.tolist(), self.length.tolist(), (1 << self.width) - 1

    def read(self, b: Bits) -> int:
        p = b.p
        i = int.from_bytes(b.data[p >> 3 : (p >> 3) + 4], "little") >> (p & 7) & self.mask
        b.p = p + self.lengths[i]
        if b.p >> 3 > len(b.data) - 8:
            raise ValueError("the stream ends too early")
        return self.symbols[i]


@lru_cache(256)
def _code_of(lengths: tuple) -> Code:
    return Code(lengths)


def code_of(lengths: list[int]) -> Code:
    """The code with these lengths. Images use the same code again and again."""
    return _code_of(_trimmed(lengths))


def read_code(b: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if b.read(1):
        two = b.read(1)
        lengths[b.read(8 if b.read(1) else 1)] = 1
        if two:
            lengths[b.read(8)] = 1
        return code_of(lengths)
    first = [0] * 19
    some = LENGTH_ORDER[: 4 + b.read(4)]
    sizes = int.from_bytes(b.data[b.p >> 3 : (b.p >> 3) + 9], "little") >> (b.p & 7)
    b.p += 3 * len(some)
    for k in some:
        first[k] = sizes & 7
        sizes >>= 3
    of_lengths = code_of(first)
    left = 2 + b.read(2 + 2 * b.read(3)) if b.read(1) else alphabet
    at, before = 0, 8
    symbols, sizes, mask, data, p = of_lengths.symbols, of_lengths.lengths, of_lengths.mask, b.data, b.p
    while at < alphabet and left:
        left -= 1
        i = int.from_bytes(data[p >> 3 : (p >> 3) + 3], "little") >> (p & 7) & mask
        s = symbols[i]
        p += sizes[i]
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
            continue
        b.p = p
        value, n = (before, 3 + b.read(2)) if s == 16 else (0, 3 + b.read(3)) if s == 17 else (0, 11 + b.read(7))
        if at + n > alphabet:
            raise ValueError("code lengths run over")
        lengths[at : at + n] = [value] * n
        at += n
        p = b.p
    if p >> 3 > len(data) - 8:
        raise ValueError("the stream ends too early")
    b.p = p
    return code_of(lengths)


def read_codes(b: Bits, greens: int) -> list[Code]:
    """The codes of green, red, blue, alpha and distances. Where blue or alpha has the bits that red has, it is red's code."""
    green, start = read_code(b, greens), b.p
    out = [green, read_code(b, 256)]
    n = b.p - start
    bits = lambda p: int.from_bytes(b.data[p >> 3 : (p + n + 7) >> 3], "little") >> (p & 7) & ((1 << n) - 1)
    red = bits(start)
    for _ in range(2):
        if b.p + n <= 8 * len(b.data) - 64 and bits(b.p) == red:
            out.append(out[1])
            b.p += n
        else:
            out.append(read_code(b, 256))
    return [*out, read_code(b, 40)]


def _extra(b: Bits, s: int) -> int:
    """The length or distance of a prefix symbol."""
    if s < 4:
        return s + 1
    n = (s - 2) >> 1
    return ((2 + (s & 1)) << n) + b.read(n) + 1


def _image(b: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The ARGB values of an entropy-coded image, row by row."""
    cache_bits = b.read(4) if b.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups, meta, meta_bits, meta_width = 1, None, 0, 0
    if main and b.read(1):
        meta_bits = b.read(3) + 2
        meta_width = -(-width >> meta_bits)
        meta = (_image(b, meta_width, -(-height >> meta_bits), False) >> 8 & 0xFFFF).tolist()
        groups = max(meta) + 1
    codes = [read_codes(b, 280 + (1 << cache_bits if cache_bits else 0)) for _ in range(groups)]
    total = width * height
    out = np.zeros(total, np.uint32)
    at = 0
    if groups == 1 and not cache_bits:
        while at < total:
            at = _literals(b, codes[0], out, at, total)
            if at < total:
                at = _reference(b, codes[0][0].read(b), codes[0][4], out, at, width, total)
        return out
    cache = [0] * (1 << cache_bits)
    done = 0  # pixels that the cache has seen
    while at < total:
        y, x = divmod(at, width)
        g = codes[meta[(y >> meta_bits) * meta_width + (x >> meta_bits)] if meta else 0]
        s = g[0].read(b)
        if s < 256:
            r, blue, a = g[1].read(b), g[2].read(b), g[3].read(b)
            out[at] = a << 24 | r << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            at = _reference(b, s, g[4], out, at, width, total)
        else:
            out[at] = cache[s - 280]
            at += 1
        if cache_bits:
            for v in out[done:at].tolist():
                cache[(0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v
            done = at
    return out


def _reference(b: Bits, s: int, code: Code, out: np.ndarray, at: int, width: int, total: int) -> int:
    n = _extra(b, s - 256)
    d = _extra(b, code.read(b))
    if d > 120:
        d -= 120
    else:
        x, y = _SHORT[d - 1]
        d = max(1, x + y * width)
    if d > at or at + n > total:
        raise ValueError("a back-reference leaves the image")
    if d >= n:
        out[at : at + n] = out[at - d : at - d + n]
    else:
        out[at : at + n] = np.resize(out[at - d : at], n)
    return at + n


def _literals(b: Bits, codes: list[Code], out: np.ndarray, at: int, total: int) -> int:
    """Literal pixels from here to the first symbol that is none; the reader then stands before that symbol."""
    green, red, blue, alpha, _ = codes
    if not (green.width or red.width or blue.width or alpha.width):
        if green.symbols[0] < 256:
            out[at:] = alpha.symbols[0] << 24 | red.symbols[0] << 16 | green.symbols[0] << 8 | blue.symbols[0]
            return total
        return at
    chunk = 256 if at else _CHUNK  # a stream may be literals all through
    while at < total:
        base = b.p >> 3
        if base >= len(b.data):
            raise ValueError("the stream ends too early")
        end = min(len(b.data), base + chunk)
        # what follows a pixel's first symbol, 60 bits at most, stays in reach
        raw = np.frombuffer(b.data[base : end + 10] + bytes(10), np.uint8)[: end - base + 10].astype(np.intp)
        value = ((raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16)[:, None] >> _EIGHT).reshape(-1)
        bits, wide = 8 * (end - base), len(value)
        # where each position leads to by each code; channels often share one
        ahead = {}
        for code in (red, blue, alpha):
            if id(code) not in ahead:
                ahead[id(code)] = _PLACES[:wide] + code.length.take(value & code.mask)
        p1 = ahead[id(green)][:bits] if id(green) in ahead else _PLACES[:bits] + green.length.take(value[:bits] & green.mask)
        p2 = ahead[id(red)].take(p1)
        p3 = ahead[id(blue)].take(p2)
        after = ahead[id(alpha)].take(p3)
        if green.symbol.max() >= 256:
            after[green.symbol.take(value[:bits] & green.mask) >= 256] = -1
        follow, p, starts = memoryview(after), b.p & 7, []
        add = starts.append
        for _ in range(total - at):
            if p >= bits:
                break
            q = follow[p]
            if q < 0:
                break
            add(p)
            p = q
        s0 = np.array(starts, np.intp)
        s1, s2, s3 = p1[s0], p2[s0], p3[s0]
        g = green.symbol[value[s0] & green.mask].astype(np.uint32)
        r = red.symbol[value[s1] & red.mask].astype(np.uint32)
        u = blue.symbol[value[s2] & blue.mask].astype(np.uint32)
        a = alpha.symbol[value[s3] & alpha.mask].astype(np.uint32)
        out[at : at + len(s0)] = a << 24 | r << 16 | g << 8 | u
        at += len(s0)
        b.p = base * 8 + p
        if p >> 3 > len(b.data) - base:
            raise ValueError("the stream ends too early")
        if p < bits:
            return at
        chunk = min(_CHUNK, chunk * 8)
    return at


def _channels(v: np.ndarray) -> np.ndarray:
    """ARGB words as rows of B, G, R, A."""
    return v.astype("<u4").view(np.uint8).reshape(-1, 4)


def _average(a, c):
    return [(x + y) >> 1 for x, y in zip(a, c, strict=True)]


def _predict(mode: int, left, top, topright, topleft) -> list[int]:
    if mode == 0:
        return [0, 0, 0, 255]
    if mode < 5:
        return (left, top, topright, topleft)[mode - 1]
    if mode == 5:
        return _average(_average(left, topright), top)
    if mode < 9:
        return _average(*((left, topleft), (left, top), (topleft, top))[mode - 6])
    if mode == 9:
        return _average(top, topright)
    if mode == 10:
        return _average(_average(left, topleft), _average(top, topright))
    if mode == 11:
        by_left = sum(abs(t - q) for t, q in zip(top, topleft, strict=True))
        by_top = sum(abs(x - q) for x, q in zip(left, topleft, strict=True))
        return left if by_left < by_top else top
    if mode == 12:
        return [min(255, max(0, x + t - q)) for x, t, q in zip(left, top, topleft, strict=True)]
    mean = _average(left, top)
    return [min(255, max(0, m + int((m - q) / 2))) for m, q in zip(mean, topleft, strict=True)]


def predict_all(pixels: np.ndarray, modes: list[int], bits: int, width: int, height: int, inverse: bool) -> np.ndarray:
    """The predictor transform: residuals to pixels (inverse) or back. The first pixel is predicted opaque black, the first row from the left, the first column from above."""
    px = [list(map(int, q)) for q in _channels(pixels)]
    full = px if inverse else [list(q) for q in px]
    out = [None] * len(px)
    blocks = -(-width >> bits)
    for i in range(len(px)):
        y, x = divmod(i, width)
        if i == 0:
            guess = [0, 0, 0, 255]
        elif y == 0:
            guess = full[i - 1]
        elif x == 0:
            guess = full[i - width]
        else:
            guess = _predict(modes[(y >> bits) * blocks + (x >> bits)], full[i - 1], full[i - width], full[i - width + 1], full[i - width - 1])
        if inverse:
            full[i] = out[i] = [(v + g) & 255 for v, g in zip(px[i], guess, strict=True)]
        else:
            out[i] = [(v - g) & 255 for v, g in zip(px[i], guess, strict=True)]
    return np.array(out, np.uint8).reshape(-1).view("<u4").astype(np.uint32)


def cross_all(pixels: np.ndarray, factors: np.ndarray, bits: int, width: int, height: int, inverse: bool) -> np.ndarray:
    """The cross-colour transform: red and blue less what green (and red) foretell of them."""
    c = _channels(pixels).astype(np.int32)
    y, x = np.divmod(np.arange(len(c)), width)
    f = _channels(factors)[(y >> bits) * -(-width >> bits) + (x >> bits)].view(np.int8).astype(np.int32)
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int32)
    to_red, to_blue, red_to_blue = f[:, 0], f[:, 1], f[:, 2]
    green, sign = signed(c[:, 1]), 1 if inverse else -1
    old_red = c[:, 2].copy()
    c[:, 2] = (c[:, 2] + sign * ((to_red * green) >> 5)) & 255
    red = signed(c[:, 2] if inverse else old_red)
    c[:, 0] = (c[:, 0] + sign * (((to_blue * green) >> 5) + ((red_to_blue * red) >> 5))) & 255
    return c.astype(np.uint8).reshape(-1).view("<u4").astype(np.uint32)


def green_all(pixels: np.ndarray, inverse: bool) -> np.ndarray:
    c = _channels(pixels).copy()
    for k in (0, 2):
        c[:, k] = c[:, k] + c[:, 1] if inverse else c[:, k] - c[:, 1]
    return c.reshape(-1).view("<u4").astype(np.uint32)


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and ARGB pixels (uint32, row by row) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image in the file")
        at += 8 + (int.from_bytes(data[at + 4 : at + 8], "little") + 1 & ~1)
    b = Bits(data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")])
    if b.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height, opaque = b.read(14) + 1, b.read(14) + 1, not b.read(1)
    if b.read(3):
        raise ValueError("unknown version")
    full, steps, seen = width, [], set()
    while b.read(1):
        kind = b.read(2)
        if kind in seen:
            raise ValueError("a transform twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            bits = b.read(3) + 2
            steps.append((kind, bits, width, _image(b, -(-width >> bits), -(-height >> bits), False)))
        elif kind == GREEN:
            steps.append((kind, 0, width, None))
        else:
            n = b.read(8) + 1
            deltas = _channels(_image(b, n, 1, False))
            colours = np.cumsum(deltas, axis=0, dtype=np.uint8).astype(np.uint8).reshape(-1).view("<u4")
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, bits, width, colours))
            width = -(-width >> bits)
    px = _image(b, width, height, True)
    for kind, bits, w, extra in reversed(steps):
        if kind == PREDICTOR:
            px = predict_all(px, (extra >> 8 & 15).tolist(), bits, w, height, True)
        elif kind == CROSS:
            px = cross_all(px, extra, bits, w, height, True)
        elif kind == GREEN:
            px = green_all(px, True)
        else:
            index = (px >> 8 & 255).reshape(height, -1)
            if bits:
                each = 8 >> bits
                index = (index[:, :, None] >> (np.arange(1 << bits, dtype=np.uint32) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :w]
            colours = np.zeros(256, np.uint32)
            colours[: len(extra)] = extra
            px = colours[index.reshape(-1)]
    return full, height, (px | np.uint32(0xFF000000)) if opaque else px


# ---- encoder


class Writer:
    def __init__(self):
        self.value, self.n, self.parts = 0, 0, []

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n

    def bits(self) -> np.ndarray:
        raw = np.frombuffer(self.value.to_bytes((self.n + 7) // 8, "little"), np.uint8)
        return np.unpackbits(raw, bitorder="little")[: self.n]


def code_lengths(counts, most: int = 15) -> list[int]:
    """Huffman code lengths of at most `most` bits; flatter counts are tried until they fit."""
    counts = list(counts)
    while True:
        leaves = sorted((c, s) for s, c in enumerate(counts) if c)
        if len(leaves) < 2:
            return [1 if c else 0 for c in counts]
        # sums come in rising order, so the least two stand at the heads of two queues; of equal counts leaves come first
        sums, kids, at, done, n = [], [], 0, 0, len(leaves)
        for _ in range(n - 1):
            total, pair = 0, []
            for _ in range(2):
                if at < n and (done == len(sums) or leaves[at][0] <= sums[done]):
                    total += leaves[at][0]
                    pair.append(~leaves[at][1])
                    at += 1
                else:
                    total += sums[done]
                    pair.append(done)
                    done += 1
            sums.append(total)
            kids.append(pair)
        lengths, depth = [0] * len(counts), [0] * len(kids)
        for k in range(len(kids) - 1, -1, -1):
            d = depth[k] + 1
            for c in kids[k]:
                if c < 0:
                    lengths[~c] = d
                else:
                    depth[c] = d
        if max(lengths) <= most:
            return lengths
        counts = [(c + 1) // 2 if c else 0 for c in counts]


def put_code(w: Writer, lengths) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        w.put(1, 1)
        w.put(max(0, len(used) - 1), 1)
        first = used[0] if used else 0
        w.put(int(first > 1), 1)
        w.put(first, 8 if first > 1 else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    runs, at = [], 0
    for s in [*used, len(lengths)]:
        zeros = s - at
        while zeros >= 3:
            n = min(zeros, 138)
            runs.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3))
            zeros -= n
        runs += [(0, 0, 0)] * zeros
        if s < len(lengths):
            runs.append((lengths[s], 0, 0))
        at = s + 1
    counts = [0] * 19
    for s, _, _ in runs:
        counts[s] += 1
    if sum(map(bool, counts)) == 1:
        counts[next(s for s in (0, 1) if not counts[s])] = 1
    own = code_lengths(counts, 7)
    last = max(k for k, s in enumerate(LENGTH_ORDER) if own[s])
    w.put(0, 1)
    w.put(max(4, last + 1) - 4, 4)
    for s in LENGTH_ORDER[: max(4, last + 1)]:
        w.put(own[s], 3)
    w.put(0, 1)
    codes = canonical(own)
    value = at = 0
    for s, v, n in runs:
        bits, size = codes[s]
        value |= (bits | v << size) << at
        at += size + n
    w.put(value, at)


def _wrap(width: int, height: int, bits: np.ndarray) -> bytes:
    body = np.packbits(bits, bitorder="little").tobytes()
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body


def _start(width: int, height: int) -> Writer:
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    return w


#: Pixels of the shortest and longest back-reference, its longest distance, and bits that a code of its own for green takes, about.
SHORTEST, LONGEST, FARTHEST, _OWN_CODE = 3, 4096, (1 << 20) - 120, 300
_MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def repeats(px: np.ndarray) -> list[tuple[int, int, int]]:
    """(first pixel, pixels, distance) of runs that stand before in the image too, from left to right without overlaps; each by the last place before."""
    if len(px) <= SHORTEST:
        return []
    v = px.astype(np.uint64)
    keys = v[:-2] * _MIX[0] ^ v[1:-1] * _MIX[1] ^ v[2:] * _MIX[2]
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    again = np.flatnonzero(sorted_keys[1:] == sorted_keys[:-1])
    if not len(again):
        return []
    before = np.full(len(keys), -1)
    before[order[again + 1]] = order[again]
    at = np.flatnonzero(before >= 0)
    far = at - before[at]
    new = np.flatnonzero((np.diff(at) != 1) | (np.diff(far) != 0)) + 1
    starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(at)]]) - 1
    out, done = [], 0
    for start, end, d in zip(at[starts].tolist(), (at[ends] + SHORTEST).tolist(), far[starts].tolist(), strict=True):
        start = max(start, done)
        if d > FARTHEST or end - start < SHORTEST or not np.array_equal(px[start:end], px[start - d : end - d]):  # a key is but a hash
            continue
        done = end
        while end - start >= SHORTEST:
            n = min(end - start, LONGEST)
            out.append((start, n, d))
            start += n
        done = start
    return out


def _prefixed(v: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits, their number) of a length or distance; the inverse of _extra."""
    v -= 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    return 2 * n + 2 + (v >> n & 1), v & ((1 << n) - 1), n


def _bit_table(lengths) -> tuple[np.ndarray, np.ndarray]:
    """(bits, used) of each symbol's code, a row for each symbol."""
    width = max(1, max(lengths))
    bits, codes = np.zeros(len(lengths), np.int64), canonical(lengths)
    for s, (v, _) in codes.items():
        bits[s] = v
    if len(codes) < 2:  # a code of one symbol takes no bits
        lengths = [0] * len(lengths)
    places = np.arange(width)
    return (bits[:, None] >> places & 1).astype(np.uint8), places < np.array(lengths)[:, None]


def _coded(bits: np.ndarray, used: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    return bits.take(symbols, 0)[used.take(symbols, 0)]


def encode_bytes(samples: np.ndarray, width: int, height: int) -> bytes:
    """A file whose pixels hold these bytes, in the order red, green, blue, alpha.

    Literals and back-references to runs of pixels that stand before; references only where they save more than the code of
    their own that green then needs. Red, blue and alpha share one prefix code; without references green does too.
    """
    pixels = np.ascontiguousarray(samples).view("<u4")
    refs = repeats(pixels)
    counts = np.bincount(samples, minlength=256)
    each = code_lengths(counts.tolist())
    a_literal = 4 * float(np.dot(counts, each)) / len(samples)
    if sum((n * a_literal - 36 for _, n, _ in refs), -_OWN_CODE) <= 0:
        refs = []
    w = _start(width, height)
    w.put(0, 3)  # no transform, colour cache or groups
    rows = samples.reshape(-1, 4)
    green, distance, tokens = each + [0] * 24, [1], []
    if refs:
        literal = np.ones(len(rows), bool)
        for start, n, _ in refs:
            literal[start : start + n] = False
        rows = rows[literal]
        tokens = [(_prefixed(n), _prefixed(d + 120)) for _, n, d in refs]
        of_green, of_distance = np.zeros(280, np.int64), np.zeros(40, np.int64)
        of_green[:256] = np.bincount(rows[:, 1], minlength=256)
        for (s, _, _), (k, _, _) in tokens:
            of_green[256 + s] += 1
            of_distance[k] += 1
        green, distance = code_lengths(of_green.tolist()), code_lengths(of_distance.tolist())
        each = code_lengths(np.bincount(rows[:, [0, 2, 3]].reshape(-1), minlength=256).tolist())
    put_code(w, green)
    same = Writer()
    put_code(same, each)
    for _ in range(3):
        w.put(same.value, same.n)
    put_code(w, distance)
    head = w.bits()
    table, used = _bit_table(each)
    if not refs:
        inner = rows[:, [1, 0, 2, 3]].reshape(-1)  # green comes first in the stream
        return _wrap(width, height, np.concatenate([head, _coded(table, used, inner)]))
    # one table for both codes: green's symbols stand behind the others'
    own, own_used = _bit_table(green)
    wide = max(table.shape[1], own.shape[1])
    pad = lambda x: np.pad(x, ((0, 0), (0, wide - x.shape[1])))
    table, used = np.concatenate([pad(table), pad(own)]), np.concatenate([pad(used), pad(own_used)])
    inner = rows[:, [1, 0, 2, 3]].astype(np.int64)
    inner[:, 0] += 256
    inner = inner.reshape(-1)
    stream = _coded(table, used, inner)
    ends = np.concatenate([[0], np.cumsum(used.sum(1)[inner].reshape(-1, 4).sum(1))])
    codes = [c if len(c) > 1 else dict.fromkeys(c, (0, 0)) for c in (canonical(green), canonical(distance))]
    parts, at, covered = [head], 0, 0
    for (start, n, _), (size, far) in zip(refs, tokens, strict=True):
        to = int(ends[start - covered])
        token = Writer()
        token.put(*codes[0][256 + size[0]])
        token.put(*size[1:])
        token.put(*codes[1][far[0]])
        token.put(*far[1:])
        parts += [stream[at:to], token.bits()]
        at, covered = to, covered + n
    return _wrap(width, height, np.concatenate([*parts, stream[at:]]))


def shape_of(n_bytes: int) -> tuple[int, int]:
    """Width and height that hold n_bytes (a multiple of 64) in 4-byte pixels: 16 wide as long as that fits."""
    pixels = n_bytes // 4
    width = 16 * max(1, -(-pixels // (16 * 16384)))
    return width, -(-pixels // width)


def store_text(text: str | None) -> tuple[bytes, bytes, int]:
    """(media, payload read back from it, length before padding)."""
    raw = (text or "").encode("utf-8", "replace")
    padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    width, height = shape_of(len(padded))
    samples = np.frombuffer(padded + bytes(width * height * 4 - len(padded)), np.uint8)
    media = encode_bytes(samples, width, height)
    return media, pixels_to_bytes(decode(media)[2])[: len(padded)], len(raw)


def pixels_to_bytes(px: np.ndarray) -> bytes:
    return _channels(px)[:, [2, 1, 0, 3]].tobytes()


def media_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Store each text as a lossless WebP image and read it back.

    Adds media (binary, the file), pixels (binary: red, green, blue, alpha of each pixel, read back, cut to the padded text),
    n_bytes (long, before padding), mean and spread (double) of the samples. A null text is stored like the empty one: 64 zero
    bytes. Rows are independent, equal texts give equal values; other columns pass through, columns named like the new ones are
    replaced; an empty table gives an empty table.
    """

    def work(texts: list) -> tuple:
        got = [store_text(t) for t in texts]
        arrays = [np.frombuffer(p, np.uint8) for _, p, _ in got]
        return [m for m, _, _ in got], [p for _, p, _ in got], [n for _, _, n in got], [float(a.mean()) for a in arrays], [float(a.std()) for a in arrays]

    return in_python(docs.drop("media", "pixels", "n_bytes", "mean", "spread"), [text_col], "media binary, pixels binary, n_bytes long, mean double, spread double", work)


def decode_media(files: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds width, height (int) and argb (array<long>, row by row) to files with lossless WebP bytes; null where the bytes are null or no valid file."""

    def one(data):
        try:
            return (None, None, None) if data is None else decode(bytes(data))
        except (ValueError, IndexError):
            return None, None, None

    def work(files: list) -> tuple:
        got = [one(m) for m in files]
        return [g[0] for g in got], [g[1] for g in got], [None if g[2] is None else g[2].astype(np.int64) for g in got]

    return in_python(files.drop("width", "height", "argb"), [media_col], "width int, height int, argb array<long>", work, 64)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        "n_bytes",
        F.length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("mean="), F.format_number("mean", 3), F.lit(";spread="), F.format_number("spread", 3)).alias("feature"),
    )
