"""Lossless WebP (VP8L) pictures to pixel arrays and back.

Decoding follows the published bitstream specification: RIFF container (simple or extended), prefix
codes in both forms with their run-length coded lengths, meta prefix codes, LZ77 back-references with
the two-dimensional distance map, colour cache, and the inverse of the predictor, cross-colour,
subtract-green and palette transforms. Pixels are decoded one after the other, as each prefix code
depends on what came before; the colour transforms are inverted with array operations. Each picture
is a row, so that a table needs no shuffle, and memory is that of the largest picture.

The encoder writes the same features and serves to make media columns of other tables; it doesn't
search for the smallest file.

Defined results: a null picture has null size, pixels and error; bytes that aren't a lossless WebP file, or are
cut short, have the reason in `error` and no pixels; null ids and repeated rows are decoded as any other row;
an empty table gives no rows; further columns aren't looked at. A picture of more than MAX_PIXELS pixels, which would not fit a worker
beside others (a file of a few bytes can state 2**28), has that as its `error`; the bound is a parameter.
"""

from __future__ import annotations

import heapq
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import as_array

_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_DISTANCES = sorted(((x, y) for y in range(8) for x in range(-7, 9) if (y > 0 or x > 0)), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]) > p[1], abs(p[0]), -p[0]))
MAX_PIXELS = 1 << 24


class Broken(ValueError):
    """Why a picture can't be decoded."""


# bits and prefix codes


class Bits:
    """Reads bits, the least significant first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.value, self.count = data, 0, 0, 0

    def fill(self, n: int) -> None:
        while self.count < n:
            more = self.data[self.at : self.at + 8]
            if not more:
                if self.count + 64 < n or self.at > len(self.data) + 16:
                    raise Broken("data ends early")
                self.at += 8
                self.count += 64
                continue
            self.value |= int.from_bytes(more, "little") << self.count
            self.count += 8 * len(more)
            self.at += len(more)

    def read(self, n: int) -> int:
        if self.count < n:
            self.fill(n)
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.count -= n
        return out


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code with its first bit lowest, length) of a canonical prefix code."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[s] = int(f"{code:0{n}b}"[::-1], 2), n
        code, last = code + 1, n
    return out


class Prefix:
    """Decoder of one prefix code: a table over the longest code's bits."""

    def __init__(self, lengths: list[int]) -> None:
        used = [s for s, k in enumerate(lengths) if k]
        if not used:
            raise Broken("a prefix code without symbols")
        if len(used) == 1:
            self.width, self.table = 0, [(used[0], 0)]
            return
        if sum(1 << (15 - k) for k in lengths if k) != 1 << 15:
            raise Broken("a prefix code that isn't complete")
        self.width = max(lengths)
        self.table = [(0, 0)] * (1 << self.width)
        for s, (code, n) in canonical(lengths).items():
            self.table[code :: 1 << n] = [(s, n)] * (1 << (self.width - n))

    def read(self, bits: Bits) -> int:
        if bits.count < self.width:
            bits.fill(self.width)
        s, n = self.table[bits.value & ((1 << self.width) - 1)]
        bits.value >>= n
        bits.count -= n
        return s


def _read_prefix(bits: Bits, size: int) -> Prefix:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)] + [bits.read(8) for _ in range(two)]
        for s in symbols:
            if s >= size:
                raise Broken("a symbol outside its alphabet")
            lengths[s] = 1
        return Prefix(lengths)
    of_lengths = [0] * 19
    for k in range(4 + bits.read(4)):
        of_lengths[_ORDER[k]] = bits.read(3)
    code = Prefix(of_lengths)
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, last = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
            continue
        value, n = (last, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
        if at + n > size:
            raise Broken("code lengths beyond the alphabet")
        lengths[at : at + n] = [value] * n
        at += n
    return Prefix(lengths)


def _extended(symbol: int, bits: Bits) -> int:
    """A length or distance from its prefix symbol and further bits."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


# decoding


def _pixels(bits: Bits, width: int, height: int, main: bool) -> array:
    """Entropy-coded ARGB pixels."""
    cache_bits = 0
    if bits.read(1):
        cache_bits = bits.read(4)
        if not 1 <= cache_bits <= 11:
            raise Broken("colour cache size")
    groups, shift, across = 1, 0, 0
    meta: list[int] = []  # the group of each block
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = -(-width >> shift)
        meta = [p >> 8 & 0xFFFF for p in _pixels(bits, across, -(-height >> shift), main=False)]
        groups = max(meta) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[_read_prefix(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    cache, rest = [0] * cache_size, 32 - cache_bits
    # a group whose codes have one symbol each takes no bits: its pixel fills all that it covers
    plain = [None if any(c.width for c in g[:4]) or g[0].table[0][0] > 255 else _joined([g[k].table[0][0] for k in (3, 1, 0, 2)]) for g in codes]
    total, out = width * height, array("I")
    number, known = 0, 0
    group = codes[0]
    while (at := len(out)) < total:
        if meta:
            y, x = divmod(at, width)
            number = meta[(y >> shift) * across + (x >> shift)]
            group = codes[number]
        if plain[number] is not None:
            out.extend(array("I", [plain[number]]) * (min(((x >> shift) + 1 << shift) - x, width - x) if meta else total - at))
            continue
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            length = _extended(s - 256, bits)
            code = _extended(group[4].read(bits), bits)
            if code > 120:
                distance = code - 120
            else:
                x, y = _DISTANCES[code - 1]
                distance = max(1, x + y * width)
            if distance > at or at + length > total:
                raise Broken("a back-reference outside the picture")
            if distance >= length:
                out += out[at - distance : at - distance + length]
            else:
                run = out[-distance:]
                out += (run * (length // distance + 1))[:length]
        else:
            while known < at:
                p = out[known]
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> rest] = p
                known += 1
            out.append(cache[s - 280])
        if bits.at > len(bits.data) + 16:
            raise Broken("data ends early")
    return out


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _parts(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _joined(parts: list[int]) -> int:
    return parts[0] << 24 | parts[1] << 16 | parts[2] << 8 | parts[3]


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The prediction of a pixel from its neighbours; `right` is above to the right, `corner` above to the left."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 6:
        return _average(left, corner)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(corner, top)
    if mode == 9:
        return _average(top, right)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode in (11, 12, 13):
        ls, ts, cs = _parts(left), _parts(top), _parts(corner)
        if mode == 11:
            to_left = sum(abs(t - c) for t, c in zip(ts, cs, strict=True))
            to_top = sum(abs(a - c) for a, c in zip(ls, cs, strict=True))
            return left if to_left < to_top else top
        if mode == 12:
            return _joined([_clamp(a + t - c) for a, t, c in zip(ls, ts, cs, strict=True)])
        means = _parts(_average(left, top))
        return _joined([_clamp(m + (m - c) // 2 if m >= c else m - (c - m) // 2) for m, c in zip(means, cs, strict=True)])
    return 0xFF000000


def _sum(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _difference(a: int, b: int) -> int:
    return _joined([(x - y) & 255 for x, y in zip(_parts(a), _parts(b), strict=True)])


def _neighbours(done: list[int], at: int, x: int, y: int, width: int, modes: list[int], bits: int) -> int:
    """The prediction of pixel `at` from those before it."""
    if not y:
        return done[at - 1] if x else 0xFF000000
    if not x:
        return done[at - width]
    mode = modes[(y >> bits) * -(-width >> bits) + (x >> bits)] >> 8 & 15
    return predicted(mode, done[at - 1], done[at - width], done[at - width + 1], done[at - width - 1])


def _unpredict(pixels: array, width: int, modes: array, bits: int) -> array:
    done = array("I")
    for at, p in enumerate(pixels):
        y, x = divmod(at, width)
        done.append(_sum(p, _neighbours(done, at, x, y, width, modes, bits)))
    return done


def _bytes(pixels: list[int]) -> np.ndarray:
    """Rows of blue, green, red, alpha."""
    return np.array(pixels, np.uint32).view(np.uint8).reshape(-1, 4).copy()


def _ints(channels: np.ndarray) -> array:
    return array("I", np.ascontiguousarray(channels).tobytes())


def _blocks(values: list[int], width: int, height: int, bits: int) -> np.ndarray:
    """The value of its block for each pixel, as rows of bytes."""
    grid = _bytes(values).reshape(-(-height >> bits), -(-width >> bits), 4)
    return grid[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits].reshape(-1, 4)


def _delta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.view(np.int8).astype(np.int32) * b.view(np.int8).astype(np.int32) >> 5).astype(np.uint8)


def _cross(pixels: list[int], width: int, height: int, values: list[int], bits: int, back: bool) -> list[int]:
    """Cross-colour transform of the pixels, or its inverse."""
    c, e = _bytes(pixels), _blocks(values, width, height, bits)
    green_red, green_blue, red_blue = (np.ascontiguousarray(e[:, k]) for k in range(3))
    green, red = np.ascontiguousarray(c[:, 1]), np.ascontiguousarray(c[:, 2])
    if back:
        red = red + _delta(green_red, green)
        c[:, 2] = red
        c[:, 0] += _delta(green_blue, green) + _delta(red_blue, red)
    else:
        c[:, 0] -= _delta(green_blue, green) + _delta(red_blue, red)
        c[:, 2] = red - _delta(green_red, green)
    return _ints(c)


def _palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def _unpalette(pixels: list[int], width: int, height: int, colours: list[int]) -> list[int]:
    bits = _palette_bits(len(colours))
    green = _bytes(pixels)[:, 1].reshape(height, -1)
    each = 8 >> bits
    if bits:
        index = (green[:, :, None] >> (np.arange(1 << bits, dtype=np.uint8) * each)) & ((1 << each) - 1)
        green = index.reshape(height, -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return array("I", table[green.ravel()].tobytes())


def _chunk(data: bytes) -> bytes:
    """The lossless bitstream of a file."""
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Broken("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"VP8L":
            return data[at + 8 : at + 8 + size]
        if kind in (b"VP8 ", b"ANMF"):
            raise Broken("not a lossless still picture")
        at += 8 + size + (size & 1)
    raise Broken("no lossless picture")


def decode(data: bytes, most: int = MAX_PIXELS) -> tuple[int, int, np.ndarray]:
    """Width, height and the pixels as rows of red, green, blue, alpha; a picture of more than `most` pixels is an error."""
    bits = Bits(_chunk(data))
    if bits.read(8) != 0x2F:
        raise Broken("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    if width * height > most:
        raise Broken("a picture of too many pixels")
    alpha = bits.read(1)
    if bits.read(3):
        raise Broken("unknown version")
    transforms, seen, inner = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise Broken("a transform twice")
        seen.add(kind)
        if kind < 2:
            size = bits.read(3) + 2
            transforms.append((kind, inner, size, _pixels(bits, -(-inner >> size), -(-height >> size), main=False)))
        elif kind == 2:
            transforms.append((kind, inner, 0, []))
        else:
            size = bits.read(8) + 1
            colours = np.cumsum(_bytes(_pixels(bits, size, 1, main=False)), axis=0, dtype=np.uint8)
            transforms.append((kind, inner, 0, _ints(colours)))
            inner = -(-inner >> _palette_bits(size))
    pixels = _pixels(bits, inner, height, main=True)
    if bits.at * 8 - bits.count > len(bits.data) * 8:
        raise Broken("data ends early")
    for kind, wide, size, values in reversed(transforms):
        if kind == 0:
            pixels = _unpredict(pixels, wide, values, size)
        elif kind == 1:
            pixels = _cross(pixels, wide, height, values, size, back=True)
        elif kind == 2:
            c = _bytes(pixels)
            c[:, 0] += c[:, 1]
            c[:, 2] += c[:, 1]
            pixels = _ints(c)
        else:
            pixels = _unpalette(pixels, wide, height, values)
    out = _bytes(pixels)[:, [2, 1, 0, 3]]
    if not alpha:
        out[:, 3] = 255
    return width, height, out


# encoding


class _Writer:
    def __init__(self) -> None:
        self.value, self.count = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.count
        self.count += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.count + 7) // 8, "little")


def code_lengths(counts: dict[int, int], most: int = 15) -> dict[int, int]:
    """Lengths of a Huffman code, or of a nearly even one where that is too deep."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    heap = [(n, s, (s,)) for s, n in counts.items()]
    heapq.heapify(heap)
    depth = dict.fromkeys(counts, 0)
    while len(heap) > 1:
        (a, x, p), (b, y, q) = heapq.heappop(heap), heapq.heappop(heap)
        for s in p + q:
            depth[s] += 1
        heapq.heappush(heap, (a + b, min(x, y), p + q))
    if max(depth.values()) <= most:
        return depth
    k = (len(counts) - 1).bit_length()
    short = (1 << k) - len(counts)
    return {s: k - (i < short) for i, s in enumerate(sorted(counts))}


def _put_prefix(w: _Writer, counts: dict[int, int], size: int) -> dict[int, tuple[int, int]]:
    """Writes a prefix code for the counted symbols; returns their codes."""
    symbols = sorted(counts) or [0]
    if len(symbols) <= 2 and symbols[-1] < 256:
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        w.put(symbols[0] > 1, 1)
        w.put(symbols[0], 8 if symbols[0] > 1 else 1)
        if len(symbols) == 2:
            w.put(symbols[1], 8)
            return {symbols[0]: (0, 1), symbols[1]: (1, 1)}
        return {symbols[0]: (0, 0)}
    lengths = [0] * size
    for s, n in code_lengths(counts).items():
        lengths[s] = n
    runs: list[tuple[int, int, int]] = []  # symbol, further bits, their number
    at, last = 0, 8
    while at < size:
        n = 1
        while at + n < size and lengths[at + n] == lengths[at]:
            n += 1
        if lengths[at] == 0 and n >= 3:
            n = min(n, 138)
            runs.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
        elif lengths[at] == last and n >= 3:
            n = min(n, 6)
            runs.append((16, n - 3, 2))
        else:
            n, last = 1, lengths[at] or last
            runs.append((lengths[at], 0, 0))
        at += n
    of_runs: dict[int, int] = {}
    for s, _, _ in runs:
        of_runs[s] = of_runs.get(s, 0) + 1
    own = [0] * 19
    for s, n in code_lengths(of_runs, 7).items():
        own[s] = n
    w.put(0, 1)
    w.put(15, 4)
    for s in _ORDER:
        w.put(own[s], 3)
    w.put(0, 1)
    codes = canonical(own) if len(of_runs) > 1 else {next(iter(of_runs)): (0, 0)}
    for s, more, n in runs:
        w.put(*codes[s])
        w.put(more, n)
    return canonical(lengths) if len(counts) > 1 else {symbols[0]: (0, 0)}


def _prefixed(value: int) -> tuple[int, int, int]:
    """Symbol, further bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    n = value.bit_length() - 2
    return 2 * (n + 1) + (value >> n & 1), value & ((1 << n) - 1), n


@lru_cache
def _distances(width: int) -> dict[int, int]:
    """The short code of each distance that has one."""
    return {x + y * width: k + 1 for k, (x, y) in reversed(list(enumerate(_DISTANCES))) if x + y * width >= 1}


def _put_pixels(w: _Writer, pixels: list[int], width: int, main: bool, cache_bits: int = 0, refer: bool = False, meta_bits: int = 0) -> None:
    """Writes entropy-coded pixels; with `refer` repeats become back-references, with meta_bits blocks take turns in two prefix code groups."""
    w.put(cache_bits > 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    across = -(-width >> meta_bits) if meta_bits else 0
    if main:
        w.put(meta_bits > 0, 1)
        if meta_bits:
            w.put(meta_bits - 2, 3)
            rows = -(-(len(pixels) // width) >> meta_bits)
            _put_pixels(w, [0xFF000000 | (k % 2) << 8 for k in range(across * rows)], across, main=False)
    cache: dict[int, int] = {}
    seen: dict[tuple[int, int, int], int] = {}
    words: list[tuple[int, list[tuple[int, int, int, int]]]] = []  # group; (alphabet, symbol, further bits, their number)
    distances = _distances(width)
    at = 0
    while at < len(pixels):
        y, x = divmod(at, width)
        group = ((y >> meta_bits) * across + (x >> meta_bits)) % 2 if meta_bits else 0
        n = 1
        if refer and (from_ := seen.get(tuple(pixels[at : at + 3]))) is not None and at + 3 <= len(pixels):
            n = 3
            while at + n < len(pixels) and n < 4096 and pixels[from_ + n] == pixels[at + n]:
                n += 1
            s, more, k = _prefixed(n)
            d = at - from_
            t, other, j = _prefixed(distances.get(d, d + 120))
            words.append((group, [(0, 256 + s, more, k), (4, t, other, j)]))
        else:
            p = pixels[at]
            slot = (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            if cache_bits and cache.get(slot) == p:
                words.append((group, [(0, 280 + slot, 0, 0)]))
            else:
                a, r, g, b = _parts(p)
                words.append((group, [(0, g, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)]))
        for k in range(at, at + n):
            if cache_bits:
                cache[(0x1E35A7BD * pixels[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]
            if refer and k + 3 <= len(pixels):
                seen[tuple(pixels[k : k + 3])] = k
        at += n
    codes = []
    for g in range(2 if meta_bits and across * -(-(len(pixels) // width) >> meta_bits) > 1 else 1):
        counts: list[dict[int, int]] = [{} for _ in range(5)]
        for group, parts in words:
            if group == g:
                for alphabet, s, _, _ in parts:
                    counts[alphabet][s] = counts[alphabet].get(s, 0) + 1
        sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        codes.append([_put_prefix(w, c, n) for c, n in zip(counts, sizes, strict=True)])
    for group, parts in words:
        for alphabet, s, more, n in parts:
            w.put(*codes[group][alphabet][s])
            w.put(more, n)


def encode(rgba: np.ndarray, width: int, transforms: tuple[str, ...] = (), cache_bits: int = 0, refer: bool = False, meta_bits: int = 0) -> bytes:
    """A lossless WebP file of rows of red, green, blue, alpha, with the transforms named (predict, cross, green, palette), in this order."""
    height = len(rgba) // width
    pixels = _ints(rgba[:, [2, 1, 0, 3]].astype(np.uint8))
    w = _Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    inner = width
    for name in transforms:
        w.put(1, 1)
        w.put(("predict", "cross", "green", "palette").index(name), 2)
        if name in ("predict", "cross"):
            w.put(0, 3)
            blocks = -(-inner >> 2) * -(-height >> 2)
            if name == "predict":
                values = [0xFF000000 | (k % 14) << 8 for k in range(blocks)]
                pixels = [_difference(p, _neighbours(pixels, at, at % inner, at // inner, inner, values, 2)) for at, p in enumerate(pixels)]
            else:
                values = [0xFF000000 | (k * 37 & 255) << 16 | (k * 91 + 200 & 255) << 8 | (k * 53 + 17 & 255) for k in range(blocks)]
                pixels = _cross(pixels, inner, height, values, 2, back=False)
            _put_pixels(w, values, -(-inner >> 2), main=False)
        elif name == "green":
            c = _bytes(pixels)
            c[:, 0] -= c[:, 1]
            c[:, 2] -= c[:, 1]
            pixels = _ints(c)
        else:
            colours = sorted(set(pixels))
            w.put(len(colours) - 1, 8)
            c = _bytes(colours)
            c[1:] -= c[:-1].copy()
            _put_pixels(w, _ints(c), len(colours), main=False)
            bits = _palette_bits(len(colours))
            place = {p: k for k, p in enumerate(colours)}
            across = -(-inner >> bits)
            packed = [0] * (across * height)
            for at, p in enumerate(pixels):
                y, x = divmod(at, inner)
                packed[y * across + (x >> bits)] |= place[p] << ((x & ((1 << bits) - 1)) * (8 >> bits))
            pixels, inner = [0xFF000000 | v << 8 for v in packed], across
    w.put(0, 1)
    _put_pixels(w, pixels, inner, True, cache_bits, refer, meta_bits)
    body = w.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


# tables

#: What the pictures of `drawn` are encoded with, in turn.
_STYLES = (
    {"transforms": ("predict", "green")},
    {"transforms": ("cross", "predict"), "cache_bits": 4},
    {"transforms": ("palette",)},
    {"transforms": ("green",), "refer": True, "meta_bits": 2},
    {"refer": True, "cache_bits": 6},
)


def drawn(embeddings: DataFrame) -> DataFrame:
    """(vec_id, picture): a lossless WebP of each vector, eight pixels wide.

    A value v is a level l = floor((v + 1) * 127.5) within 0..255 and a pixel of red l, green 255 - l,
    blue (l + position) mod 256 and full alpha; a null value is 0. Null and empty vectors have no picture.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[bytes | None] = []
            for k, values in enumerate(as_array(batch.column(1)).to_pylist()):
                if not values:
                    made.append(None)
                    continue
                v = np.array([0.0 if x is None else x for x in values])
                level = np.clip(np.floor((np.nan_to_num(v) + 1) * 127.5), 0, 255).astype(np.int64)
                pixels = np.stack([level, 255 - level, (level + np.arange(len(level))) % 256, np.full(len(level), 255)], axis=1)
                width = min(8, len(level))
                pixels = np.concatenate([pixels, np.zeros((-len(level) % width, 4), np.int64)])
                made.append(encode(pixels, width, **_STYLES[(batch.column(0)[k].as_py() or 0) % len(_STYLES)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["vec_id", "picture"])

    return embeddings.select("vec_id", "embedding").mapInArrow(run, "vec_id long, picture binary")


def decoded(media: DataFrame, key: str = "vec_id", column: str = "picture", most: int = MAX_PIXELS) -> DataFrame:
    """(key, width, height, pixels, error) of every row; pixels are red, green, blue, alpha of each, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                try:
                    rows.append((*decode(x.as_py(), most), None) if x.is_valid else (None, None, None, None))
                except Broken as e:
                    rows.append((None, None, None, str(e)))
            lists = pa.array([None if r[2] is None else r[2].ravel().astype(np.int32) for r in rows], pa.list_(pa.int32()))
            columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), lists, pa.array([r[3] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "width", "height", "pixels", "error"])

    return media.select(media[f"`{key}`"].cast("long").alias(key), media[f"`{column}`"].alias(column)).mapInArrow(run, f"`{key}` long, width int, height int, pixels array<int>, error string")


#: What the pictures of embeddings decode to.
SQL = """
SELECT vec_id, 8::INT AS width, (len(embedding) // 8)::INT AS height,
  flatten(list_transform(embedding, lambda v, i: [l(v), 255 - l(v), (l(v) + i - 1) % 256, 255])) AS pixels, NULL::VARCHAR AS error
FROM embeddings
""".replace("l(v)", "greatest(0, least(255, floor((v::DOUBLE + 1) * 127.5)))::INT")
