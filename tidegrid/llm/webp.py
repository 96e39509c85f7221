"""Lossless WebP media columns: an encoder, a full decoder (VP8L, RFC 9649) and Spark operators around them.

The decoder reads prefix codes (simple and normal), meta prefix images, back-references and the colour cache,
and inverts the predictor, cross-colour, subtract-green and palette transforms into an ARGB pixel array. Bit
windows and code look-ups are worked out for all bit positions at once; where only the green code takes bits
(any palette image), literals are then a chain of jumps, and back-references are handled one by one.

A payload is stored as rows of 64 grey samples, at most 16384 rows to an image; a longer payload is several
images on end, each with its own RIFF size. The encoder writes a palette for 16 values or fewer, else
subtracts green, and back-references for lines that were seen before and for the padding, in canonical codes; options for the other features serve tests and
other callers.

Nulls: a null text is an empty one; its payload is 64 zero bytes. Repeated rows give repeated, equal results;
equal texts give equal media. Memory is bounded by one text and one image at a time. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import lean, ship, stage

WIDTH, MAX_ROWS = 64, 16384
# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
#: The 120 short distances: (dx, dy) in rising distance, then |dx|, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Huffman code lengths of at most limit bits; 0 for unused symbols."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts).tolist()
    if len(used) == 1:
        out[used[0]] = 1
    if len(used) < 2:
        return out
    weights = counts[used].tolist()
    while True:
        n = len(used)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = [0] * (2 * n - 1)
        for k in range(n, 2 * n - 1):
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = k
            heapq.heapreplace(heap, (a + b, k))
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= limit:
            out[used] = depth[:n]
            return out
        weights = [(w + 1) // 2 for w in weights]


def _reversal(bits: int) -> np.ndarray:
    """Every number below 2**bits with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


REVERSAL = [_reversal(k) for k in range(16)]


def _reversed_bits(code: np.ndarray, length: np.ndarray) -> np.ndarray:
    return REVERSAL[15][code] >> (15 - length)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, bit-reversed for a stream that is read from its low bits."""
    per = np.bincount(lengths, minlength=16)
    per[0] = 0
    first = np.zeros(17, np.int64)
    for k in range(1, 16):
        first[k] = (first[k - 1] + per[k - 1]) << 1
    codes = np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    sizes = lengths[order]
    starts = np.searchsorted(sizes, np.arange(17))
    codes[order] = first[sizes] + np.arange(len(order)) - starts[sizes]
    return _reversed_bits(codes, lengths)


class Code:
    """Decoding table: symbol and length for every window of bits."""

    __slots__ = ("bits", "symbol", "length", "only")

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.only = int(used[0]) if len(used) == 1 else None
        if len(used) < 2:
            self.bits, self.only = 0, int(used[0]) if len(used) else 0
            self.symbol, self.length = np.array([self.only]), np.zeros(1, np.int64)
            return
        self.bits = int(lengths.max())
        if (np.left_shift(1, self.bits - lengths[used])).sum() != 1 << self.bits:
            raise ValueError("prefix code is not complete")
        order = used[np.argsort(lengths[used], kind="stable")]
        spans = np.left_shift(1, self.bits - lengths[order])
        back = REVERSAL[self.bits]
        self.symbol = np.repeat(order, spans).astype(np.int16)[back]
        self.length = np.repeat(lengths[order], spans).astype(np.uint8)[back]


# ---------------------------------------------------------------- decoder


class _Bits:
    def __init__(self, data: bytes):
        raw = np.zeros(len(data) + 8, np.uint8)
        raw[: len(data)] = np.frombuffer(data, np.uint8)
        b = raw.astype(np.uint32)
        words = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
        #: 24 or more bits from each bit position on
        self.window = (words[:, None] >> np.arange(8, dtype=np.uint32)[None, :]).ravel()
        self.at = 0

    def read(self, n: int) -> int:
        out = 0
        for k in range(0, n, 16):
            m = min(16, n - k)
            out |= (int(self.window[self.at]) & ((1 << m) - 1)) << k
            self.at += m
        return out

    def symbol(self, code: Code) -> int:
        if not code.bits:
            return code.only
        w = int(self.window[self.at]) & ((1 << code.bits) - 1)
        self.at += int(code.length[w])
        return int(code.symbol[w])


def _read_code(bits: _Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    first = np.zeros(19, np.int64)
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        first[k] = bits.read(3)
    inner = Code(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    # A code's description is short: its windows as plain numbers.
    start, at, last, pos = bits.at, 0, 8, 0
    window = bits.window[start : start + 14 * size].tolist()
    symbol, length, mask = inner.symbol.tolist(), inner.length.tolist(), (1 << inner.bits) - 1
    found = [0] * size
    while at < size and left:
        left -= 1
        w = window[pos] & mask
        s = symbol[w]
        pos += length[w]
        if s < 16:
            found[at] = s
            last = s or last
            at += 1
        else:
            few, base = ((2, 3), (3, 3), (7, 11))[s - 16]
            n = base + (window[pos] & ((1 << few) - 1))
            pos += few
            if s == 16:
                found[at : at + n] = [last] * n
            at += n
    bits.at = start + pos
    return Code(np.array(found[:size], np.int64))


def _extended(bits: _Bits, code: int) -> int:
    """A length or distance from its prefix code and extra bits."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _pixels(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded image: ARGB as uint32, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    meta, meta_bits, groups = None, 0, 1
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        across = _blocks(width, meta_bits)
        meta = (_pixels(bits, across, _blocks(height, meta_bits), False) >> np.uint32(8)) & np.uint32(0xFFFF)
        meta = meta.reshape(-1, across)
        groups = int(meta.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_code(bits, s) for s in sizes] for _ in range(groups)]
    n = width * height
    if meta is None and not cache_bits and not any(c.bits for c in codes[0][1:4]):
        return _green_only(bits, codes[0], width, n)
    out, done, cache = [0] * n, 0, [0] * (1 << cache_bits) if cache_bits else None
    while done < n:
        group = codes[0] if meta is None else codes[int(meta[(done // width) >> meta_bits, (done % width) >> meta_bits])]
        s = bits.symbol(group[0])
        if s < 256:
            r, b, a = bits.symbol(group[1]), bits.symbol(group[2]), bits.symbol(group[3])
            fresh = [a << 24 | r << 16 | s << 8 | b]
        elif s < 280:
            length = _extended(bits, s - 256)
            back = _distance(_extended(bits, bits.symbol(group[4])), width)
            if back > done:
                raise ValueError("a back-reference reaches before the image")
            fresh = []
            for k in range(min(length, n - done)):
                out[done + k] = out[done + k - back]
            fresh = out[done : done + min(length, n - done)]
        else:
            fresh = [cache[s - 280]]
        for p in fresh:
            out[done] = p
            done += 1
            if cache_bits:
                cache[(p * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(out, np.uint32)


def _green_only(bits: _Bits, group: list[Code], width: int, n: int) -> np.ndarray:
    """Pixels where literals take bits for green alone: jumps over all bit positions at once."""
    green = group[0]
    rest = np.uint32(group[3].only << 24 | group[1].only << 16 | group[2].only)
    if not green.bits and green.only < 256:
        return np.full(n, rest | np.uint32(green.only << 8), np.uint32)
    w = bits.window & np.uint32((1 << green.bits) - 1)
    symbol, length = green.symbol[w], green.length[w]
    stop = len(w)  # where a jump leads that starts at no literal
    one = np.append(np.arange(stop, dtype=np.int32) + length, np.int32(stop))
    one[:stop][(symbol >= 256) | (one[:stop] > stop)] = stop
    two = one[one]
    four = two[two]
    step, leap = memoryview(one), memoryview(four)
    out = np.empty(n, np.uint32)
    at, done = bits.at, 0
    while done < n:
        leaps, places, room = [], [], n - done
        while room >= 4 and (to := leap[at]) != stop:
            leaps.append(at)
            at = to
            room -= 4
        while room and (to := step[at]) != stop:
            places.append(at)
            at = to
            room -= 1
        if leaps or places:
            a = np.array(leaps, np.int64)
            b = two[a]
            seen = np.concatenate([np.stack([a, one[a], b, one[b]], 1).ravel(), np.array(places, np.int64)])
            out[done : done + len(seen)] = symbol[seen].astype(np.uint32) << np.uint32(8) | rest
            done += len(seen)
        if done < n:
            bits.at = at + int(length[at])
            size = min(_extended(bits, int(symbol[at]) - 256), n - done)
            back = _distance(_extended(bits, bits.symbol(group[4])), width)
            if back > done:
                raise ValueError("a back-reference reaches before the image")
            if back >= size:
                out[done : done + size] = out[done - back : done - back + size]
            else:
                out[done : done + size] = np.resize(out[done - back : done], size)
            done += size
            at = bits.at
    bits.at = at
    return out


def _channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4) bytes in the order blue, green, red, alpha."""
    return argb.astype("<u4").view(np.uint8).reshape(*argb.shape, 4)


def _predicted(mode: int, left, top, top_right, top_left):
    """The prediction of a mode, per channel in int arrays; left may be None for modes without it."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode == 6:
        return mean(left, top_left)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(top_left, top)
    if mode == 9:
        return mean(top, top_right)
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        to_left = np.abs(top - top_left).sum(-1, keepdims=True)
        to_top = np.abs(left - top_left).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        m = mean(left, top)
        return np.clip(m + _toward_zero_half(m - top_left), 0, 255)
    return np.array([0, 0, 0, 255])


def _toward_zero_half(d):
    return np.where(d < 0, -((-d) >> 1), d >> 1)


def _unpredict(argb: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    """Inverts the predictor transform. Only modes that use the left pixel go pixel by pixel."""
    h, w = argb.shape
    out = _channels(argb).astype(np.int64)
    out[0, 0] = (out[0, 0] + [0, 0, 0, 255]) & 255
    out[0] = np.cumsum(out[0], 0) & 255
    for y in range(1, h):
        row, above = out[y], out[y - 1]
        row[0] = (row[0] + above[0]) & 255
        kinds = modes[y >> size_bits]
        x = 1
        while x < w:
            mode = int(kinds[x >> size_bits])
            end = min(w, ((x >> size_bits) + 1) << size_bits)
            if mode == 1:
                row[x:end] = (row[x - 1] + np.cumsum(row[x:end], 0)) & 255
            elif mode in (0, 2, 3, 4, 8, 9) or mode > 13:
                right = np.concatenate([above[x + 1 : end + 1], row[:1]])[: end - x] if end == w else above[x + 1 : end + 1]
                row[x:end] = (row[x:end] + _predicted(mode, None, above[x:end], right, above[x - 1 : end - 1])) & 255
            else:
                for k in range(x, end):
                    right = above[k + 1] if k + 1 < w else row[0]
                    row[k] = (row[k] + _predicted(mode, row[k - 1], above[k], right, above[k - 1])) & 255
            x = end
    return np.ascontiguousarray(out.astype(np.uint8)).view("<u4").reshape(h, w).astype(np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).astype(np.int8).astype(np.int64)


def _cross(argb: np.ndarray, factors: np.ndarray, size_bits: int, sign: int) -> np.ndarray:
    """Adds (sign 1, the inverse transform) or takes away what colours predict of each other, by blocks' factors."""
    h, w = argb.shape
    f = _channels(factors)[np.arange(h)[:, None] >> size_bits, np.arange(w)[None, :] >> size_bits]
    green_to_red, green_to_blue, red_to_blue = _signed(f[..., 0]), _signed(f[..., 1]), _signed(f[..., 2])
    p = _channels(argb).astype(np.int64)
    green, old_red = _signed(p[..., 1]), p[..., 2].copy()
    red = (old_red + sign * ((green_to_red * green) >> 5)) & 255
    blue = (p[..., 0] + sign * ((green_to_blue * green) >> 5) + sign * ((red_to_blue * _signed(red if sign > 0 else old_red)) >> 5)) & 255
    p[..., 2], p[..., 0] = red, blue
    return np.ascontiguousarray(p.astype(np.uint8)).view("<u4").reshape(h, w).astype(np.uint32)


def _blocks(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def decode_image(data: bytes) -> np.ndarray:
    """ARGB pixels (height, width; uint32) of one lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP image")
    bits = _Bits(data[21 : 20 + struct.unpack_from("<I", data, 16)[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, w = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            size_bits = bits.read(3) + 2
            block = _pixels(bits, _blocks(w, size_bits), _blocks(height, size_bits), False).reshape(_blocks(height, size_bits), -1)
            undo.append((kind, size_bits, block))
        elif kind == 2:
            undo.append((2, 0, None))
        else:
            n = bits.read(8) + 1
            deltas = _channels(_pixels(bits, n, 1, False))
            colours = np.ascontiguousarray(np.cumsum(deltas, 0, dtype=np.int64).astype(np.uint8)).view("<u4").ravel().astype(np.uint32)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((3, pack, (colours, w)))
            w = _blocks(w, pack)
    image = _pixels(bits, w, height, True).reshape(height, w)
    for kind, size_bits, extra in reversed(undo):
        if kind == 0:
            image = _unpredict(image, (extra >> np.uint32(8)) & np.uint32(15), size_bits)
        elif kind == 1:
            image = _cross(image, extra, size_bits, 1)
        elif kind == 2:
            green = (image >> np.uint32(8)) & np.uint32(255)
            image = (image & np.uint32(0xFF00FF00)) | ((image & np.uint32(0x00FF00FF)) + (green << np.uint32(16) | green)) & np.uint32(0x00FF00FF)
        else:
            colours, wide = extra
            index = (image >> np.uint32(8)) & np.uint32(255)
            if size_bits:
                per, each = 1 << size_bits, 8 >> size_bits
                index = ((index[:, :, None] >> (np.arange(per, dtype=np.uint32) * np.uint32(each))) & np.uint32((1 << each) - 1)).reshape(height, -1)[:, :wide]
            image = np.append(colours, np.zeros(256, np.uint32))[index]
    return image


# ---------------------------------------------------------------- encoder


class _Writer:
    """Bits in the order they are put: single numbers gather in one large number, arrays are spread by numpy."""

    def __init__(self):
        self.parts, self.head, self.size = [], 0, 0

    def put(self, value: int, size: int) -> None:
        self.head |= value << self.size
        self.size += size

    def _close(self) -> None:
        if self.size:
            raw = np.frombuffer(self.head.to_bytes((self.size + 7) // 8, "little"), np.uint8)
            self.parts.append(np.unpackbits(raw, bitorder="little")[: self.size])
            self.head = self.size = 0

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._close()
        values, sizes = values.astype(np.int32), sizes.astype(np.int32)
        ends = np.cumsum(sizes, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        place = np.arange(total, dtype=np.int32) - np.repeat(ends - sizes, sizes)
        self.parts.append((np.right_shift(np.repeat(values, sizes), place) & 1).astype(np.uint8))

    def data(self) -> bytes:
        self._close()
        return np.packbits(np.concatenate(self.parts or [np.empty(0, np.uint8)]), bitorder="little").tobytes()


def _put_code(out: _Writer, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes a prefix code; gives (codes, lengths) to write symbols with."""
    used = np.flatnonzero(lengths)
    if len(used) < 2 and (not len(used) or used[0] < 256):
        s = int(used[0]) if len(used) else 0
        out.put(1 | (0 << 1) | (1 << 2) | (s << 3), 11)
        return np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    runs, at, n = [], 0, len(lengths)
    plain = lengths.tolist()
    while at < n:
        if plain[at]:
            runs.append((plain[at], 0, 0))
            at += 1
            continue
        end = at
        while end < n and not plain[end]:
            end += 1
        zeros = end - at
        while zeros:
            if zeros < 3:
                runs.append((0, 0, 0))
                zeros -= 1
            elif zeros < 11:
                runs.append((17, zeros - 3, 3))
                zeros = 0
            else:
                k = min(zeros, 138)
                runs.append((18, k - 11, 7))
                zeros -= k
        at = end
    inner = code_lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
    out.put(0, 1)
    out.put(15, 4)
    for k in LENGTH_ORDER:
        out.put(int(inner[k]), 3)
    out.put(0, 1)
    codes = canonical(inner)
    single = (inner > 0).sum() == 1
    for s, extra, size in runs:
        if not single:
            out.put(int(codes[s]), int(inner[s]))
        if size:
            out.put(extra, size)
    if len(used) == 1:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    return canonical(lengths), lengths


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix code, extra bits' value, their number) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = (v >> (top - 1)) & 1
    return 2 * top + second, v - ((2 + second) << (top - 1)), top - 1


def _put_pixels(out: _Writer, argb: np.ndarray, main: bool, copies: list[tuple[int, int, int]] = (), cache_bits: int = 0) -> None:
    """Writes an entropy-coded image. copies: (place, length, distance) in rising, disjoint places."""
    flat = argb.ravel()
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    literal = np.ones(len(flat), bool)
    tokens, spans = [], []
    for place, length, back in copies:
        for k in range(0, length, 4096):
            m = min(4096, length - k)
            tokens.append((place + k, _prefix(m), _prefix(back + 120)))
            spans.append(m)
        literal[place : place + length] = False
    hits = np.full(len(flat), -1)
    if cache_bits:
        cache: dict[int, int] = {}
        for i, p in enumerate(flat.tolist()):
            slot = (p * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)
            if literal[i] and cache.get(slot) == p:
                hits[i] = slot
            cache[slot] = p
    lit = np.flatnonzero(literal & (hits < 0))
    ref = np.flatnonzero(literal & (hits >= 0))
    parts = _channels(flat[lit])
    size = 280 + (1 << cache_bits if cache_bits else 0)
    green = np.bincount(parts[:, 1], minlength=size)
    green += np.bincount(hits[ref] + 280, minlength=size)
    green += np.bincount(np.array([256 + t[1][0] for t in tokens], np.int64), minlength=size)
    far = np.bincount(np.array([t[2][0] for t in tokens], np.int64), minlength=40)
    g, r, b, a, d = (_put_code(out, code_lengths(c)) for c in (green, np.bincount(parts[:, 2], minlength=256), np.bincount(parts[:, 0], minlength=256), np.bincount(parts[:, 3], minlength=256), far))
    if not len(ref) and not (r[1].any() or b[1].any() or a[1].any()):
        own = _channels(flat)[:, 1]
        values, sizes, pieces, at = g[0][own], g[1][own], [], 0
        for (place, (lc, le, ln), (dc, de, dn)), length in zip(tokens, spans, strict=True):
            pieces += [(values[at:place], sizes[at:place]), (np.array([g[0][256 + lc], le, d[0][dc], de]), np.array([g[1][256 + lc], ln, d[1][dc], dn]))]
            at = place + length
        pieces.append((values[at:], sizes[at:]))
        out.many(np.concatenate([v for v, _ in pieces]), np.concatenate([z for _, z in pieces]))
        return
    # One row of four slots per literal or cache token, and of four per copy; then all in order of place.
    values = np.zeros((len(lit) + len(ref) + len(tokens), 4), np.int64)
    sizes = np.zeros_like(values)
    for k, (code, channel) in enumerate(((g, 1), (r, 2), (b, 0), (a, 3))):
        values[: len(lit), k], sizes[: len(lit), k] = code[0][parts[:, channel]], code[1][parts[:, channel]]
    at = len(lit)
    values[at : at + len(ref), 0], sizes[at : at + len(ref), 0] = g[0][hits[ref] + 280], g[1][hits[ref] + 280]
    at += len(ref)
    for k, (_, (lc, le, ln), (dc, de, dn)) in enumerate(tokens):
        values[at + k] = g[0][256 + lc], le, d[0][dc], de
        sizes[at + k] = g[1][256 + lc], ln, d[1][dc], dn
    if len(ref) or tokens:
        order = np.argsort(np.concatenate([lit, ref, np.array([t[0] for t in tokens], np.int64)]), kind="stable")
        values, sizes = values[order], sizes[order]
    out.many(values.ravel(), sizes.ravel())


def encode_image(argb: np.ndarray, palette: bool = True, copies=(), cache_bits: int = 0, predictor: int | None = None, cross: tuple[int, int, int] | None = None, subtract_green: bool = False, size_bits: int = 3) -> bytes:
    """One lossless WebP file of (height, width) ARGB pixels. copies count places in the coded image's pixels."""
    h, w = argb.shape
    out = _Writer()
    out.put((w - 1) | (h - 1) << 14, 28)
    out.put(0 if (argb >> np.uint32(24) == 255).all() else 1, 1)
    out.put(0, 3)
    image = argb.astype(np.uint32)
    colours = np.unique(image) if palette else np.empty(0)
    if 0 < len(colours) <= 256:
        out.put(1 | 3 << 1 | (len(colours) - 1) << 3, 11)
        deltas = np.diff(_channels(colours), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
        _put_pixels(out, np.ascontiguousarray(deltas).view("<u4").reshape(1, -1).astype(np.uint32), False)
        index = np.searchsorted(colours, image).astype(np.uint32)
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        if pack:
            per, each = 1 << pack, 8 >> pack
            index = np.pad(index, ((0, 0), (0, -w % per))).reshape(h, -1, per)
            index = (index << (np.arange(per, dtype=np.uint32) * np.uint32(each))).sum(-1).astype(np.uint32)
            copies = ()  # places of whole pixels no longer hold
        image = index << np.uint32(8) | np.uint32(0xFF000000)
    else:
        if cross is not None:
            out.put(1 | 1 << 1 | (size_bits - 2) << 3, 6)
            block = np.full((_blocks(h, size_bits), _blocks(w, size_bits)), 0xFF000000 | (cross[2] & 255) << 16 | (cross[1] & 255) << 8 | cross[0] & 255, np.uint32)
            _put_pixels(out, block, False)
            image = _cross(image, block, size_bits, -1)
        if subtract_green:
            out.put(1 | 2 << 1, 3)
            green = (image >> np.uint32(8)) & np.uint32(255)
            image = (image & np.uint32(0xFF00FF00)) | ((image | np.uint32(0xFF00FF00)) - (green << np.uint32(16) | green)) & np.uint32(0x00FF00FF)
        if predictor is not None:
            out.put(1 | 0 << 1 | (size_bits - 2) << 3, 6)
            _put_pixels(out, np.full((_blocks(h, size_bits), _blocks(w, size_bits)), 0xFF000000 | predictor << 8, np.uint32), False)
            p = _channels(image).astype(np.int64)
            left = np.roll(p, 1, 1)
            top, top_left = np.roll(p, 1, 0), np.roll(left, 1, 0)
            right = np.roll(top, -1, 1)
            right[:, -1] = p[:, 0]
            guess = np.broadcast_to(_predicted(predictor, left, top, right, top_left), p.shape).copy()
            guess[0], guess[1:, 0] = left[0], top[1:, 0]
            guess[0, 0] = [0, 0, 0, 255]
            image = np.ascontiguousarray(((p - guess) & 255).astype(np.uint8)).view("<u4").reshape(h, w).astype(np.uint32)
    out.put(0, 1)
    _put_pixels(out, image, True, copies, cache_bits)
    body = b"\x2f" + out.data()
    chunk = struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 8 + len(chunk)) + b"WEBPVP8L" + chunk


def repeats(payload: bytes, n: int, shortest: int = 24) -> list[tuple[int, int, int]]:
    """Copies in a payload of n bytes before its padding: lines seen before, and the padding's zeros."""
    out, seen, at = [], {}, 0
    for line in payload[:n].split(b"\n"):
        if len(line) >= shortest:
            before = seen.get(line)
            if before is None:
                seen[line] = at
            else:
                out.append((at, len(line), at - before))
        at += len(line) + 1
    if len(payload) - n > 4:
        out.append((n + 1, len(payload) - n - 1, 1))
    return out


def encode_payload(payload: bytes, n: int | None = None) -> bytes:
    """Grey images of rows of 64 samples, one after the other. The payload's length is a multiple of 64."""
    n, out, most = len(payload) if n is None else n, [], WIDTH * MAX_ROWS
    for k in range(0, len(payload), most):
        part = payload[k : k + most]
        grey = np.frombuffer(part, np.uint8).astype(np.uint32).reshape(-1, WIDTH)
        argb = grey * np.uint32(0x010101) | np.uint32(0xFF000000)
        few = len(np.flatnonzero(np.bincount(grey.ravel(), minlength=256))) <= 16  # a palette packs pixels then; else grey is coded as green
        out.append(encode_image(argb, palette=few, subtract_green=not few, copies=repeats(part, max(0, min(len(part), n - k)))))
    return b"".join(out)


def decode_payload(media: bytes) -> bytes:
    """The samples of all images in turn."""
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(((decode_image(media[at : at + size]) >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).tobytes())
        at += size
    return b"".join(out)


def features(samples: bytes) -> str:
    """Rows, distinct values, mean, deviation and entropy of the samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    p = counts[counts > 0] / max(1, len(samples))
    values = np.flatnonzero(counts)
    mean = float((values * p).sum()) if len(p) else 0.0
    deviation = float(np.sqrt(((values - mean) ** 2 * p).sum())) if len(p) else 0.0
    entropy = float(-(p * np.log2(p)).sum()) + 0.0
    return f"rows={len(samples) // WIDTH};distinct={len(p)};mean={mean:.4f};sd={deviation:.4f};entropy={entropy:.4f}"


# ---------------------------------------------------------------- operators


def _mapped(docs: DataFrame, column: str, added: list[tuple[str, T.DataType]], work) -> DataFrame:
    """docs without column, plus what work(value) gives for it."""
    ship(docs.sparkSession)
    at = docs.columns.index(column)
    kept = [f for f in docs.schema.fields if f.name != column and f.name not in {n for n, _ in added}]
    places = [docs.columns.index(f.name) for f in kept]
    types = [T.StructField(n, t) for n, t in added]
    arrow = [pa.int64() if isinstance(t, T.LongType) else pa.string() if isinstance(t, T.StringType) else pa.binary() for _, t in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):  # a few texts at a time
                part = b.slice(k, 128)
                made = [work(v) for v in part.column(at).to_pylist()]
                cols = [pa.array([m[i] for m in made], t) for i, t in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *cols], names=[*(f.name for f in kept), *(n for n, _ in added)])

    return docs.mapInArrow(run, T.StructType([*kept, *types]))


def to_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the text, plus n_bytes and media (binary): the whole text as lossless WebP."""

    def work(text):
        raw = (text or "").encode()
        payload = raw + b"\0" * (-len(raw) % WIDTH if raw else WIDTH)
        return len(raw), encode_payload(payload, len(raw))

    return _mapped(docs.withColumn(text_col, F.col(text_col).cast("string")), text_col, [("n_bytes", T.LongType()), ("media", T.BinaryType())], work)


def read_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The columns of media, plus samples (binary pixel array, rows of 64) and feature."""
    added = [("media", T.BinaryType()), ("samples", T.BinaryType()), ("feature", T.StringType())]

    def work(data):
        samples = decode_payload(data) if data is not None else None
        return data, samples, features(samples) if samples is not None else None

    return _mapped(media, media_col, added, work)


def tail(samples: Column, n: int = 64) -> Column:
    return F.substring(samples, -n, n)


def stored_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Media of docs, written to the shared folder and read back with samples and feature."""
    return read_media(stage(to_media(docs, text_col), "media"))
