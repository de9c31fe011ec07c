"""Lossless WebP (VP8L): a decoder of the whole format, an encoder of literals and back-references, and media columns.

The decoder reads prefix codes, back-references and the colour cache, and inverts the predictor,
cross-colour, subtract-green and palette transforms. Streams whose pixels are literals of one channel (as
the encoder writes: grey images of 8-bit samples) are decoded many at once: a step looks up 16 bits of
every stream and takes up to four samples from it. Samples that repeat themselves are written with
back-references and a code of their own, and read by the general decoder. The encoder has no use for the other
tools: text isn't smooth, so that a predictor or cross-colour lengthens it, and grey samples gain nothing from
a cache of colours.

Numbers not explained below are those of the public WebP lossless bitstream specification.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import bounded_batches, saved, table, utf8

WIDTH, MOST_ROWS = 192, 16384
#: Streams that are decoded in step; fewer are finished one by one.
IN_STEP = 24

# Fixed values of the specification: the order of code length codes, and the neighbours (x, y) of short distances.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    """Reads from the least significant bit of a byte on; beyond the end is an error."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        byte, shift = self.at >> 3, self.at & 7
        self.at += n
        if self.at > self.end:
            raise ValueError("the image ends early")
        return (int.from_bytes(self.data[byte : byte + 5], "little") >> shift) & ((1 << n) - 1)


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def canonical(lengths: list[int]) -> dict[tuple[int, int], int]:
    """(length, code with its first bit lowest) to symbol, for a complete code; {} if there is no symbol."""
    code, out = 0, {}
    for n in range(1, 16):
        for s, k in enumerate(lengths):
            if k == n:
                out[n, int(f"{code:0{n}b}"[::-1], 2)] = s
                code += 1
        code <<= 1
    if out and len(out) > 1 and sum(2.0**-n for n, _ in out) != 1:
        raise ValueError("a prefix code is not complete")
    return out


class Code:
    """A prefix code; a single symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        self.lengths = lengths
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else None
        if not used:
            self.only = 0
        if self.only is None:
            codes = canonical(lengths)
            self.bits = max(n for n, _ in codes)
            self.table = [None] * (1 << self.bits)
            for (n, c), s in codes.items():
                for high in range(1 << (self.bits - n)):
                    self.table[high << n | c] = (s, n)

    def read(self, b: Bits) -> int:
        if self.only is not None:
            return self.only
        byte = b.at >> 3
        s, n = self.table[(int.from_bytes(b.data[byte : byte + 3], "little") >> (b.at & 7)) & ((1 << self.bits) - 1)]
        b.at += n
        if b.at > b.end:
            raise ValueError("the image ends early")
        return s


def _read_code(b: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if b.read(1):
        two, wide = b.read(1), b.read(1)
        symbols = [b.read(8 if wide else 1)]
        if two:
            symbols.append(b.read(8))
        for s in symbols:
            if s >= alphabet:
                raise ValueError("a symbol is not in its alphabet")
            lengths[s] = 1
        return Code(lengths)
    kinds = [0] * 19
    for i in range(4 + b.read(4)):
        kinds[LENGTH_ORDER[i]] = b.read(3)
    code = Code(kinds)
    tokens = alphabet if not b.read(1) else 2 + b.read(2 + 2 * b.read(3))
    at, before = 0, 8
    while at < alphabet and tokens:
        tokens -= 1
        k = code.read(b)
        if k < 16:
            lengths[at] = k
            at += 1
            before = k or before
        else:
            n = 3 + b.read(2) if k == 16 else 3 + b.read(3) if k == 17 else 11 + b.read(7)
            if at + n > alphabet:
                raise ValueError("a run of code lengths is too long")
            lengths[at : at + n] = [before if k == 16 else 0] * n
            at += n
    return Code(lengths)


def _value(code: int, b: Bits) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + b.read(extra) + 1


def _ceil(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _pixels(b: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as (height * width) ARGB numbers."""
    cache_bits = b.read(4) if b.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    meta, meta_bits, groups = None, 0, 1
    if main and b.read(1):
        meta_bits = b.read(3) + 2
        meta = ((_pixels(b, _ceil(width, meta_bits), _ceil(height, meta_bits), False) >> 8) & 0xFFFF).tolist()
        groups = max(meta) + 1
    cache = [0] * (1 << cache_bits) if cache_bits else None
    codes = [[_read_code(b, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    across = _ceil(width, meta_bits) if meta else 0
    out, total, i = [0] * (width * height), width * height, 0
    green, red, blue, alpha, distance = codes[0]
    while i < total:
        if meta:
            green, red, blue, alpha, distance = codes[meta[(i // width >> meta_bits) * across + (i % width >> meta_bits)]]
        s = green.read(b)
        if s < 256:
            r = red.read(b)
            p = s << 8 | r << 16 | blue.read(b) | alpha.read(b) << 24
            out[i] = p
            i += 1
            if cache:
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        elif s < 280:
            n = _value(s - 256, b)
            d = _value(distance.read(b), b)
            if d > 120:
                d -= 120
            else:
                x, y = NEIGHBOURS[d - 1]
                d = max(1, x + y * width)
            if d > i or n > total - i:
                raise ValueError("a back-reference leaves the image")
            for _ in range(n):
                p = out[i] = out[i - d]
                i += 1
                if cache:
                    cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        else:
            if not cache or s - 280 >= len(cache):
                raise ValueError("a colour is not in the cache")
            p = out[i] = cache[s - 280]
            i += 1
            cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(out, np.uint32)


def _channels(p: np.ndarray) -> np.ndarray:
    """(n, 4) as alpha, red, green, blue."""
    return np.stack([p >> s & 0xFF for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _joined(c: np.ndarray) -> np.ndarray:
    c = (c & 0xFF).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _unpredict(p: np.ndarray, width: int, height: int, bits: int, modes: np.ndarray) -> np.ndarray:
    c = _channels(p).reshape(height * width, 4).tolist()
    modes = (modes >> 8 & 15).tolist()
    across = _ceil(width, bits)
    average = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    half = lambda v: -((-v) // 2) if v < 0 else v // 2  # noqa: E731  rounds towards zero
    black = [255, 0, 0, 0]
    for i in range(height * width):
        x, y = i % width, i // width
        if not y:
            guess = c[i - 1] if x else black
        elif not x:
            guess = c[i - width]
        else:
            left, top, corner, right = c[i - 1], c[i - width], c[i - width - 1], c[i - width + 1]
            m = modes[(y >> bits) * across + (x >> bits)]
            if m == 0 or m > 13:
                guess = black
            elif m <= 4:
                guess = (left, top, right, corner)[m - 1]
            elif m == 5:
                guess = average(average(left, right), top)
            elif m <= 9:
                guess = average(*((left, corner), (left, top), (corner, top), (top, right))[m - 6])
            elif m == 10:
                guess = average(average(left, corner), average(top, right))
            elif m == 11:
                to_left = sum(abs(t - k) for t, k in zip(top, corner, strict=True))
                to_top = sum(abs(t - k) for t, k in zip(left, corner, strict=True))
                guess = left if to_left < to_top else top
            elif m == 12:
                guess = [clamp(a + t - k) for a, t, k in zip(left, top, corner, strict=True)]
            else:
                guess = [clamp(a + half(a - k)) for a, k in zip(average(left, top), corner, strict=True)]
        c[i] = [(a + g) & 255 for a, g in zip(c[i], guess, strict=True)]
    return _joined(np.array(c))


def _uncross(p: np.ndarray, width: int, height: int, bits: int, table_: np.ndarray) -> np.ndarray:
    c, t = _channels(p), _channels(table_)
    i = np.arange(width * height)
    t = t[(i // width >> bits) * _ceil(width, bits) + (i % width >> bits)]
    signed = lambda v: ((v & 0xFF) ^ 0x80) - 0x80
    delta = lambda a, b: signed(a) * signed(b) >> 5
    c[:, 1] = (c[:, 1] + delta(t[:, 3], c[:, 2])) & 0xFF
    c[:, 3] = (c[:, 3] + delta(t[:, 2], c[:, 2]) + delta(t[:, 1], c[:, 1])) & 0xFF
    return _joined(c)


def _transforms(b: Bits, width: int, height: int) -> tuple[list[tuple], int]:
    """The transforms in the order read, and the width of the coded image."""
    found, at = [], width
    while b.read(1):
        kind = b.read(2)
        if kind in (f[0] for f in found):
            raise ValueError("a transform is there twice")
        if kind < 2:
            bits = b.read(3) + 2
            found.append((kind, at, bits, _pixels(b, _ceil(at, bits), _ceil(height, bits), False)))
        elif kind == 2:
            found.append((2, at, 0, None))
        else:
            size = b.read(8) + 1
            palette = _joined(np.cumsum(_channels(_pixels(b, size, 1, False)), 0))
            bits = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            found.append((3, at, bits, palette))
            at = _ceil(at, bits)
    return found, at


def _undo(p: np.ndarray, height: int, found: list[tuple]) -> np.ndarray:
    for kind, width, bits, extra in reversed(found):
        if kind == 0:
            p = _unpredict(p, width, height, bits, extra)
        elif kind == 1:
            p = _uncross(p, width, height, bits, extra)
        elif kind == 2:
            c = _channels(p)
            c[:, 1::2] += c[:, 2:3]
            p = _joined(c)
        else:
            index = (p >> 8 & 0xFF).reshape(height, -1)
            per, x = 1 << bits, np.arange(width)
            index = index[:, x >> bits] >> ((x & (per - 1)) * (8 >> bits)).astype(np.uint32) & ((1 << (8 >> bits)) - 1) if bits else index
            p = np.where(index < len(extra), extra[np.minimum(index, len(extra) - 1)], 0).astype(np.uint32).ravel()
    return p


def decode_stream(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, ARGB numbers row by row) of a VP8L chunk's data."""
    b = Bits(data)
    if b.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = b.read(14) + 1, b.read(14) + 1
    b.read(1)
    if b.read(3):
        raise ValueError("an unknown version")
    found, coded = _transforms(b, width, height)
    return width, height, _undo(_pixels(b, coded, height, True), height, found)


def images(media: bytes) -> list[bytes]:
    """The VP8L data of the WebP files that stand in `media` one after the other."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        n = int.from_bytes(media[at + 16 : at + 20], "little")
        out.append(media[at + 20 : at + 20 + n])
        if len(out[-1]) < n:
            raise ValueError("the image ends early")
        at += 20 + n + (n & 1)
    return out


class GreyCode:
    """A prefix code of samples with the header that states it, and tables to encode and decode by."""

    def __init__(self, weights: list[float]):
        heap = [(w, i, (i,)) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        lengths = [0] * 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(lengths) > 15:
            raise ValueError("a code is longer than 15 bits")
        h = BitWriter()
        h.put(1, 1), h.put(2, 2), h.put(0, 1)  # subtract green, and no other transform
        h.put(0, 2)  # no colour cache, one group of codes
        h.put(0, 1)
        runs = _runs([*lengths, *[0] * 24])
        used = sorted({k for k, _, _ in runs})
        n = (len(used) - 1).bit_length()
        kinds = [0] * 19
        for i, k in enumerate(used):  # a complete code of n and n - 1 bits
            kinds[k] = n if i >= (1 << n) - len(used) else n - 1
        if len(used) == 1:
            kinds[used[0]] = 1
        h.put(15, 4)
        for k in LENGTH_ORDER:
            h.put(kinds[k], 3)
        h.put(0, 1)
        codes = {s: (c, n) for (n, c), s in canonical(kinds).items()} if len(used) > 1 else {used[0]: (0, 0)}
        for k, extra, width in runs:
            h.put(*codes[k])
            h.put(extra, width)
        for symbol in (0, 0, 255, 0):  # red, blue, alpha, distance
            h.put(1, 1), h.put(0, 1), h.put(1, 1), h.put(symbol, 8)
        self.header, self.header_bits = h.bytes(), h.n
        made = canonical(lengths)
        self.lengths = np.array(lengths, np.int64)
        self.codes = np.zeros(256, np.int64)
        for (_, c), s in made.items():
            self.codes[s] = c
        self.fast = FastTable(lengths)


def _runs(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Code lengths as (kind, extra bits' value, extra bits)."""
    out, i = [], 0
    while i < len(lengths):
        n = 1
        while i + n < len(lengths) and lengths[i + n] == lengths[i]:
            n += 1
        i += n
        if lengths[i - 1]:
            out.append((lengths[i - 1], 0, 0))
            n -= 1
            while n >= 3:
                k = min(n, 6)
                out.append((16, k - 3, 2))
                n -= k
        else:
            while n >= 11:
                k = min(n, 138)
                out.append((18, k - 11, 7))
                n -= k
            if n >= 3:
                out.append((17, n - 3, 3))
                n = 0
        out += [(lengths[i - 1], 0, 0)] * n
    return out


def _code_lengths(counts: list[int]) -> list[int]:
    """Lengths of at most 15 bits of a prefix code for symbols that occur so often."""
    counts = list(counts)
    while True:
        heap = [(c, s, (s,)) for s, c in enumerate(counts) if c]
        lengths = [0] * len(counts)
        for _, s, _ in heap[:1]:
            lengths[s] = int(len(heap) == 1)
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(lengths) <= 15:
            return lengths
        counts = [(c + 1) // 2 for c in counts]


def _put_code(w: BitWriter, lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Write a prefix code; returns the bits of each symbol as (code, length)."""
    used = [s for s, n in enumerate(lengths) if n] or [0]
    if len(used) <= 2 and used[-1] < 256:
        w.put(1, 1), w.put(len(used) - 1, 1), w.put(1, 1)
        for s in used:
            w.put(s, 8)
        return {s: (i, len(used) - 1) for i, s in enumerate(used)}
    runs = _runs(lengths)
    counts = [0] * 19
    for k, _, _ in runs:
        counts[k] += 1
    kinds = _code_lengths(counts)
    while max(kinds) > 7:  # three bits tell the length of each
        counts = [(c + 1) // 2 for c in counts]
        kinds = _code_lengths(counts)
    w.put(0, 1), w.put(15, 4)
    for k in LENGTH_ORDER:
        w.put(kinds[k], 3)
    w.put(0, 1)
    codes = {s: (c, n) for (n, c), s in canonical(kinds).items()} if sum(map(bool, kinds)) > 1 else {k: (0, 0) for k, _, _ in runs}
    for k, extra, width in runs:
        w.put(*codes[k])
        w.put(extra, width)
    return {s: (c, n) for (n, c), s in canonical(lengths).items()}


def _prefix(value: int) -> tuple[int, int, int]:
    """A length or distance code from 1 on as (symbol, extra bits' value, extra bits)."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 1
    return 2 * n + (v >> n - 1 & 1), v & (1 << n - 1) - 1, n - 1


#: Shortest and longest back-reference that is written, and the farthest; distances from 121 on are codes of plain ones.
SHORTEST, LONGEST, FARTHEST, PLAIN = 16, 4096, (1 << 20) - 200, 120


def _repeats(p: bytes) -> list[tuple[int, int]]:
    """p as literals (-1, sample) and copies (length, distance), found greedily by their first `SHORTEST` samples."""
    out, known, i, distance = [], {}, 0, 0
    while i < len(p):
        key = p[i : i + SHORTEST]
        j = i - distance if distance and p[i - distance : i - distance + SHORTEST] == key else known.get(key, -1)
        known[key] = i
        if j < 0 or i - j > FARTHEST or len(key) < SHORTEST:
            out.append((-1, p[i]))
            i += 1
            continue
        n, step = SHORTEST, LONGEST
        while step:
            if n + step <= min(LONGEST, len(p) - i) and p[j + n : j + n + step] == p[i + n : i + n + step]:
                n += step
            else:
                step >>= 1
        distance = i - j
        out.append((n, distance))
        i += n
    return out


def _with_repeats(p: bytes) -> tuple[bytes, int]:
    """The bits after an image's sizes, with their number, for grey samples that repeat themselves."""
    tokens = _repeats(p)
    green, far = [0] * 280, [0] * 40
    for n, x in tokens:
        green[x if n < 0 else 256 + _prefix(n)[0]] += 1
        if n > 0:
            far[_prefix(x + PLAIN)[0]] += 1
    w = BitWriter()
    w.put(1, 1), w.put(2, 2), w.put(0, 1), w.put(0, 2)  # as in GreyCode: subtract green, no cache, one group
    first = _put_code(w, _code_lengths(green))
    for symbol in (0, 0, 255):
        w.put(1, 1), w.put(0, 1), w.put(1, 1), w.put(symbol, 8)
    second = _put_code(w, _code_lengths(far))
    parts, held = [], w  # one long number would be shifted again and again
    for n, x in tokens:
        if n < 0:
            held.put(*first[x])
        else:
            s, extra, width = _prefix(n)
            held.put(*first[256 + s])
            held.put(extra, width)
            s, extra, width = _prefix(x + PLAIN)
            held.put(*second[s])
            held.put(extra, width)
        if held.n > 4096:
            whole = held.n >> 3
            parts.append((held.value & (1 << 8 * whole) - 1).to_bytes(whole, "little"))
            held.value >>= 8 * whole
            held.n &= 7
    total = 8 * sum(map(len, parts)) + held.n
    return b"".join(parts) + held.bytes(), total


class FastTable:
    """For every 16 bits: up to four samples that stand there, how many, and their bits."""

    def __init__(self, lengths: list[int]):
        one = np.zeros(1 << 16, np.int64)
        bits = np.zeros(1 << 16, np.int64)
        for (n, c), s in canonical(lengths).items():
            one[c :: 1 << n], bits[c :: 1 << n] = s, n
        w = np.arange(1 << 16)
        used, count, packed = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for k in range(4):
            rest = w >> used
            fits = (used + bits[rest] <= 16) & (count == k)
            packed |= np.where(fits, one[rest] << (8 * k), 0)
            used, count = used + np.where(fits, bits[rest], 0), count + fits
        self.used, self.count, self.packed = used, count, packed.astype(np.uint32)
        self.lengths = np.array(lengths[:256])
        self.entries = None

    def steps(self):
        if self.entries is None:
            raw = self.packed.tobytes()
            self.entries = [(u, raw[4 * i : 4 * i + n]) for i, (u, n) in enumerate(zip(self.used.tolist(), self.count.tolist(), strict=True))]
        return self.entries


def _decode_run(streams: list[bytes], start: int, sizes: list[int], t: FastTable) -> list[bytes]:
    """The samples of streams of one code, whose first stands at bit `start`.

    A stream that is too short reads on beyond its end; the bits that its samples take give it away.
    """
    order = sorted(range(len(streams)), key=lambda i: -sizes[i])
    base = np.cumsum([0] + [len(streams[i]) + 8 for i in order])
    farthest = max((int(base[k]) + start // 8 + 2 * sizes[i] for k, i in enumerate(order)), default=0)
    data = np.frombuffer(b"".join(streams[i] + b"\0" * 8 for i in order) + b"\0" * max(8, farthest + 16 - int(base[-1])), np.uint8)
    window = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    places = np.cumsum([0] + [sizes[i] + 8 for i in order])
    out = np.zeros(places[-1] + 8, np.uint8)
    write = np.ndarray((len(out) - 3,), "<u4", out, strides=(1,))
    bit = base[:-1] * 8 + start
    at = places[:-1].copy()
    end = at + np.array([sizes[i] for i in order])
    rows = np.arange(len(order))
    full = (1 << 16) - 1
    while len(rows) >= IN_STEP:
        w = ((window[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64(full)).astype(np.int64)
        write[at] = t.packed[w]
        at = at + t.count[w]
        bit = bit + t.used[w]
        live = at < end
        if not live.all():
            rows, at, bit, end = rows[live], at[live], bit[live], end[live]
    done = out.tobytes()
    found = [done[places[k] : places[k] + sizes[i]] for k, i in enumerate(order)]
    entries = t.steps() if len(rows) else None
    for k, a, b in zip(rows.tolist(), at.tolist(), bit.tolist(), strict=True):
        stream, n, b = streams[order[k]] + b"\0" * (3 + 2 * sizes[order[k]]), sizes[order[k]], b - int(base[k]) * 8
        parts, size = [found[k][: a - places[k]]], a - int(places[k])
        while size < n:
            i = b >> 3
            used, samples = entries[(int.from_bytes(stream[i : i + 3], "little") >> (b & 7)) & full]
            parts.append(samples)
            size += len(samples)
            b += used
        found[k] = b"".join(parts)[:n]
    for k, i in enumerate(order):
        if start + int(t.lengths[np.frombuffer(found[k], np.uint8)].sum()) > 8 * len(streams[i]):
            raise ValueError("the image ends early")
    result: list = [None] * len(streams)
    for k, i in enumerate(order):
        result[i] = found[k]
    return result


#: Headers met before, as (bits, bytes, table): streams of literals of one channel.
_HEADERS: list[tuple[int, bytes, FastTable]] = []


def _literal(stream: bytes):
    """(bits before the samples, their table) if the stream has samples of one channel only, else None."""
    tail = stream[5:]
    for bits, head, t in _HEADERS:
        whole, rest = bits >> 3, bits & 7
        if tail[:whole] == head[:whole] and (not rest or len(tail) > whole and (tail[whole] ^ head[whole]) & ((1 << rest) - 1) == 0):
            return 40 + bits, t
    b = Bits(stream)
    b.at = 40
    if b.read(4) != 0b0101 or b.read(2):  # subtract green alone; no cache, one group
        return None
    codes = [_read_code(b, n) for n in (280, 256, 256, 256, 40)]
    if codes[0].only is not None or any(codes[0].lengths[256:]) or [c.only for c in codes[1:4]] != [0, 0, 255]:
        return None
    t = FastTable(codes[0].lengths[:256])
    if len(_HEADERS) < 64:
        _HEADERS.append((b.at - 40, tail[: (b.at - 40 + 7) // 8], t))
    return b.at, t


def decode_grey(media: list[bytes]) -> list[bytes]:
    """The samples of grey images (green, where another channel differs too), a run of files each."""
    todo: dict = {}
    out: list[list] = []
    for m in media:
        parts = images(m)
        out.append([None] * len(parts))
        for j, stream in enumerate(parts):
            if stream[:1] != b"\x2f":
                raise ValueError("not a lossless image")
            size = int.from_bytes(stream[1:5], "little")
            n = ((size & 0x3FFF) + 1) * ((size >> 14 & 0x3FFF) + 1)
            if found := _literal(stream):
                todo.setdefault((found[0], id(found[1])), (found[1], []))[1].append((len(out) - 1, j, stream, n))
            else:
                out[-1][j] = (decode_stream(stream)[2] >> 8 & 0xFF).astype(np.uint8).tobytes()
    for (start, _), (t, members) in todo.items():
        for (i, j, _, _), samples in zip(members, _decode_run([m[2] for m in members], start, [m[3] for m in members], t), strict=True):
            out[i][j] = samples
    return [b"".join(x) for x in out]


def _text_weights() -> list[float]:
    """How common bytes are in text, by rule: blanks, small letters (vowels and a few consonants more), the rest."""
    w = [0.15] * 256
    for b in range(0x20, 0x7F):
        w[b] = 2
    for b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        w[b] = 4
    for b in b"abcdefghijklmnopqrstuvwxyz":
        w[b] = 15
    for b in b"aeionrst":
        w[b] = 60
    for b in range(0x80, 0xC0):
        w[b] = 1
    w[0x20], w[0x0A], w[0x2E], w[0x2C], w[0xC3] = 150, 10, 10, 6, 15
    return w


CODES = [GreyCode(_text_weights()), GreyCode([1.0] * 256)]
#: Payloads that a general compressor brings below this share repeat themselves enough to look for back-references.
REPETITIVE = 0.25


def encode_grey(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of 192 bytes) as grey WebP files of 192 columns.

    The shorter of two fixed prefix codes is taken, one for text and one of eight bits for anything else; for
    payloads that repeat themselves back-references, where they are shorter still.
    """
    pieces, owner = [], []
    for i, p in enumerate(payloads):
        for a in range(0, len(p), WIDTH * MOST_ROWS):
            pieces.append(np.frombuffer(p, np.uint8, min(WIDTH * MOST_ROWS, len(p) - a), a))
            owner.append(i)
    sizes = np.array([len(p) for p in pieces])
    flat = np.concatenate(pieces)
    first = np.cumsum(sizes) - sizes
    spent = np.stack([np.add.reduceat(c.lengths[flat], first) + c.header_bits for c in CODES])
    choice = spent.argmin(0)
    which = np.repeat(choice, sizes)
    lengths = np.where(which == 0, CODES[0].lengths[flat], CODES[1].lengths[flat])
    values = np.where(which == 0, CODES[0].codes[flat], CODES[1].codes[flat])
    head = np.array([c.header_bits for c in CODES])[choice]
    total = spent.min(0)
    words = (total + 31) // 32 + 1
    base = np.cumsum(words) - words
    upto = np.cumsum(lengths) - lengths
    bit = np.repeat(base * 32 + head - upto[first], sizes) + upto
    # Bits of one word don't overlap, so sums of up to 48 bits are exact in a double.
    sums = np.bincount(bit >> 5, (values << (bit & 31)).astype(float), int(words.sum()) + 1).astype(np.uint64)
    low = (sums & np.uint64(0xFFFFFFFF)).astype("<u4")
    low[1:] |= (sums[:-1] >> np.uint64(32)).astype("<u4")
    raw = low.tobytes()
    out = [b""] * len(payloads)
    for k, i in enumerate(owner):
        c = CODES[choice[k]]
        n = (int(total[k]) + 7) // 8
        piece = pieces[k].tobytes()
        bits = _with_repeats(piece)[0] if len(zlib.compress(piece, 1)) < REPETITIVE * len(piece) else b""
        if bits and len(bits) < n:
            body = bytearray(bits)
        else:
            body = bytearray(raw[4 * base[k] : 4 * base[k] + n])
            h = len(c.header)
            body[:h] = (int.from_bytes(body[:h], "little") | int.from_bytes(c.header, "little")).to_bytes(h, "little")
        rows = sizes[k] // WIDTH
        data = b"\x2f" + (WIDTH - 1 | int(rows - 1) << 14).to_bytes(4, "little") + bytes(body)
        pad = b"\0" * (len(data) & 1)
        out[i] += b"RIFF" + (12 + len(data) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + pad
    return out


def _slices(column, most=1 << 20):
    rows, held = [], 0
    for x in column:
        rows.append(x.as_buffer().to_pybytes() if x.is_valid else b"")
        held += len(rows[-1])
        if held > most:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def to_media(docs: DataFrame) -> DataFrame:
    """docs' columns but text, with n_bytes and media: the text's bytes as lossless WebP (columns of these names go).

    The bytes (null: none) are padded with blanks to a positive multiple of 192 and are a grey image's
    samples; a text of over 3 MB is several files in a row. Equal texts have equal media.
    """
    bounded_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("text", "n_bytes", "media")]
    base = docs.select(*own, utf8("text").alias("__text"))

    def run(batches):
        for batch in batches:
            sizes, media = [], []
            for rows in _slices(batch.column(len(own))):
                sizes += map(len, rows)
                media += encode_grey([t + b" " * ((-len(t)) % WIDTH if t else WIDTH) for t in rows])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[*own, "n_bytes", "media"])

    return base.mapInArrow(run, T.StructType([*base.drop("__text").schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def feature(payload: bytes) -> str:
    """Mean, standard deviation, distinct values and share of the commonest of the samples."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    v, total = np.arange(256), max(1, len(payload))
    mean = float(n @ v) / total
    return f"{mean:.4f},{np.sqrt(max(0.0, float(n @ (v * v)) / total - mean * mean)):.4f},{int((n > 0).sum())},{n.max() / total:.4f}"


def from_media(stored: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The columns of `stored` but media, with what is read back from its media (null media: nothing).

    payload (if asked), payload_bytes, payload_sha256, tail_crc32 of the last 16 bytes, media_bytes,
    media_sha256 and a feature string. Media that aren't lossless WebP are an error.
    """
    bounded_batches(stored.sparkSession)
    new = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["payload"] * keep_payload]
    own = [c for c in stored.columns if c not in ("media", *new)]
    base = stored.select(*own, F.coalesce("media", F.lit(b"")).alias("__media"))

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for media in _slices(batch.column(len(own))):
                for m, p in zip(media, decode_grey(media), strict=True):
                    out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(p), *[p] * keep_payload))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * keep_payload]
            columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*own, *new])

    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType(), *[T.BinaryType()] * keep_payload]
    return base.mapInArrow(run, T.StructType([*base.drop("__media").schema.fields, *map(T.StructField, new, kinds)]))


def query(spark, sf_dir):
    stored = saved(to_media(table(spark, sf_dir, "documents").select("doc_id", "text")), "media")
    return from_media(stored, keep_payload=False)
