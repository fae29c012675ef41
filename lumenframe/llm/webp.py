"""Lossless WebP (the VP8L bitstream of the published specification): writing and reading ARGB pixel arrays.

Reading knows all of it: canonical prefix codes (simple and normal), meta prefix groups, back-references with the
two-dimensional distance map, the colour cache, and the inverse predictor, cross-colour, subtract-green and
colour-indexing (with pixel bundling) transforms. Writing can use each of them.

Where one prefix group without a colour cache codes the pixels and only green has more than one symbol (grey images
after subtract-green, palettes), tokens are found as arrays: the token at every bit position, then the chain of
positions from the first. Otherwise the stream is read token by token.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, INDEXING = range(4)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
MOST = 16384  # pixels on a side

# Fixed values of the specification: the order of code length codes, and the near distances (x, y).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


def distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol, number of extra bits and their value, of a length or distance code from 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    extra = top - 1
    return 2 * top + (v >> extra & 1), extra, v & ((1 << extra) - 1)


def reversed_bits(x: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """x with its low n (at most 16) bits in reverse order."""
    x = np.asarray(x, np.int64)
    x = (x >> 1 & 0x5555) | (x & 0x5555) << 1
    x = (x >> 2 & 0x3333) | (x & 0x3333) << 2
    x = (x >> 4 & 0x0F0F) | (x & 0x0F0F) << 4
    x = (x >> 8 & 0x00FF) | (x & 0x00FF) << 8
    return x >> (16 - n)


@lru_cache(maxsize=16)
def flipped(n: int) -> np.ndarray:
    """All numbers of n bits, each with its bits in reverse order."""
    return reversed_bits(np.arange(1 << n), n)


# ---- prefix codes


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Lengths of an optimal code, at most `limit`: counts are flattened until it holds. A lone symbol has length 1."""
    used = np.flatnonzero(counts).tolist()
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    least = 1
    while True:
        heap = [(max(int(counts[s]), least), k) for k, s in enumerate(used)]
        heapq.heapify(heap)
        parent, n = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[1]] = parent[b[1]] = n
            heapq.heappush(heap, (a[0] + b[0], n))
            n += 1
        depth = [0] * n
        for k in range(n - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth) <= limit:
            out[used] = depth[: len(used)]
            return out
        least = max(2 * least, int(counts.sum()) >> (limit + 2))


def codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes as they lie in the stream (first bit lowest)."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[order]
    if not len(order):
        return np.zeros(len(lengths), np.int64)
    start = np.concatenate([[0], np.cumsum(np.int64(1) << (15 - n))])[:-1]
    out = np.zeros(len(lengths), np.int64)
    out[order] = reversed_bits(start >> (15 - n), n)
    return out


class Code:
    """Decoding table of a prefix code: symbol and length by the next `bits` bits of the stream."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) == 1:
            self.bits, self.symbols, self.lengths, self.only = 0, used.astype(np.int64), np.zeros(1, np.int64), int(used[0])
            self.both = (used << 4).astype(np.uint16)
            return
        self.only = None
        order = used[np.argsort(lengths[used], kind="stable")]
        n = lengths[order]
        self.bits = int(n[-1]) if len(n) else 0
        space = np.int64(1) << (self.bits - n)
        if not len(n) or int(space.sum()) != 1 << self.bits:
            raise ValueError("not a complete prefix code")
        row = np.repeat(np.arange(len(order)), space)[flipped(self.bits)]
        self.symbols, self.lengths = order[row].astype(np.int32), n[row].astype(np.int32)
        self.both = (self.symbols << 4 | self.lengths).astype(np.uint16)


@lru_cache(maxsize=256)
def lone_code(symbol: int) -> Code:
    """The code of one symbol, which takes no bits."""
    return Code(np.arange(symbol + 1) // max(symbol, 1) if symbol else np.ones(1, np.int64))


# ---- bits


class Writer:
    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.value, self.n = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.n
        self.n += bits

    def _flush(self) -> None:
        if self.n:
            self.parts.append(np.unpackbits(np.frombuffer(self.value.to_bytes((self.n + 7) // 8, "little"), np.uint8), bitorder="little")[: self.n])
            self.value, self.n = 0, 0

    def put_all(self, values: np.ndarray, bits: np.ndarray) -> None:
        """Each value (of at most `bits` bits, up to 20), one after another."""
        self._flush()
        ends = np.cumsum(bits)
        if not len(ends) or not ends[-1]:
            return
        at = ends - bits
        shifted = values.astype(np.uint64) << (at & 31).astype(np.uint64)
        # Bits of different values don't meet, so sums (exact: under 2**32) join them.
        n = (int(ends[-1]) >> 5) + 2
        word = np.bincount(at >> 5, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        word += np.bincount((at >> 5) + 1, (shifted >> np.uint64(32)).astype(np.float64), n)
        self.parts.append(np.unpackbits(word.astype("<u4").view(np.uint8), bitorder="little")[: ends[-1]])

    def bytes(self) -> bytes:
        self._flush()
        return np.packbits(np.concatenate([np.zeros(0, np.uint8), *self.parts]), bitorder="little").tobytes()


class Reader:
    def __init__(self, data: bytes):
        self.raw = data
        self.at, self.end = 0, len(data) * 8

    def get(self, bits: int) -> int:
        if self.at + bits > self.end:
            raise ValueError("the stream is too short")
        first = self.at >> 3
        v = int.from_bytes(self.raw[first : first + 5], "little") >> (self.at & 7)
        self.at += bits
        return v & ((1 << bits) - 1)

    def symbol(self, code: Code) -> int:
        if code.only is not None:
            return code.only
        first = self.at >> 3
        v = int.from_bytes(self.raw[first : first + 3], "little") >> (self.at & 7) & ((1 << code.bits) - 1)
        self.at += int(code.lengths[v])
        if self.at > self.end:
            raise ValueError("the stream is too short")
        return int(code.symbols[v])

    def number(self, prefix: int) -> int:
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.get(extra) + 1


def put_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used) and all(lengths[s] == 1 for s in used):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(int(used[0] > 1), 1)
        w.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    w.put(0, 1)
    tokens: list[tuple[int, int, int]] = []  # symbol, extra, its bits
    seq = lengths[: used[-1] + 1]
    heads = np.concatenate([[0], np.flatnonzero(seq[1:] != seq[:-1]) + 1, [len(seq)]])
    for value, run in zip(seq[heads[:-1]].tolist(), np.diff(heads).tolist(), strict=True):
        if value:
            tokens.append((value, 0, 0))
            run -= 1
        while run >= 3:
            m = min(run, 6 if value else 138)
            tokens.append((16, m - 3, 2) if value else (17, m - 3, 3) if m <= 10 else (18, m - 11, 7))
            run -= m
        tokens += [(value, 0, 0)] * run
    own = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    if (own > 0).sum() == 1:  # a table of one code needs a second symbol to be complete
        own[0 if not own[0] else 1] = 1
    of = codes(own)
    last = max(k for k, s in enumerate(LENGTH_ORDER) if own[s])
    w.put(max(0, last + 1 - 4), 4)
    for s in LENGTH_ORDER[: max(4, last + 1)]:
        w.put(int(own[s]), 3)
    w.put(1, 1)
    need = max(1, -(-(len(tokens) - 2).bit_length() // 2)) if len(tokens) > 2 else 1
    w.put(need - 1, 3)
    w.put(len(tokens) - 2, 2 * need)
    for s, extra, bits in tokens:
        w.put(int(of[s]), int(own[s]))
        w.put(extra, bits)


def get_code(r: Reader, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if r.get(1):
        two, wide = r.get(1), r.get(1)
        symbols = [r.get(8 if wide else 1)]
        if two:
            symbols.append(r.get(8))
        lengths[symbols] = 1
        return Code(lengths) if two else lone_code(symbols[0])
    own = np.zeros(19, np.int64)
    for s in LENGTH_ORDER[: 4 + r.get(4)]:
        own[s] = r.get(3)
    code = Code(own)
    left = 2 + r.get(2 + 2 * r.get(3)) if r.get(1) else size
    k, before = 0, 8
    while k < size and left:
        left -= 1
        s = r.symbol(code)
        if s < 16:
            lengths[k] = s
            before = s or before
            k += 1
            continue
        n = 3 + r.get(2) if s == 16 else 3 + r.get(3) if s == 17 else 11 + r.get(7)
        lengths[k : k + n] = before if s == 16 else 0
        k += n
    if k > size:
        raise ValueError("too many code lengths")
    return Code(lengths)


# ---- pixels as tokens


@lru_cache(maxsize=64)
def near_codes(width: int) -> dict[int, int]:
    """The least code of each distance that a near place has."""
    return {distance(c + 1, width): c + 1 for c in range(len(NEAR) - 1, -1, -1)}


def cache_slot(argb, bits: int):
    return (0x1E35A7BD * argb & 0xFFFFFFFF) >> (32 - bits)


def matches(px: np.ndarray, least: int = 16, reach: int = (1 << 20) - 120) -> list[tuple[int, int, int]]:
    """(place, length, distance) of repeated stretches, found by the hash of `least` pixels (a power of two)."""
    n = len(px)
    if n < 2 * least:
        return []
    h, step, size = (px + 1).astype(np.uint64), 0x9E3779B97F4A7C15, 1
    while size < least:  # twice the length each time
        h = h[:-size] * np.uint64(step) + h[size:]
        step, size = step * step & (2**64 - 1), 2 * size
    order = np.argsort(h, kind="stable")
    before = np.full(len(h), -1)
    same = h[order[1:]] == h[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    places = np.flatnonzero((before >= 0) & (np.arange(len(h)) - before <= reach))
    out, done, k = [], 0, 0
    at_list, from_list = places.tolist(), before[places].tolist()
    while k < len(at_list):
        at, origin = at_list[k], from_list[k]
        if at < done:
            k = int(np.searchsorted(places, done))
            continue
        length, step = 0, 64
        while length < 4096:
            m = min(step, n - at - length, 4096 - length)
            differ = np.flatnonzero(px[at + length : at + length + m] != px[origin + length : origin + length + m])
            if len(differ):
                length += int(differ[0])
                break
            length += m
            if not m:
                break
            step *= 4
        if length >= least:
            out.append((at, length, at - origin))
            done = at + length
        k += 1
    return out


def put_pixels(w: Writer, px: np.ndarray, width: int, main: bool, cache_bits: int = 0, lz: bool = False, groups: tuple[int, np.ndarray] | None = None) -> None:
    """An entropy-coded image. groups: (block bits, the prefix group of each block), for the main image."""
    found = matches(px.astype(np.int64)) if lz else []
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    n_groups = 1
    if main:
        w.put(int(groups is not None), 1)
        if groups is not None:
            bits, of = groups
            w.put(bits - 2, 3)
            put_pixels(w, of.ravel().astype(np.int64) << 8, of.shape[1], False)
            n_groups = int(of.max()) + 1
    px = px.astype(np.int64)
    covered = np.zeros(len(px) + 1, np.int64)
    for at, length, _ in found:
        covered[at] += 1
        covered[at + length] -= 1
    single = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    argb = px[single]
    if not cache_bits and groups is None and len(argb) and not ((argb ^ argb[0]) & 0xFFFF00FF).any():
        _put_green_only(w, argb, single, found, width)
        return
    green, others = argb >> 8 & 255, [argb >> s & 255 for s in (16, 0, 24)]
    is_cached = np.zeros(len(single), bool)
    if cache_bits:
        slots = np.full(1 << cache_bits, 0)
        lone = dict(zip(single.tolist(), range(len(single)), strict=True))
        key = cache_slot(px, cache_bits).tolist()
        for k, (v, s) in enumerate(zip(px.tolist(), key, strict=True)):
            if k in lone and slots[s] == v:
                is_cached[lone[k]], green[lone[k]] = True, LITERALS + LENGTHS + s
            slots[s] = v
    if found:
        at, length, back = np.array(found, np.int64).T
        near = near_codes(width)
        lp = np.array([prefix_of(v) for v in length.tolist()], np.int64)
        dp = np.array([prefix_of(near.get(v, v + len(NEAR))) for v in back.tolist()], np.int64)
    else:
        at, lp, dp = np.zeros(0, np.int64), np.zeros((0, 3), np.int64), np.zeros((0, 3), np.int64)

    def group_at(place: np.ndarray) -> np.ndarray:
        if groups is None:
            return np.zeros(len(place), np.int64)
        return groups[1][place // width >> groups[0], place % width >> groups[0]]

    g1, g2, size = group_at(single), group_at(at), LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)
    literal = ~is_cached
    value, bits = np.zeros((5, len(single)), np.int64), np.zeros((5, len(single)), np.int64)
    value2, bits2 = np.zeros((4, len(at)), np.int64), np.zeros((4, len(at)), np.int64)
    value2[1], bits2[1], value2[3], bits2[3] = lp[:, 2], lp[:, 1], dp[:, 2], dp[:, 1]
    for g in range(n_groups):
        one, two = g1 == g, g2 == g
        counts = [np.bincount(np.concatenate([green[one], LITERALS + lp[two, 0]]), minlength=size)]
        counts += [np.bincount(o[one & literal], minlength=256) for o in others]
        counts.append(np.bincount(dp[two, 0], minlength=DISTANCES))
        for k, c in enumerate(counts):
            lengths = code_lengths(c)
            put_code(w, lengths)
            if (lengths > 0).sum() < 2:
                lengths[:] = 0
            of = codes(lengths)
            if k == 0:
                value[0, one], bits[0, one] = of[green[one]], lengths[green[one]]
                s = LITERALS + lp[two, 0]
                value2[0, two], bits2[0, two] = of[s], lengths[s]
            elif k < 4:
                mine = one & literal
                value[k, mine], bits[k, mine] = of[others[k - 1][mine]], lengths[others[k - 1][mine]]
            else:
                value2[2, two], bits2[2, two] = of[dp[two, 0]], lengths[dp[two, 0]]
    used = [k for k in range(4) if bits[k].any()]
    v, b = value[used].T, bits[used].T
    if not len(at):
        w.put_all(v.ravel(), b.ravel())
        return
    lane = max(4, len(used))
    rows, rows_b = np.zeros((len(single) + len(at), lane), np.int64), np.zeros((len(single) + len(at), lane), np.int64)
    order = np.argsort(np.concatenate([single, at]), kind="stable")
    rows[: len(single), : len(used)], rows_b[: len(single), : len(used)] = v, b
    rows[len(single) :, :4], rows_b[len(single) :, :4] = value2.T, bits2.T
    v, b = rows[order].ravel(), rows_b[order].ravel()
    some = b > 0
    w.put_all(v[some], b[some])


def _put_tokens(w: Writer, green: np.ndarray, where: np.ndarray, lp: np.ndarray, dp: np.ndarray, green_n: np.ndarray, green_c: np.ndarray, dist_n: np.ndarray, dist_c: np.ndarray) -> None:
    if not len(lp):
        w.put_all(green_c[green], green_n[green])
        return
    n = len(green)
    value, bits = np.empty(n + 4 * len(lp), np.int64), np.empty(n + 4 * len(lp), np.int64)
    slot = np.arange(n) + 4 * np.searchsorted(where, np.arange(n), "right")
    value[slot], bits[slot] = green_c[green], green_n[green]
    at = where + 4 * np.arange(len(lp))
    for k, (v, m) in enumerate(((green_c[LITERALS + lp[:, 0]], green_n[LITERALS + lp[:, 0]]), (lp[:, 2], lp[:, 1]), (dist_c[dp[:, 0]], dist_n[dp[:, 0]]), (dp[:, 2], dp[:, 1]))):
        value[at + k], bits[at + k] = v, m
    w.put_all(value, bits)


def _put_green_only(w: Writer, argb: np.ndarray, single: np.ndarray, found: list[tuple[int, int, int]], width: int) -> None:
    """The codes and tokens of an image in which only green differs between pixels."""
    near = near_codes(width)
    lp = [prefix_of(length) for _, length, _ in found]
    dp = [prefix_of(near.get(back, back + len(NEAR))) for _, _, back in found]
    green = argb >> 8 & 255
    counts = np.bincount(green, minlength=LITERALS + LENGTHS)
    for p, _, _ in lp:
        counts[LITERALS + p] += 1
    green_n = code_lengths(counts, 12)  # a small table to read by
    put_code(w, green_n)
    for shift in (16, 0, 24):
        w.put(5, 3)  # a simple code of one symbol of eight bits
        w.put(int(argb[0]) >> shift & 255, 8)
    dist_n = code_lengths(np.bincount([p for p, _, _ in dp], minlength=DISTANCES))
    put_code(w, dist_n)
    for n in (green_n, dist_n):
        if (n > 0).sum() < 2:
            n[:] = 0
    where = np.searchsorted(single, [at for at, _, _ in found])  # literals before each copy
    _put_tokens(w, green, where, np.array(lp, np.int64).reshape(-1, 3), np.array(dp, np.int64).reshape(-1, 3), green_n, codes(green_n), dist_n, codes(dist_n))


def get_pixels(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = r.get(4) if r.get(1) else 0
    n, group_bits, of = width * height, 0, None
    if main and r.get(1):
        group_bits = r.get(3) + 2
        gw, gh = (width + (1 << group_bits) - 1) >> group_bits, (height + (1 << group_bits) - 1) >> group_bits
        of = (get_pixels(r, gw, gh, False) >> 8 & 0xFFFF).reshape(gh, gw)
    size = LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)
    groups = [[get_code(r, s) for s in (size, 256, 256, 256, DISTANCES)] for _ in range(1 if of is None else int(of.max()) + 1)]
    if of is None and not cache_bits and all(c.only is not None for c in groups[0][1:4]):
        return _green_only(r, groups[0], n, width)
    out = [0] * n
    cache = [0] * (1 << cache_bits)
    at = filled = 0
    while at < n:
        green, red, blue, alpha, dist = groups[0 if of is None else of[at // width >> group_bits, at % width >> group_bits]]
        s = r.symbol(green)
        if s < LITERALS:
            red_v = r.symbol(red)
            blue_v = r.symbol(blue)
            out[at] = r.symbol(alpha) << 24 | red_v << 16 | s << 8 | blue_v
            at += 1
        elif s < LITERALS + LENGTHS:
            length = r.number(s - LITERALS)
            back = distance(r.number(r.symbol(dist)), width)
            if back > at or at + length > n:
                raise ValueError("a back-reference leaves the image")
            for k in range(at, at + length):
                out[k] = out[k - back]
            at += length
        else:
            for k in range(filled, at):  # what came since the last look
                cache[cache_slot(out[k], cache_bits)] = out[k]
            filled = at
            out[at] = cache[s - LITERALS - LENGTHS]
            at += 1
    return np.array(out, np.int64)


_EIGHT = np.arange(8, dtype=np.uint32)
_EXTRA = np.array([0] * 4 + [(p - 2) >> 1 for p in range(4, DISTANCES)], np.int64)
_OFFSET = np.array([p + 1 for p in range(4)] + [((2 + (p & 1)) << ((p - 2) >> 1)) + 1 for p in range(4, DISTANCES)], np.int64)


def _green_only(r: Reader, group: list[Code], n: int, width: int, window: int = 1 << 20) -> np.ndarray:
    """Pixels of a stream in which only green and the distances have codes of some length: tokens as arrays."""
    green, dist = group[0], group[4]
    base = group[3].only << 24 | group[1].only << 16 | group[2].only
    if green.only is not None and green.only < LITERALS:
        return np.full(n, base | green.only << 8, np.int64)
    data = np.frombuffer(r.raw + b"\0" * 16, np.uint8)
    out, filled = np.empty(n, np.int64), 0
    while filled < n:
        first = r.at >> 3
        part = data[first : first + window // 8 + 16].astype(np.uint32)
        last = max(1, min(len(part) - 15, window // 8))
        words = part[:last] | part[1 : last + 1] << np.uint32(8) | part[2 : last + 2] << np.uint32(16)

        def bits_at(p: np.ndarray, k, part=part) -> np.ndarray:
            v = sum(part[(p >> 3) + j].astype(np.int64) << 8 * j for j in range(4))
            return v >> (p & 7) & ((1 << k) - 1)

        look = (words[:, None] >> _EIGHT).ravel()
        look &= np.uint32((1 << green.bits) - 1)
        both = green.both[look]
        stop = len(look)
        nxt = np.arange(stop + 64, dtype=np.int32)  # places beyond stay
        nxt[:stop] += both & np.uint16(15)
        copies = np.flatnonzero(both >= LITERALS << 4)
        if len(copies):  # length, distance and what follows, at each place where a copy would begin
            p, k = nxt[copies].astype(np.int64), (both[copies] >> 4).astype(np.int64) - LITERALS
            length = _OFFSET[k] + bits_at(p, _EXTRA[k])
            p = p + _EXTRA[k]
            v = bits_at(p, dist.bits)
            d = dist.symbols[v]
            p = p + dist.lengths[v]
            back = _OFFSET[d] + bits_at(p, _EXTRA[d])
            nxt[copies] = np.minimum(p + _EXTRA[d], stop + 63)
        by8 = nxt[nxt]
        by8 = by8[by8]
        by8 = by8[by8]
        view, p, heads = memoryview(by8), r.at & 7, []
        want = n - filled
        while p < stop and 8 * len(heads) < want:
            heads.append(p)
            p = view[p]
        place = np.empty((len(heads), 8), np.int64)
        place[:, 0] = heads
        for k in range(1, 8):
            place[:, k] = nxt[place[:, k - 1]]
        place = place.ravel()
        place = place[: np.searchsorted(place, stop)][:want]
        s = (both[place] >> 4).astype(np.int64)
        is_copy = s >= LITERALS
        size = np.ones(len(place), np.int64)
        if is_copy.any():
            at = np.searchsorted(copies, place[is_copy])
            size[is_copy] = length[at]
        ends = filled + np.cumsum(size)
        used = int(np.searchsorted(ends, n)) + 1
        place, s, is_copy, size, ends = place[:used], s[:used], is_copy[:used], size[:used], ends[:used]
        if not len(place):
            raise ValueError("the stream is too short")
        out_at = ends - size
        out[out_at[~is_copy]] = base | s[~is_copy] << 8
        if is_copy.any():
            at = np.searchsorted(copies, place[is_copy])
            for a, m, b in zip(out_at[is_copy].tolist(), size[is_copy].tolist(), back[at].tolist(), strict=True):
                b = distance(b, width)
                if b > a or a + m > n:
                    raise ValueError("a back-reference leaves the image")
                if b >= m:
                    out[a : a + m] = out[a - b : a - b + m]
                else:
                    out[a : a + m] = np.resize(out[a - b : a], m)
        filled = int(ends[-1])
        r.at = (first << 3) + int(nxt[place[-1]])
        if r.at > r.end:
            raise ValueError("the stream is too short")
    return out


# ---- transforms, on channels (4, height, width): alpha, red, green, blue


def split(px: np.ndarray, width: int) -> np.ndarray:
    return np.stack([px >> s & 255 for s in (24, 16, 8, 0)]).reshape(4, -1, width)


def joined(c: np.ndarray) -> np.ndarray:
    c = c.reshape(4, -1).astype(np.int64)
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def _predicted(mode: int, left, top, corner, right):
    """The prediction from the four neighbours; arrays (4,) or (4, n)."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 0:
        return np.array([255, 0, 0, 0]).reshape(4, *[1] * (np.ndim(left) - 1)) + 0 * left
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode < 10:
        return mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        return np.where(np.abs(top - corner).sum(0) < np.abs(left - corner).sum(0), left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    a = mean(left, top)
    d = a - corner
    return np.clip(a + np.where(d < 0, -((-d) >> 1), d >> 1), 0, 255)


def _neighbour_modes(modes: np.ndarray, bits: int, y: int, x: int) -> int:
    if y == 0:
        return 0 if x == 0 else 1
    return 2 if x == 0 else int(modes[y >> bits, x >> bits])


def predictor_forward(c: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """What is left after each pixel's prediction, for all pixels of a mode at once."""
    _, height, width = c.shape
    mode = np.repeat(np.repeat(modes, 1 << bits, 0), 1 << bits, 1)[:height, :width].astype(np.int64)
    mode[:, 0], mode[0], mode[0, 0] = 2, 1, 0
    flat = np.concatenate([np.zeros((4, width + 1), np.int64), c.reshape(4, -1)], axis=1)
    n, out, mode = height * width, np.empty((4, height * width), np.int64), mode.ravel()
    for m in np.unique(mode).tolist():
        k = np.flatnonzero(mode == m) + width + 1
        left, top, corner, right = (flat[:, j] for j in (k - 1, k - width, k - width - 1, np.minimum(k - width + 1, n + width)))
        out[:, k - width - 1] = (flat[:, k] - _predicted(m, left, top, corner, right)) & 255
    return out.reshape(c.shape)


def predictor_inverse(c: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Rows in order. In a row, runs whose mode needs no left neighbour are one step; constant and left modes are sums."""
    _, height, width = c.shape
    flat = c.reshape(4, -1).copy()
    for y in range(height):
        x = 0
        while x < width:
            m = _neighbour_modes(modes, bits, y, x)
            end = x + 1 if x == 0 else min(width, ((x >> bits) + 1) << bits) if y else width
            k, e = y * width + x, y * width + end
            if m in (0, 2, 3, 4, 8, 9) and not (m in (3, 9) and end == width and e - width + 1 > k):
                top = flat[:, k - width : e - width] if y else np.zeros((4, end - x), np.int64)
                corner = flat[:, k - width - 1 : e - width - 1] if y and k > width else top
                right = flat[:, k - width + 1 : e - width + 1] if y else top
                flat[:, k:e] = (flat[:, k:e] + _predicted(m, top, top, corner, right)) & 255
            elif m == 1:
                flat[:, k:e] = (flat[:, k - 1 : k] + np.cumsum(flat[:, k:e], axis=1)) & 255
            else:
                for j in range(k, e):
                    p = _predicted(m, flat[:, j - 1], flat[:, j - width], flat[:, j - width - 1], flat[:, j - width + 1])
                    flat[:, j] = (flat[:, j] + p) & 255
            x = end
    return flat.reshape(c.shape)


def _delta(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    signed = lambda a: a - ((a & 128) << 1)
    return signed(t) * signed(v) >> 5


def cross_colour(c: np.ndarray, table: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """table: (3, rows, columns) of green-to-red, green-to-blue and red-to-blue."""
    _, height, width = c.shape
    gr, gb, rb = np.repeat(np.repeat(table, 1 << bits, 1), 1 << bits, 2)[:, :height, :width]
    a, red, green, blue = c
    sign = 1 if inverse else -1
    new_red = (red + sign * _delta(gr, green)) & 255
    new_blue = (blue + sign * (_delta(gb, green) + _delta(rb, new_red if inverse else red))) & 255
    return np.stack([a, new_red, green, new_blue])


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


# ---- files


def encode(px: np.ndarray, width: int, *, grey: bool = False, palette: bool = False, predictor: tuple[int, np.ndarray] | None = None, cross: tuple[int, np.ndarray] | None = None,
           cache_bits: int = 0, lz: bool = False, groups: tuple[int, np.ndarray] | None = None) -> bytes:
    """A WebP file of ARGB pixels (row by row). grey: subtract green; predictor, cross: (block bits, table)."""
    px = np.asarray(px, np.int64)
    height = len(px) // width
    if not (0 < width <= MOST and 0 < height <= MOST and height * width == len(px)):
        raise ValueError("an image has 1 to 16384 pixels on a side")
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int((px >> 24 != 255).any()), 1)
    w.put(0, 3)
    if predictor:
        bits, modes = predictor
        w.put(1 | PREDICTOR << 1, 3)
        w.put(bits - 2, 3)
        put_pixels(w, modes.ravel().astype(np.int64) << 8, modes.shape[1], False)
        px = joined(predictor_forward(split(px, width), modes, bits))
    if cross:
        bits, table = cross
        w.put(1 | CROSS_COLOUR << 1, 3)
        w.put(bits - 2, 3)
        put_pixels(w, (table[2] << 16 | table[1] << 8 | table[0]).ravel(), table.shape[2], False)
        px = joined(cross_colour(split(px, width), table, bits, False))
    if grey:
        w.put(1 | SUBTRACT_GREEN << 1, 3)
        green = px >> 8 & 255
        px = px & 0xFF00FF00 | ((px >> 16 & 255) - green & 255) << 16 | ((px & 255) - green & 255)
    if palette:
        colours, index = np.unique(px, return_inverse=True)
        if len(colours) > 256:
            raise ValueError("a palette has at most 256 colours")
        w.put(1 | INDEXING << 1, 3)
        w.put(len(colours) - 1, 8)
        c = split(colours, len(colours))
        put_pixels(w, joined(np.diff(c, axis=2, prepend=0) & 255), len(colours), False)
        bits = bundle_bits(len(colours))
        rows = np.zeros((height, (width + (1 << bits) - 1) >> bits << bits), np.int64)
        rows[:, :width] = index.reshape(height, width)
        each = 8 >> bits
        rows = (rows.reshape(height, -1, 1 << bits) << np.arange(1 << bits) * each).sum(2)
        width, px = rows.shape[1], 255 << 24 | rows.ravel() << 8
    w.put(0, 1)
    put_pixels(w, px, width, True, cache_bits, lz, groups)
    data = w.bytes()
    pad = len(data) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(data) + pad) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + b"\0" * pad


def decode(file: bytes) -> tuple[np.ndarray, int]:
    """ARGB pixels and the width."""
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    r = Reader(file[20 : 20 + struct.unpack("<I", file[16:20])[0]])
    if r.get(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = r.get(14) + 1, r.get(14) + 1
    r.get(1)
    if r.get(3):
        raise ValueError("unknown version")
    undo, own = [], width
    while r.get(1):
        kind = r.get(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.get(3) + 2
            tw, th = (own + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
            undo.append((kind, own, bits, get_pixels(r, tw, th, False).reshape(th, tw)))
        elif kind == INDEXING:
            n = r.get(8) + 1
            colours = joined(np.cumsum(split(get_pixels(r, n, 1, False), n), axis=2) & 255)
            undo.append((kind, own, bundle_bits(n), colours))
            own = (own + (1 << bundle_bits(n)) - 1) >> bundle_bits(n)
        else:
            undo.append((kind, own, 0, None))
    px = get_pixels(r, own, height, True)
    for kind, own, bits, table in reversed(undo):
        if kind == PREDICTOR:
            px = joined(predictor_inverse(split(px, own), table >> 8 & 15, bits))
        elif kind == CROSS_COLOUR:
            px = joined(cross_colour(split(px, own), np.stack([table & 255, table >> 8 & 255, table >> 16 & 255]), bits, True))
        elif kind == SUBTRACT_GREEN:
            green = px >> 8 & 255
            px = px & 0xFF00FF00 | ((px >> 16 & 255) + green & 255) << 16 | ((px & 255) + green & 255)
        else:
            each = 8 >> bits
            index = (px >> 8 & 255)[:, None] >> np.arange(1 << bits) * each & ((1 << each) - 1)
            index = index.reshape(height, -1)[:, :own].ravel()
            px = np.append(table, np.zeros(max(0, 256 - len(table)), np.int64))[index]
    return px, width
