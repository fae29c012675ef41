"""Near-lossless coding of whole scans by adaptive Golomb codes (ITU-T T.87), one scan a group: single components, or
several of one size interleaved by lines or by samples.

A scan is serial: each sample's context statistics depend on all before. Scans of different images are independent.
The coder and the decoder share one class that walks the samples; they differ only in where an error comes from.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lumenframe.operators.predict import thresholds

RESET = 64
# Run-length orders of the standard.
ORDERS = [0] * 4 + [1] * 4 + [2] * 4 + [3] * 4 + [4, 4, 5, 5, 6, 6, 7, 7, 8, 9, 10, 11, 12, 13, 14, 15]


class _Writer:
    def __init__(self):
        self.bits: list[str] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.bits.append(f"{value & ((1 << n) - 1):0{n}b}")

    def zeros(self, n: int) -> None:
        self.bits.append("0" * n + "1")

    def bytes(self) -> bytes:
        """A byte after FF has seven bits, its first bit is 0."""
        bits, at, out = "".join(self.bits), 0, bytearray()
        while at < len(bits):
            n = 7 if out and out[-1] == 0xFF else 8
            out.append(int(bits[at : at + n].ljust(n, "0"), 2))
            at += n
        if out and out[-1] == 0xFF:
            out.append(0)
        return bytes(out)


class _Reader:
    def __init__(self, data: bytes):
        self.bits = "".join(f"{b:07b}" if k and data[k - 1] == 0xFF else f"{b:08b}" for k, b in enumerate(data))
        self.at = 0

    def get(self, n: int) -> int:
        self.at += n
        return int(self.bits[self.at - n : self.at], 2) if n else 0

    def zeros(self) -> int:
        one = self.bits.index("1", self.at)
        n, self.at = one - self.at, one + 1
        return n


class Scan:
    def __init__(self, width: int, bits: int = 8, near: int = 0):
        self.width, self.near, self.top, self.delta = width, near, (1 << bits) - 1, 2 * near + 1
        self.t1, self.t2, self.t3 = thresholds(bits, near)
        self.range = (self.top + 2 * near) // self.delta + 1
        self.qbpp = max(1, (self.range - 1).bit_length())
        bpp = max(2, bits)
        self.limit = 2 * (bpp + max(8, bpp))
        self.a = [max(2, (self.range + 32) >> 6)] * 367
        self.b, self.c, self.n, self.negative = [0] * 367, [0] * 367, [1] * 367, [0] * 367
        self.run_index = 0

    def level(self, g: int) -> int:
        s, g = (-1, -g) if g < 0 else (1, g)
        return 0 if g <= self.near else s * (1 + (g >= self.t1) + (g >= self.t2) + (g >= self.t3))

    def reduced(self, e: int) -> int:
        """A prediction error quantized to steps and brought into the coding range."""
        if self.near:
            e = (e + self.near) // self.delta if e > 0 else -((self.near - e) // self.delta)
        half = (self.range + 1) // 2
        return e + self.range if e < half - self.range else e - self.range if e >= half else e

    def restored(self, p: int, e: int) -> int:
        """The sample that a decoder has."""
        v = p + e * self.delta
        if v < -self.near:
            v += self.range * self.delta
        elif v > self.top + self.near:
            v -= self.range * self.delta
        return min(max(v, 0), self.top)

    def order(self, weight: int, n: int) -> int:
        k = 0
        while n << k < weight:
            k += 1
        return k

    def put_golomb(self, out: _Writer, m: int, k: int, limit: int) -> None:
        high, most = m >> k, limit - self.qbpp - 1
        if high < most:
            out.zeros(high)
            out.put(m, k)
        else:
            out.zeros(most)
            out.put(m - 1, self.qbpp)

    def get_golomb(self, source: _Reader, k: int, limit: int) -> int:
        high = source.zeros()
        return high << k | source.get(k) if high < limit - self.qbpp - 1 else source.get(self.qbpp) + 1

    def regular(self, q: int, sign: int, p: int, sample: int | None, io) -> int:
        a, b, n = self.a[q], self.b[q], self.n[q]
        p = min(max(p + sign * self.c[q], 0), self.top)
        k = self.order(a, n)
        flip = self.near == 0 and k == 0 and 2 * b <= -n
        if sample is not None:
            e = self.reduced(sign * (sample - p))
            x = -e - 1 if flip else e
            self.put_golomb(io, 2 * x if x >= 0 else -2 * x - 1, k, self.limit)
        else:
            m = self.get_golomb(io, k, self.limit)
            x = -(m + 1) // 2 if m & 1 else m // 2
            e = -x - 1 if flip else x
        b, a = b + e * self.delta, a + abs(e)
        if n == RESET:
            a, n = a >> 1, n >> 1
            b = b >> 1 if b >= 0 else -((1 - b) >> 1)
        n += 1
        if b <= -n:
            b, self.c[q] = max(b + n, 1 - n), max(self.c[q] - 1, -128)
        elif b > 0:
            b, self.c[q] = min(b - n, 0), min(self.c[q] + 1, 127)
        self.a[q], self.b[q], self.n[q] = a, b, n
        return self.restored(p, sign * e)

    def interrupted(self, left: int, above: int, sample: int | None, io, among: bool = False) -> int:
        """The sample that ends a run. among: it is one of several components, which share the run and are never taken for alike."""
        alike = int(not among and abs(left - above) <= self.near)
        q, p, sign = 365 + alike, left if alike else above, -1 if not alike and left > above else 1
        a, n, below = self.a[q], self.n[q], self.negative[q]
        k = self.order(a + (n >> 1) if alike else a, n)
        limit = self.limit - ORDERS[self.run_index] - 1
        if sample is not None:
            e = self.reduced(sign * (sample - p))
            odd = int(k == 0 and e > 0 and 2 * below < n or e < 0 and (2 * below >= n or k != 0))
            m = 2 * abs(e) - alike - odd
            self.put_golomb(io, m, k, limit)
        else:
            m = self.get_golomb(io, k, limit)
            odd = (m + alike) & 1
            size = (m + alike + odd) // 2
            if k == 0 and 2 * below < n:
                e = size if odd else -size
            else:
                e = -size if odd else size
        self.negative[q] += e < 0
        self.a[q] += (m + 1 - alike) >> 1
        if n == RESET:
            self.a[q], n, self.negative[q] = self.a[q] >> 1, n >> 1, self.negative[q] >> 1
        self.n[q] = n + 1
        if not among:
            self.run_index = max(0, self.run_index - 1)
        return self.restored(p, sign * e)

    def run(self, left: int, rest: list[int] | None, room: int, io) -> tuple[int, bool]:
        """Length of a run of samples like the one on the left, and whether it ends the line."""
        if rest is not None:
            length = 0
            while length < room and abs(rest[length] - left) <= self.near:
                length += 1
            left_over = length
            while left_over >= 1 << ORDERS[self.run_index]:
                io.put(1, 1)
                left_over -= 1 << ORDERS[self.run_index]
                self.run_index = min(31, self.run_index + 1)
            if length == room:
                if left_over:
                    io.put(1, 1)
                return length, True
            io.put(0, 1)
            io.put(left_over, ORDERS[self.run_index])
            return length, False
        length = 0
        while io.get(1):
            step = 1 << ORDERS[self.run_index]
            if length + step <= room:
                length += step
                self.run_index = min(31, self.run_index + 1)
            else:
                length = room
            if length == room:
                return length, True
        return length + io.get(ORDERS[self.run_index]), False

    def near_by(self, row: list[int], x: int, above: list[int], corner_above: int) -> tuple[int, int, int, int]:
        """The samples to the left, above, above left and above right of a place."""
        b = above[x]
        return row[x - 1] if x else above[0], b, above[x - 1] if x else corner_above, above[x + 1] if x + 1 < self.width else b

    def levels(self, a: int, b: int, c: int, d: int) -> tuple[int, int, int]:
        return self.level(d - b), self.level(b - c), self.level(c - a)

    def predicted(self, a: int, b: int, c: int, g: tuple[int, int, int], sample: int | None, io) -> int:
        """A sample outside a run."""
        sign = -1 if g < (0, 0, 0) else 1
        p = min(a, b) if c >= max(a, b) else max(a, b) if c <= min(a, b) else a + b - c
        return self.regular(sign * (81 * g[0] + 9 * g[1] + g[2]), sign, p, sample, io)

    def line(self, above: list[int], corner_above: int, given: list[int] | None, io) -> list[int]:
        """One line of one component."""
        row, x = [0] * self.width, 0
        while x < self.width:
            a, b, c, d = self.near_by(row, x, above, corner_above)
            g = self.levels(a, b, c, d)
            if g == (0, 0, 0):
                n, ends = self.run(a, given[x:] if given is not None else None, self.width - x, io)
                row[x : x + n] = [a] * n
                x += n
                if ends:
                    break
                row[x] = self.interrupted(a, above[x], given[x] if given is not None else None, io)
            else:
                row[x] = self.predicted(a, b, c, g, given[x] if given is not None else None, io)
            x += 1
        return row

    def walk(self, height: int, io, samples: list[list[int]] | None = None) -> list[list[int]]:
        """Code the samples, or decode them if there are none; returns what a decoder has."""
        return self.by_lines(height, io, 1, [samples] if samples is not None else None)[0]

    def by_lines(self, height: int, io, components: int, samples: list[list[list[int]]] | None = None) -> list[list[list[int]]]:
        """Components line by line in turn: they share the contexts, each has its own run state."""
        out: list[list[list[int]]] = [[] for _ in range(components)]
        runs, above, corner = [0] * components, [[0] * self.width for _ in range(components)], [0] * components
        for y in range(height):
            for k in range(components):
                self.run_index = runs[k]
                row = self.line(above[k], corner[k], samples[k][y] if samples is not None else None, io)
                runs[k], corner[k], above[k] = self.run_index, above[k][0], row
                out[k].append(row)
        return out

    def by_samples(self, height: int, io, components: int, samples: list[list[list[int]]] | None = None) -> list[list[list[int]]]:
        """Components sample by sample in turn: a run is one of all components and starts where none has a gradient."""
        out: list[list[list[int]]] = [[] for _ in range(components)]
        every = range(components)
        above, corner = [[0] * self.width for _ in every], [0] * components
        for y in range(height):
            rows, x, given = [[0] * self.width for _ in every], 0, [samples[k][y] for k in every] if samples is not None else None
            while x < self.width:
                near = [self.near_by(rows[k], x, above[k], corner[k]) for k in every]
                g = [self.levels(*n) for n in near]
                if all(v == (0, 0, 0) for v in g):
                    left, room = [n[0] for n in near], self.width - x
                    # A place belongs to the run if every component is near its own left sample: 0 for such a place, else far away.
                    rest = [0 if all(abs(given[k][x + i] - left[k]) <= self.near for k in every) else self.near + 1 for i in range(room)] if given is not None else None
                    n, ends = self.run(0, rest, room, io)
                    for k in every:
                        rows[k][x : x + n] = [left[k]] * n
                    x += n
                    if ends:
                        break
                    for k in every:
                        rows[k][x] = self.interrupted(left[k], above[k][x], given[k][x] if given is not None else None, io, among=True)
                    self.run_index = max(0, self.run_index - 1)
                else:
                    for k in every:
                        a, b, c, _ = near[k]
                        rows[k][x] = self.predicted(a, b, c, g[k], given[k][x] if given is not None else None, io)
                x += 1
            for k in every:
                corner[k], above[k] = above[k][0], rows[k]
                out[k].append(rows[k])
        return out


def encoded(samples: list[list[int]], bits: int = 8, near: int = 0) -> bytes:
    w = _Writer()
    Scan(len(samples[0]), bits, near).walk(len(samples), w, samples)
    return w.bytes()


def decoded(data: bytes, width: int, height: int, bits: int = 8, near: int = 0) -> list[list[int]]:
    return Scan(width, bits, near).walk(height, _Reader(data))


def encoded_together(samples: list[list[list[int]]], by_samples: bool, bits: int = 8, near: int = 0) -> bytes:
    """Components of one size in one scan, line by line or sample by sample."""
    w, scan = _Writer(), Scan(len(samples[0][0]), bits, near)
    (scan.by_samples if by_samples else scan.by_lines)(len(samples[0]), w, len(samples), samples)
    return w.bytes()


def decoded_together(data: bytes, width: int, height: int, components: int, by_samples: bool, bits: int = 8, near: int = 0) -> list[list[list[int]]]:
    scan = Scan(width, bits, near)
    return (scan.by_samples if by_samples else scan.by_lines)(height, _Reader(data), components)


def round_trip_together(px: DataFrame, by_samples: bool, columns: tuple[str, ...] = ("r", "g", "b"), stripe: int = 16, near: int = 0) -> DataFrame:
    """y, x and the columns: a raster's components coded together, stripe by stripe of lines, and decoded again (full lines only)."""

    def coded(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["y", "x"])
        width = int(p.x.max()) + 1
        v = [p[c].to_numpy().reshape(-1, width).tolist() for c in columns]
        got = decoded_together(encoded_together(v, by_samples, near=near), width, len(v[0]), len(columns), by_samples, near=near)
        return p[["y", "x"]].assign(**{c: np.array(g).ravel() for c, g in zip(columns, got, strict=True)})

    lines = px.selectExpr(f"y div {stripe} as image", "y", "x", *columns)
    return lines.groupBy("image").applyInPandas(coded, "y bigint, x bigint, " + ", ".join(f"{c} bigint" for c in columns))


def round_trip(px: DataFrame, column: str = "r", stripe: int = 16, near: int = 0) -> DataFrame:
    """y, x, v, bytes: a raster's stripes of lines coded and decoded again (full lines only)."""

    def coded(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["y", "x"])
        width = int(p.x.max()) + 1
        v = p[column].to_numpy().reshape(-1, width)
        data = encoded(v.tolist(), near=near)
        got = np.array(decoded(data, width, len(v), near=near))
        return pd.DataFrame({"y": p.y.to_numpy(), "x": p.x.to_numpy(), "v": got.ravel(), "bytes": len(data)})

    lines = px.selectExpr(f"y div {stripe} as image", "y", "x", column)
    return lines.groupBy("image").applyInPandas(coded, "y bigint, x bigint, v bigint, bytes bigint")
