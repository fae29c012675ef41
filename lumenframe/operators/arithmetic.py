"""Binary arithmetic coding of scans (ITU-T T.81, Annexes D, F, G and H): one restart segment a group.

A coder takes decisions (context, bit) one by one. Each procedure below is written once for both directions: the
encoder is told the bit, the decoder ignores what it is told and says what it read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import scans as S

# The probability estimation of ITU-T T.81, Table D.3 (state 113, of probability one half, stays).
QE = [
    0x5A1D, 0x2586, 0x1114, 0x080B, 0x03D8, 0x01DA, 0x00E5, 0x006F, 0x0036, 0x001A, 0x000D, 0x0006, 0x0003, 0x0001, 0x5A7F, 0x3F25, 0x2CF2, 0x207C, 0x17B9, 0x1182, 0x0CEF, 0x09A1, 0x072F, 0x055C,
    0x0406, 0x0303, 0x0240, 0x01B1, 0x0144, 0x00F5, 0x00B7, 0x008A, 0x0068, 0x004E, 0x003B, 0x002C, 0x5AE1, 0x484C, 0x3A0D, 0x2EF1, 0x261F, 0x1F33, 0x19A8, 0x1518, 0x1177, 0x0E74, 0x0BFB, 0x09F8,
    0x0861, 0x0706, 0x05CD, 0x04DE, 0x040F, 0x0363, 0x02D4, 0x025C, 0x01F8, 0x01A4, 0x0160, 0x0125, 0x00F6, 0x00CB, 0x00AB, 0x008F, 0x5B12, 0x4D04, 0x412C, 0x37D8, 0x2FE8, 0x293C, 0x2379, 0x1EDF,
    0x1AA9, 0x174E, 0x1424, 0x119C, 0x0F6B, 0x0D51, 0x0BB6, 0x0A40, 0x5832, 0x4D1C, 0x438E, 0x3BDD, 0x34EE, 0x2EAE, 0x299A, 0x2516, 0x5570, 0x4CA9, 0x44D9, 0x3E22, 0x3824, 0x32B4, 0x2E17, 0x56A8,
    0x4F46, 0x47E5, 0x41CF, 0x3C3D, 0x375E, 0x5231, 0x4C0F, 0x4639, 0x415E, 0x5627, 0x50E7, 0x4B85, 0x5597, 0x504F, 0x5A10, 0x5522, 0x59EB, 0x5A1D,
]
NEXT_MPS = [
    1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 13, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 9, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 52,
    53, 54, 55, 56, 57, 58, 59, 60, 61, 62, 63, 32, 65, 66, 67, 68, 69, 70, 71, 72, 73, 74, 75, 76, 77, 78, 79, 48, 81, 82, 83, 84, 85, 86, 87, 71, 89, 90, 91, 92, 93, 94, 86, 96, 97, 98, 99, 100, 93,
    102, 103, 104, 99, 106, 107, 103, 109, 107, 111, 109, 111, 113,
]
NEXT_LPS = [
    1, 14, 16, 18, 20, 23, 25, 28, 30, 33, 35, 9, 10, 12, 15, 36, 38, 39, 40, 42, 43, 45, 46, 48, 49, 51, 52, 54, 56, 57, 59, 60, 62, 63, 32, 33, 37, 64, 65, 67, 68, 69, 70, 72, 73, 74, 75, 77, 78, 79,
    48, 50, 50, 51, 52, 53, 54, 55, 56, 57, 58, 59, 61, 61, 65, 80, 81, 82, 83, 84, 86, 87, 87, 72, 72, 74, 74, 75, 77, 77, 80, 88, 89, 90, 91, 92, 93, 86, 88, 95, 96, 97, 99, 99, 93, 95, 101, 102,
    103, 104, 99, 105, 106, 107, 103, 105, 108, 109, 110, 111, 110, 112, 112, 113,
]
SWITCH = {0, 14, 36, 64, 80, 88, 95, 105, 110, 112}
FIXED = 113


class Coder:
    """States of the contexts: [index, more probable symbol]; FIXED contexts are made by name."""

    def __init__(self):
        self.states = defaultdict(lambda: [0, 0])
        self.states["half"] = [FIXED, 0]
        self.a = 0x10000

    def _learn(self, state: list[int], less: bool) -> None:
        if less:
            if state[0] in SWITCH:
                state[1] ^= 1
            state[0] = NEXT_LPS[state[0]]
        else:
            state[0] = NEXT_MPS[state[0]]


class Encoder(Coder):
    """The code string is kept as one number, so carries need no care; `shifts` is how often it was doubled."""

    def __init__(self):
        super().__init__()
        self.c, self.shifts = 0, 0

    def code(self, context, bit: int) -> int:
        state = self.states[context]
        q, bit = QE[state[0]], int(bool(bit))
        self.a -= q
        less = bit != state[1]
        if not less and self.a & 0x18000:
            return bit
        if less == (self.a >= q):  # the upper interval: of the less probable symbol, or of the other where it is the smaller one
            self.c, self.a = self.c + self.a, q
        self._learn(state, less)
        n = 16 - self.a.bit_length()
        self.a, self.c, self.shifts = self.a << n, self.c << n, self.shifts + n
        return bit

    def bytes(self) -> bytes:
        """The string with the most zeros at its end inside the last interval, without these; a 0 byte after each FF."""
        t = (self.c + self.a - 1) >> 16 << 16
        t += 0x8000 if t < self.c else 0
        n = 16 + self.shifts
        out = (t << (-n % 8)).to_bytes((n + 7) // 8 + 1, "big")[1:].rstrip(b"\0")
        return out.replace(b"\xff", b"\xff\x00")


class Decoder(Coder):
    """Beyond the data are zeros."""

    def __init__(self, data: bytes):
        super().__init__()
        raw = data.replace(b"\xff\x00", b"\xff")
        self.bits, self.n = int.from_bytes(raw, "big"), 8 * len(raw)
        self.at, self.x = 16, (self.bits << 16 >> self.n) & 0xFFFF if self.n else 0
        self.raw = raw

    def _bit(self) -> int:
        k = self.at >> 3
        b = self.raw[k] >> (7 - (self.at & 7)) & 1 if k < len(self.raw) else 0
        self.at += 1
        return b

    def code(self, context, bit=None) -> int:
        state = self.states[context]
        q = QE[state[0]]
        self.a -= q
        if self.x < self.a:
            if self.a & 0x18000:
                return state[1]
            less = self.a < q
        else:
            less = self.a >= q
            self.x, self.a = self.x - self.a, q
        out = state[1] ^ less
        self._learn(state, less)
        while not self.a & 0x18000:
            self.a, self.x = self.a << 1, self.x << 1 | self._bit()
        return int(out)


def magnitude(c: Coder, x, m, size: int, first: int, limit: int) -> int:
    """The number size >= first (a power of two): how many doublings reach it (contexts x and a count), then its lower bits (contexts m)."""
    top, k = first, 0
    while c.code((*x, k), size >= 2 * top):
        top, k = 2 * top, k + 1
        if k > limit:
            raise ValueError("out of step")
    out, low = top, top >> 1
    while low:
        if c.code((*m, k), size & low):
            out |= low
        low >>= 1
    return out


def difference(c: Coder, where: tuple, x: tuple, m: tuple, v: int) -> int:
    """A signed number: zero?, sign, one?, then its magnitude less one; the first three in the contexts of `where`."""
    if not c.code((*where, "zero"), v != 0):
        return 0
    minus = c.code((*where, "sign"), v < 0)
    size = abs(v) - 1
    if c.code((*where, "minus" if minus else "plus"), size >= 1):
        size = magnitude(c, x, m, size, 1, 15)
    else:
        size = 0
    return -size - 1 if minus else size + 1


def kind(v: int, low: int, high: int) -> int:
    """The class of a former difference: 0 small, 1 and 2 positive (medium, large), 3 and 4 negative."""
    bottom, top = (1 << low) >> 1, 1 << high
    if abs(v) <= bottom:
        return 0
    return (1 if v > 0 else 3) + (abs(v) > top)


def sequential(c: Coder, rows: list, cond: dict, ss: int, se: int, ah: int, al: int) -> None:
    """Sequential and first progressive passes over blocks (component, zig-zag coefficients). Reading fills the blocks in."""
    before, last = defaultdict(int), defaultdict(int)
    reading = isinstance(c, Decoder)
    for comp, q in rows:
        t = min(comp, 1)
        if ss == 0:
            v = difference(c, ("dc", t, kind(last[comp], *cond[0, comp])), ("dx", t), ("dm", t), (q[0] >> al) - before[comp])
            last[comp], before[comp] = v, before[comp] + v
            if reading:
                q[0] = before[comp] << al
        k = max(ss, 1)
        band = [] if reading else [(abs(v) >> al) * (1 if v > 0 else -1) for v in q]
        eob = next((j for j in range(se, k - 1, -1) if not reading and band[j]), k - 1) + 1
        while k <= se and not c.code(("eob", t, k), k == eob):
            while not c.code(("some", t, k), not reading and band[k] != 0):
                k += 1
                if k > se:
                    raise ValueError("out of step")
            v = 0 if reading else band[k]
            minus = c.code("half", v < 0)
            size = abs(v) - 1
            if not c.code(("more", t, k), size >= 1):
                size = 0
            elif not c.code(("more", t, k), size >= 2):
                size = 1
            else:
                side = "high" if k > cond[1, comp][0] else "low"
                size = magnitude(c, ("ax", t, side), ("am", t, side), size, 2, 15)
            if reading:
                q[k] = (-size - 1 if minus else size + 1) * (1 << al)
            k += 1


def refining(c: Coder, rows: list, cond: dict, ss: int, se: int, ah: int, al: int) -> None:
    """The next lower bit of coefficients."""
    reading, one = isinstance(c, Decoder), 1 << al
    for comp, q in rows:
        t = min(comp, 1)
        if ss == 0:
            bit = c.code("half", q[0] >> al & 1)
            if reading:
                q[0] |= bit << al
            continue
        full = [abs(v) >> al for v in q]  # when reading, all of these are even
        old = next((j for j in range(se, ss - 1, -1) if full[j] > 1), ss - 1) + 1
        eob = next((j for j in range(se, ss - 1, -1) if not reading and full[j]), ss - 1) + 1
        k = ss
        while k <= se:
            if k >= old and c.code(("end", t, k), k == eob):
                break
            while True:
                if full[k] > 1:
                    if c.code(("bit", t, k), full[k] & 1) and reading:
                        q[k] += one if q[k] > 0 else -one
                    break
                if c.code(("new", t, k), full[k] == 1):
                    minus = c.code("half", q[k] < 0)
                    if reading:
                        q[k] = -one if minus else one
                    break
                k += 1
                if k > se:
                    raise ValueError("out of step")
            k += 1


def read(data: bytes, rows: list, cond: dict, ss: int, se: int, ah: int, al: int) -> None:
    """A segment's blocks filled in: `coder` of scans.decode."""
    (refining if ah else sequential)(Decoder(data), rows, cond, ss, se, ah, al)


def segments(blocks: DataFrame, scans: DataFrame, g: S.Geometry, interval: int = 0, low: int = 0, high: int = 1, band: int = 5) -> DataFrame:
    """image, scan, seg, data: each restart segment of each scan."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r, rows in S.ordered(b):
                c = Encoder()
                cond = {(tc, k): (low, high) if tc == 0 else (band, None) for tc in (0, 1) for k in {k for k, _ in rows}}
                (refining if r["ah"] else sequential)(c, rows, cond, r["ss"], r["se"], r["ah"], r["al"])
                out.append(c.bytes())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("image", "scan", "seg")), pa.array(out, pa.binary())], names=["image", "scan", "seg", "data"])

    return S.grouped(blocks, scans, g, interval).mapInArrow(coded, "image bigint, scan bigint, seg bigint, data binary")


# ---- predictive lossless scans


def lossless(c: Coder, e: np.ndarray | None, width: int, height: int, low: int = 0, high: int = 1) -> np.ndarray:
    """Prediction errors (height, width): contexts are the classes of the errors to the left and above."""
    out = np.zeros((height, width), np.int64)
    for y in range(height):
        for x in range(width):
            left, above = int(out[y, x - 1]) if x else 0, int(out[y - 1, x]) if y else 0
            side = "high" if abs(above) > 1 << high else "low"
            out[y, x] = difference(c, ("dc", kind(left, low, high), kind(above, low, high)), ("x", side), ("m", side), int(e[y, x]) if e is not None else 0)
    return out


def lossless_round_trip(errors: DataFrame, rows: int, width: int) -> DataFrame:
    """y, x, e, bytes: prediction errors (y, x, e) coded in restart segments of `rows` lines and read back."""

    def both(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["y", "x"])
        first, n = int(p.y.min()), int(p.y.max() - p.y.min()) + 1
        e = np.zeros((n, width), np.int64)
        e[p.y - first, p.x] = p.e
        c = Encoder()
        lossless(c, e, width, n)
        data = c.bytes()
        back = lossless(Decoder(data), None, width, n)
        return pd.DataFrame({"y": p.y, "x": p.x, "e": back[p.y - first, p.x], "bytes": len(data)})

    return errors.select("y", "x", "e", F.expr(f"y div {rows}").alias("seg")).groupBy("seg").applyInPandas(lambda p: both(p), "y bigint, x bigint, e bigint, bytes bigint")
