"""8x8 block transforms and quantization, inside one row for each block: nothing is shuffled.

The forward and inverse transforms are linear in integers up to two rounding shifts, so each pass is a product with
an integer matrix, which is derived from the twelve published constants of the scaled DCT.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, QUANTIZER_BITS = 9, 30


def matrix() -> np.ndarray:
    """(8, 8): frequency by sample, with BITS fractional bits: eight times the orthonormal DCT's rows over sqrt(8)."""
    c = {k: round(v * 512) for k, v in _CONSTANTS.items()}
    m = np.zeros((8, 8), np.int64)
    for i in range(8):
        e = min(i, 7 - i)  # the even part adds mirrored samples, the odd part subtracts them
        sign = 1 if i < 4 else -1
        m[0, i], m[4, i] = 512, 512 if e in (0, 3) else -512
        s12, s13 = {0: 1, 3: -1}.get(e, 0), {1: 1, 2: -1}.get(e, 0)
        z = (s12 + s13) * c["0.541"]
        m[2, i], m[6, i] = z + s12 * c["0.765"], z - s13 * c["1.847"]
        t = [int(e == k) for k in range(4)]
        z = sum(t) * c["1.175"]
        a, b, d, f = -c["0.899"] * (t[0] + t[3]), -c["2.562"] * (t[1] + t[2]), z - c["0.390"] * (t[0] + t[2]), z - c["1.961"] * (t[1] + t[3])
        m[1, i], m[3, i] = sign * (t[0] * c["1.501"] + a + d), sign * (t[1] * c["3.072"] + b + f)
        m[5, i], m[7, i] = sign * (t[2] * c["2.053"] + b + d), sign * (t[3] * c["0.298"] + a + f)
    return m


# The constants of the scaled 8-point DCT.
_CONSTANTS = {
    "0.541": 0.541196100, "0.765": 0.765366865, "1.847": 1.847759065, "1.175": 1.175875602, "1.501": 1.501321110, "3.072": 3.072711026,
    "2.053": 2.053119869, "0.298": 0.298631336, "0.899": 0.899976223, "2.562": 2.562915447, "0.390": 0.390180644, "1.961": 1.961570560,
}

# The luminance table of ITU-T T.81, Annex K, row by row.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]


# The chrominance table of ITU-T T.81, Annex K, row by row.
CHROMINANCE = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]


def zigzag() -> list[int]:
    """The raster index of each place of the zig-zag scan: diagonals in turn, odd ones downwards."""
    return sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else -(k // 8)))


def scaled(table: list[int], quality: int, bits: int = 8, residual_double: bool = False) -> list[int]:
    """A quantization table for a quality of 1 to 100."""
    q = min(max(quality, 1), 100)
    scale = 5000 // q if q < 50 else 200 - 2 * q
    high = 32767 if bits >= 12 else 255
    out = [min(max((t * scale + 50) // 100, 1), high) for t in table]
    return [2 * d for d in out] if residual_double else out


def scaled_rows(rows: DataFrame, table: list[int], high: int = 255, residual_double: bool = False) -> DataFrame:
    """key, k, delta from rows (key, quality): `scaled` for qualities that are data."""
    scale = "if(q < 50, 5000 div q, 200 - 2 * q)"
    r = rows.selectExpr("key", "greatest(1L, least(100L, quality)) as q", f"posexplode({_array(table)}) as (k, t)")
    return r.selectExpr("key", "k", f"{2 if residual_double else 1}L * least({high}L, greatest(1L, (t * {scale} + 50) div 100)) as delta")


def reciprocals(deltas: list[int]) -> list[int]:
    """2**30 / delta in single precision, rounded half up (the half is added in double precision)."""
    return [int(float(np.float32(1 << QUANTIZER_BITS) / np.float32(d)) + 0.5) for d in deltas]


def _array(values) -> str:
    return "array(" + ", ".join(f"{int(v)}L" for v in values) + ")"


def _pass(source: str, rows: bool) -> str:
    """64 sums: for each frequency and line, the products of matrix row and line. rows: along rows, else along columns."""
    m = _array(matrix().ravel())
    if rows:  # output (y, f): line y, frequency f
        at, f = "shiftleft(shiftright(i, 3), 3) + {k}", "(i & 7)"
    else:  # output (f, x)
        at, f = "{k8} + (i & 7)", "shiftright(i, 3)"
    terms = " + ".join(f"get({m}, {f} * 8 + {k}) * get(s, {at.format(k=k, k8=8 * k)})" for k in range(8))
    return f"get(transform(array({source}), s -> transform(sequence(0, 63), i -> {terms})), 0)"


def fdct(blocks: DataFrame, preshift: int = 0, level: int = 128) -> DataFrame:
    """block, t: transform coefficients with BITS + 3 fractional bits, before quantization; the level is taken off the DC."""
    first = blocks.selectExpr("*", f"transform({_pass('v', False)}, c -> shiftright(c + 256L, 9)) as u")
    offset = level << (preshift + 6) << BITS
    return first.selectExpr("block", f"transform({_pass('u', True)}, (c, i) -> if(i = 0, c - {offset}L, c)) as t")


def quantized(t: DataFrame, deltas: list[int], preshift: int = 0, deadzone: bool = False) -> DataFrame:
    """block, q: rounded quotients; with a dead zone, AC coefficients below 5/8 of a step are 0."""
    s = BITS + QUANTIZER_BITS + preshift + 3
    half = f"get({_array(reciprocals(deltas))}, i) * c + if(c > 0, 1L, 0L) + {1 << (s - 1)}L"
    if deadzone:
        half = f"if(i = 0, {half}, get({_array(reciprocals(deltas))}, i) * c + if(c < 0, {(1 << (s - 2)) - 1}L, 0L) + {3 << (s - 3)}L)"
    return t.selectExpr("block", f"transform(t, (c, i) -> shiftright({half}, {s})) as q")


def dequantized(q: DataFrame, deltas: list[int], preshift: int = 0) -> DataFrame:
    return q.selectExpr("block", f"transform(q, (c, i) -> c * get({_array(d << preshift for d in deltas)}, i)) as c")


def idct(c: DataFrame, level: int = 128, high: int = 255) -> DataFrame:
    """block, v: samples from dequantized coefficients: products with the transposed matrix, rounded, level added, clipped."""
    m = _array(matrix().T.ravel())

    def passed(source: str, rows: bool) -> str:
        at, f = ("shiftleft(shiftright(i, 3), 3) + {k}", "(i & 7)") if rows else ("{k8} + (i & 7)", "shiftright(i, 3)")
        terms = " + ".join(f"get({m}, {f} * 8 + {k}) * get(s, {at.format(k=k, k8=8 * k)})" for k in range(8))
        return f"get(transform(array({source}), s -> transform(sequence(0, 63), i -> {terms})), 0)"

    first = c.selectExpr("block", f"transform({passed('c', True)}, x -> shiftright(x + 256L, 9)) as u")
    return first.selectExpr("block", f"transform({passed('u', False)}, x -> greatest(0L, least({high}L, shiftright(x + 2048L, 12) + {level}L))) as v")


def exploded(df: DataFrame, column: str, name: str = "v") -> DataFrame:
    return df.selectExpr("block", f"posexplode({column}) as (k, {name})")


def flagship(blocks: DataFrame, quality: int = 75) -> DataFrame:
    """For each frequency: nonzero coefficients and their absolute sum, after DCT and quantization."""
    q = exploded(quantized(fdct(blocks), scaled(LUMINANCE, quality)), "q")
    return q.groupBy("k").agg(F.count(F.when(F.col("v") != 0, 1)).alias("nonzero"), F.sum(F.abs("v")).alias("magnitude"))
