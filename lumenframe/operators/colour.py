"""Colour transforms, one projection each: no shuffle, whole-stage code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lumenframe.functions.fixed import COLOUR_BITS, FIX_BITS, clamp, dot, rounded_shift, to_fix

# The luma weights of ITU-R BT.601 and the chroma scaling of ISO/IEC 10918-5.
FORWARD = [
    [to_fix(0.29900), to_fix(0.58700), to_fix(0.11400)],
    [-to_fix(0.1687358916), -to_fix(0.3312641084), to_fix(0.5)],
    [to_fix(0.5), -to_fix(0.4186875892), -to_fix(0.08131241085)],
]
INVERSE = [[to_fix(1.0), 0, to_fix(1.402)], [to_fix(1.0), -to_fix(0.3441362861), -to_fix(0.7141362859)], [to_fix(1.0), to_fix(1.772), 0]]


def rgb_to_ycbcr(px: DataFrame, bits: int = 8, more: tuple[str, ...] = ()) -> DataFrame:
    """r, g, b to y, cb, cr with COLOUR_BITS fractional bits; chroma is offset to the middle, all are clipped."""
    high, shift = ((1 << bits) << COLOUR_BITS) - 1, FIX_BITS - COLOUR_BITS
    offset = [0, 1 << (bits - 1) << FIX_BITS, 1 << (bits - 1) << FIX_BITS]
    out = [clamp(rounded_shift(f"{dot(['r', 'g', 'b'], row)} + {o}L", shift), high) for row, o in zip(FORWARD, offset, strict=True)]
    return px.selectExpr("y as py", "x as px", *[f"{e} as {n}" for e, n in zip(out, ("y", "cb", "cr"), strict=True)], *more)


def ycbcr_to_rgb(px: DataFrame, bits: int = 8, more: tuple[str, ...] = ()) -> DataFrame:
    """The inverse of rgb_to_ycbcr up to rounding, clipped to the range of samples."""
    high, shift, middle = (1 << bits) - 1, FIX_BITS + COLOUR_BITS, 1 << (bits - 1) << COLOUR_BITS
    centred = ["y", f"(cb - {middle}L)", f"(cr - {middle}L)"]
    return px.selectExpr("py", "px", *[f"{clamp(rounded_shift(dot(centred, row), shift), high)} as {n}" for row, n in zip(INVERSE, "rgb", strict=True)], *more)


def identity(px: DataFrame) -> DataFrame:
    """Samples with COLOUR_BITS fractional bits, untransformed."""
    return px.selectExpr("y as py", "x as px", *[f"{c} * {1 << COLOUR_BITS}L as {c}" for c in "rgb"])


def reversible(px: DataFrame) -> DataFrame:
    """The reversible transform: luma and two differences."""
    return px.selectExpr("y as py", "x as px", "shiftright(r + 2 * g + b, 2) as ry", "b - g as cb", "r - g as cr")


def reversible_inverse(px: DataFrame) -> DataFrame:
    green = px.selectExpr("py", "px", "cb", "cr", "ry - shiftright(cb + cr, 2) as g")
    return green.selectExpr("py", "px", "cr + g as r", "g", "cb + g as b")


def lossless_modulo(px: DataFrame, bits: int = 8) -> DataFrame:
    """Differences to green modulo the sample range, centred."""
    n, half = 1 << bits, 1 << (bits - 1)
    return px.selectExpr("y as py", "x as px", f"pmod(r - g + {half}L, {n}L) as dr", "g", f"pmod(b - g + {half}L, {n}L) as db")


def lossless_modulo_inverse(px: DataFrame, bits: int = 8) -> DataFrame:
    n, half = 1 << bits, 1 << (bits - 1)
    return px.selectExpr("py", "px", f"pmod(dr + g - {half}L, {n}L) as r", "g", f"pmod(db + g - {half}L, {n}L) as b")


def freeform(px: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """A 3x3 matrix in fixed point, rounded, not clipped."""
    rows = [[to_fix(c) if c >= 0 else -to_fix(-c) for c in row] for row in matrix]
    return px.selectExpr("y as py", "x as px", *[f"{rounded_shift(dot(['r', 'g', 'b'], row), FIX_BITS)} as c{k}" for k, row in enumerate(rows)])


def inverted(matrix: list[list[float]]) -> list[list[float]]:
    """The inverse matrix, for the other direction of freeform()."""
    return np.linalg.inv(np.array(matrix)).tolist()


def half_to_double(pattern: str) -> str:
    """The value of an IEEE half in an integer's low 16 bits."""
    e, m = f"(shiftright({pattern}, 10) & 31)", f"({pattern} & 1023)"
    sign = f"case when ({pattern} & 32768) <> 0 then -1D else 1D end"
    return f"{sign} * case when {e} = 0 then {m} * pow(2D, -24D) when {e} = 31 then if({m} = 0, double('infinity'), double('nan')) else ({m} + 1024) * pow(2D, cast({e} - 25 as double)) end"


def sign_magnitude(x: str) -> str:
    """A half's bit pattern as a number that grows with its value: negative patterns are complemented."""
    return f"case when ({x} & 32768) <> 0 then -({x} & 32767) - 1 else {x} end"


def four_components(px: DataFrame) -> DataFrame:
    """Three components through rgb_to_ycbcr, the fourth untransformed with COLOUR_BITS fractional bits."""
    return rgb_to_ycbcr(px, more=(f"k * {1 << COLOUR_BITS}L as k",))


# CIE XYZ to linear RGB, and the luma weights of ITU-R BT.709.
XYZ_TO_RGB = [[3.2404542, -1.5371385, -0.4985314], [-0.9692660, 1.8760108, 0.0415560], [0.0556434, -0.2040259, 1.0570000]]
LUMA = [0.2126, 0.7152, 0.0722]


def triple(px: DataFrame, names: tuple[str, str, str], xyz: bool = False, top: float = 1.0) -> DataFrame:
    """py, px, r, g, b, luma, clipped: a triple of samples as read: scaled by the top value, negative ones clipped to 0, before and after the way from XYZ if they are XYZ. clipped: was any?"""
    v = px.selectExpr("y as py", "x as px", *[f"{n} / {top}D as v{k}" for k, n in enumerate(names)])
    v = v.selectExpr("py", "px", "least(v0, v1, v2) < 0 as below", *[f"greatest(v{k}, 0D) as v{k}" for k in range(3)])
    if xyz:
        v = v.selectExpr("py", "px", "below", *[" + ".join(f"v{j} * {c}D" for j, c in enumerate(row)) + f" as v{k}" for k, row in enumerate(XYZ_TO_RGB)])
        v = v.selectExpr("py", "px", "below or least(v0, v1, v2) < 0 as below", *[f"greatest(v{k}, 0D) as v{k}" for k in range(3)])
    luma = " + ".join(f"v{k} * {c}D" for k, c in enumerate(LUMA))
    return v.selectExpr("py", "px", "v0 as r", "v1 as g", "v2 as b", f"{luma} as luma", "below as clipped")
