"""Regions, component selection, MCU layout and resampling of pixel relations (y, x and sample columns)."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.fixed import clamp


def region(px: DataFrame, left: int, top: int, right: int, bottom: int, components: str = "rgb") -> DataFrame:
    """The pixels of a rectangle (borders included) and some components; both reach the scan."""
    return px.where(F.col("y").between(top, bottom) & F.col("x").between(left, right)).select("y", "x", *components)


def block_inside(px: DataFrame, left: int, top: int, right: int, bottom: int) -> DataFrame:
    """by, bx, inside: does a requested region hold the whole 8x8 block?"""
    b = px.selectExpr("y div 8 as by", "x div 8 as bx").distinct()
    return b.selectExpr("by", "bx", f"bx * 8 >= {left} and bx * 8 + 7 <= {right} and by * 8 >= {top} and by * 8 + 7 <= {bottom} as inside")


def subsampled_region(left: int, top: int, right: int, bottom: int, sx: int, sy: int) -> tuple[int, int, int, int]:
    """A region in the coordinates of a subsampled component: all samples that touch it."""
    return left // sx, top // sy, -(-(right + 1) // sx) - 1, -(-(bottom + 1) // sy) - 1


def every(px: DataFrame, sx: int, sy: int, ox: int = 0, oy: int = 0) -> DataFrame:
    """A strided view."""
    return px.where((F.col("x") % sx == ox) & (F.col("y") % sy == oy)).selectExpr(f"y div {sy} as y", f"x div {sx} as x", "r", "g", "b")


def clipped(px: DataFrame, low: int, high: int, bits: int) -> DataFrame:
    """y, x, clip (to the range), wrap (to the low bits)."""
    return px.selectExpr("y", "x", f"{clamp('r * 3 - 200', high, low)} as clip", f"(r * 3 - 200) & {(1 << bits) - 1}L as wrap")


def mcu_size(factors: list[tuple[int, int]]) -> tuple[int, int]:
    """Least common multiples of the components' subsampling factors."""
    w = h = 1
    for sx, sy in factors:
        w, h = w * sx // gcd(w, sx), h * sy // gcd(h, sy)
    return w, h


def mcu_sizes(rows: DataFrame, factors: list[tuple[str, str]], key: str) -> DataFrame:
    """key, w, h from rows: mcu_size for factors (1 to 4) that are columns."""
    least = lambda f: f"element_at(filter(sequence(1L, 12L), m -> {' and '.join(f'm % {x} = 0' for x in f)}), 1)"
    return rows.selectExpr(key, *[f"{least(f)} as {n}" for f, n in zip(zip(*factors, strict=True), "wh", strict=True)])


def mcu_order(px: DataFrame, mcus: int) -> DataFrame:
    """comp, by, bx, mcu, place: where each block of a 4:2:0 image with `mcus` MCUs in a row comes in the interleaved scan."""
    b = px.selectExpr("y div 8 as by", "x div 8 as bx").distinct()
    luma = b.selectExpr("0 as comp", "by", "bx", f"by div 2 * {mcus} + bx div 2 as mcu", "by % 2 * 2 + bx % 2 as place")
    chroma = b.selectExpr("by div 2 as by", "bx div 2 as bx").distinct()
    two = [chroma.selectExpr(f"{c} as comp", "by", "bx", f"by * {mcus} + bx as mcu", f"{3 + c}L as place") for c in (1, 2)]
    return luma.unionByName(two[0]).unionByName(two[1])


def downsampled(px: DataFrame, sx: int, sy: int, column: str = "r") -> DataFrame:
    """Box means, divided toward zero. A partial last group of columns repeats each line's last sample; a partial last group of lines is divided by the lines that are there."""
    last = F.lead("x").over(Window.partitionBy("y").orderBy("x")).isNull()
    w = px.select("y", "x", F.col(column).alias("c"), F.when(last, F.expr(f"{sx} - x % {sx}")).otherwise(1).alias("w"))
    return w.groupBy(F.expr(f"y div {sy}").alias("y"), F.expr(f"x div {sx}").alias("x")).agg(F.expr(f"sum(c * w) div (count(distinct y) * {sx})").alias("v"))


#: Centred interpolation between a sample c and its neighbours (t and b above and below, l and r at the sides), by factor. Vertical rounding alternates with the column's parity.
_ODD = "(x % 2)"
_UP, _DOWN = f"shiftright(t + 3 * c + 2 - {_ODD}, 2)", f"shiftright(b + 3 * c + 1 + {_ODD}, 2)"
ROW_RULES = {
    2: [_UP, _DOWN],
    3: [_UP, "c", _DOWN],
    4: [f"shiftright(3 * t + 5 * c + 4 - {_ODD}, 3)", f"shiftright(t + 7 * c + 3 + {_ODD}, 3)", f"shiftright(b + 7 * c + 4 - {_ODD}, 3)", f"shiftright(3 * b + 5 * c + 3 + {_ODD}, 3)"],
}
_LEFT, _RIGHT = "shiftright(l + 3 * c + 2, 2)", "shiftright(r + 3 * c + 1, 2)"
COLUMN_RULES = {2: [_LEFT, _RIGHT], 3: [_LEFT, "c", _RIGHT], 4: ["shiftright(3 * l + 5 * c + 2, 3)", "shiftright(l + 7 * c + 1, 3)", "shiftright(r + 7 * c + 2, 3)", "shiftright(3 * r + 5 * c + 1, 3)"]}


def upsampled_rows(px: DataFrame, factor: int, column: str = "r") -> DataFrame:
    """Centred vertical interpolation by 2, 3 or 4; rounding alternates with the column's parity, edges are replicated."""
    w = Window.partitionBy("x").orderBy("y")
    near = px.select("x", "y", F.col(column).alias("c"), F.coalesce(F.lag(column).over(w), column).alias("t"), F.coalesce(F.lead(column).over(w), column).alias("b"))
    return near.selectExpr("x", "y", f"posexplode(array({', '.join(ROW_RULES[factor])})) as (k, v)").selectExpr(f"y * {factor} + k as y", "x", "v")


def upsampled_columns(px: DataFrame, factor: int, column: str = "r") -> DataFrame:
    """Centred horizontal interpolation by 2, 3 or 4."""
    w = Window.partitionBy("y").orderBy("x")
    near = px.select("x", "y", F.col(column).alias("c"), F.coalesce(F.lag(column).over(w), column).alias("l"), F.coalesce(F.lead(column).over(w), column).alias("r"))
    return near.selectExpr("x", "y", f"posexplode(array({', '.join(COLUMN_RULES[factor])})) as (k, v)").selectExpr("y", f"x * {factor} + k as x", "v")


def upsampled(samples: DataFrame) -> DataFrame:
    """image, comp, y, x, v from samples (image, comp, y, x, v, fx, fy): each component of each image by its own factors (1 to 4), columns after rows.

    A window is one column or one line of one component, so no image is one task.
    """
    pick = lambda f, rules: f"case {f} " + " ".join(f"when {n} then array({', '.join(r)})" for n, r in rules.items()) + " else array(c) end"
    sides = lambda w, one, two: [F.col("v").alias("c"), F.coalesce(F.lag("v").over(w), "v").alias(one), F.coalesce(F.lead("v").over(w), "v").alias(two)]
    down = samples.select("image", "comp", "x", "y", "fx", "fy", *sides(Window.partitionBy("image", "comp", "x").orderBy("y"), "t", "b"))
    down = down.selectExpr("image", "comp", "x", "y", "fx", "fy", f"posexplode({pick('fy', ROW_RULES)}) as (k, v)").selectExpr("image", "comp", "y * fy + k as y", "x", "fx", "v")
    across = down.select("image", "comp", "x", "y", "fx", *sides(Window.partitionBy("image", "comp", "y").orderBy("x"), "l", "r"))
    return across.selectExpr("image", "comp", "x", "y", "fx", f"posexplode({pick('fx', COLUMN_RULES)}) as (k, v)").selectExpr("image", "comp", "y", "x * fx + k as x", "v")


def smoothed_half(px: DataFrame, column: str = "r") -> DataFrame:
    """y, x, v: half size by the kernel (1, 3, 3, 1) in both directions, edges replicated, divided toward zero."""
    row = Window.partitionBy("y").orderBy("x")
    pair = px.select("y", "x", F.col(column).alias("c0"), F.lead(column).over(row).alias("c1"), F.lag(column).over(row).alias("l"), F.lead(column, 2).over(row).alias("r")).where("x % 2 = 0")
    across = pair.selectExpr("y", "x div 2 as x", "shiftright(coalesce(l, c0) + 3 * c0 + 3 * coalesce(c1, c0) + coalesce(r, c1, c0) + 2, 2) as h")
    col = Window.partitionBy("x").orderBy("y")
    lines = across.select("y", "x", "h", F.lag("h").over(col).alias("above"), F.lead("h").over(col).alias("next"), F.lead("h", 2).over(col).alias("below")).where("y % 2 = 0")
    return lines.selectExpr("y div 2 as y", "x", "(coalesce(above, h) + 3 * h + 3 * coalesce(next, h) + coalesce(below, next, h)) div 16 as v")
