"""Prediction from neighbouring samples: DPCM, the lossless predictors and the near-lossless contexts.

Neighbours come from windows along rows, columns and diagonals, so work spreads over the lines of every image.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.fixed import signed16

#: Predictions from a (left), b (above) and c (above left), by mode.
MODES = {1: "a", 2: "b", 3: "c", 4: "a + b - c", 5: "a + shiftright(b - c, 1)", 6: "b + shiftright(a - c, 1)", 7: "shiftright(a + b, 1)"}


def neighbours(px: DataFrame, column: str = "r", shift: int = 0) -> DataFrame:
    """y, x, v, a, b, c, d: a sample and those left, above, above left and above right of it (null outside)."""
    v = px.select("y", "x", F.shiftright(column, shift).alias("v"), (F.col("x") - F.col("y")).alias("down"), (F.col("x") + F.col("y")).alias("up"))
    row, col = Window.partitionBy("y").orderBy("x"), Window.partitionBy("x").orderBy("y")
    down, up = Window.partitionBy("down").orderBy("y"), Window.partitionBy("up").orderBy("y")
    return v.select("y", "x", "v", F.lag("v").over(row).alias("a"), F.lag("v").over(col).alias("b"), F.lag("v").over(down).alias("c"), F.lag("v").over(up).alias("d"))


def residuals(px: DataFrame, mode: int, bits: int = 8, shift: int = 0) -> DataFrame:
    """y, x, e: 16-bit prediction errors; the first sample is predicted by the middle, the first row from the left, the first column from above."""
    rule = f"case when x = 0 and y = 0 then {1 << (bits - shift - 1)}L when y = 0 then a when x = 0 then b else {MODES[mode]} end"
    return neighbours(px, "r", shift).selectExpr("y", "x", f"{signed16(f'v - ({rule})')} as e")


def restored_left(e: DataFrame, bits: int = 8) -> DataFrame:
    """The samples of mode 1 errors: sums down the first column, then along each row, modulo 2**16."""
    first = e.where("x = 0").selectExpr("y", f"sum(e) over (order by y) + {1 << (bits - 1)}L as start")
    return e.join(first, "y").selectExpr("y", "x", "(start + sum(if(x = 0, 0L, e)) over (partition by y order by x)) & 65535L as v")


def restored_top(e: DataFrame, bits: int = 8) -> DataFrame:
    """The samples of mode 2 errors: sums along the first row, then down each column, modulo 2**16."""
    first = e.where("y = 0").selectExpr("x", f"sum(e) over (order by x) + {1 << (bits - 1)}L as start")
    return e.join(first, "x").selectExpr("y", "x", "(start + sum(if(y = 0, 0L, e)) over (partition by x order by y)) & 65535L as v")


def restored_corner(e: DataFrame, bits: int = 8) -> DataFrame:
    """The samples of mode 3 errors: the first row and column by sums, then sums along each diagonal from there."""
    row = e.where("y = 0").selectExpr("x - y as down", f"sum(e) over (order by x) + {1 << (bits - 1)}L as start")
    column = e.where("x = 0").selectExpr("y", "x - y as down", f"sum(e) over (order by y) + {1 << (bits - 1)}L as start").where("y > 0").select("down", "start")
    return e.selectExpr("*", "x - y as down").join(row.unionByName(column), "down").selectExpr("y", "x", "(start + sum(if(x = 0 or y = 0, 0L, e)) over (partition by down order by y)) & 65535L as v")


def restored_linear(e: DataFrame, bits: int = 8) -> DataFrame:
    """The samples of mode 4 errors: sums along rows, then down columns, modulo 2**16."""
    rows = e.selectExpr("y", "x", "sum(e) over (partition by y order by x) as s")
    return rows.selectExpr("y", "x", f"({1 << (bits - 1)}L + sum(s) over (partition by x order by y)) & 65535L as v")


def dpcm(segments: DataFrame) -> DataFrame:
    """seg, mcu, diff: DC differences; prediction starts anew in each restart segment."""
    w = Window.partitionBy("seg").orderBy("mcu")
    return segments.select("seg", "mcu", (F.col("dc") - F.coalesce(F.lag("dc").over(w), F.lit(0))).alias("diff"))


def dpcm_inverse(diffs: DataFrame) -> DataFrame:
    w = Window.partitionBy("seg").orderBy("mcu")
    return diffs.select("seg", "mcu", F.sum("diff").over(w).alias("dc"))


def thresholds(bits: int, near: int = 0) -> tuple[int, int, int]:
    """The default context thresholds for a precision and a permitted error."""
    top = (1 << bits) - 1
    if top >= 128:
        f = (min(top, 4095) + 128) >> 8
        t = [f * (3 - 2) + 2 + 3 * near, f * (7 - 3) + 3 + 5 * near, f * (21 - 4) + 4 + 7 * near]
    else:
        f = 256 // (top + 1)
        t = [max(2, 3 // f + 3 * near), max(3, 7 // f + 5 * near), max(4, 21 // f + 7 * near)]
    low = near + 1
    for k in range(3):
        if not low <= t[k] <= top:
            t[k] = low
        low = t[k]
    return tuple(t)


def contexts(px: DataFrame, bits: int = 8, near: int = 0) -> DataFrame:
    """y, x, p, ctx, negative, run: the median prediction, the context index after sign folding, and whether run mode applies."""
    t1, t2, t3 = thresholds(bits, near)
    # Left of column 0 lies the sample above; so its corner is what lay left of the line above: the first sample two lines up.
    n = neighbours(px).withColumn("start", F.lag("v", 2).over(Window.partitionBy("x").orderBy("y")))
    n = n.selectExpr("y", "x", "coalesce(a, b, 0L) as a", "coalesce(b, 0L) as b", "coalesce(c, if(x = 0, start, null), 0L) as c", "coalesce(d, b, 0L) as d")
    p = "case when c >= greatest(a, b) then least(a, b) when c <= least(a, b) then greatest(a, b) else a + b - c end"

    def quantized(g: str) -> str:
        steps = [(f"<= -{t3}", -4), (f"<= -{t2}", -3), (f"<= -{t1}", -2), (f"< -{near}", -1), (f"<= {near}", 0), (f"< {t1}", 1), (f"< {t2}", 2), (f"< {t3}", 3)]
        return "case " + " ".join(f"when {g} {test} then {v}" for test, v in steps) + " else 4 end"

    q = n.selectExpr("y", "x", f"{p} as p", f"{quantized('(d - b)')} as q1", f"{quantized('(b - c)')} as q2", f"{quantized('(c - a)')} as q3")
    q = q.selectExpr("*", "q1 * 81 + q2 * 9 + q3 < 0 as negative")
    return q.selectExpr("y", "x", "p", "if(negative, -1, 1) * (q1 * 81 + q2 * 9 + q3) + 42 as ctx", "negative", "q1 = 0 and q2 = 0 and q3 = 0 as run")
