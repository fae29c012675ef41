"""Tone tables: from joint histograms to the inverse map, inversion of tables, and numbers by their bits.

A table has at most 65,536 rows, whatever the images: steps that walk along it run in one group a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def anchors(hist: DataFrame, levels: int, median: bool = False) -> DataFrame:
    """ldr, w, low, high from a joint histogram (ldr, hdr, n): the HDR value each LDR value stands for.

    The weighted mean; or, asked for, the least value that half of the samples don't exceed (if there are two samples or
    more). Where the values of one LDR value spread over more than half of all levels, half of their spread.
    """
    run = "sum(n) over (partition by ldr order by hdr)"
    h = hist.selectExpr("ldr", "hdr", "n", f"{run} as upto", "sum(n) over (partition by ldr) as total")
    m = "min(if(upto >= total div 2, hdr, null))" if median else "null"
    mean = "sum(hdr * n) / cast(sum(n) as double)"
    g = h.groupBy("ldr").agg(*[_expr(e, k) for e, k in (("min(hdr)", "low"), ("max(hdr)", "high"), (mean, "mean"), (m, "mid"), ("sum(n)", "n"))])
    return g.selectExpr("ldr", f"case when high - low > {levels >> 1} then cast(shiftright(high - low, 1) as double) when mid is not null and n > 1 then cast(mid as double) else mean end as w", "low", "high")


def _expr(e: str, name: str):
    from pyspark.sql import functions as F

    return F.expr(e).alias(name)


def filled(w: np.ndarray, low: float, high: float) -> np.ndarray:
    """Missing values (nan) by straight lines between their neighbours; before the first lies low, after the last high."""
    known = np.flatnonzero(~np.isnan(w))
    at, v = known.astype(float), w[known]
    if not len(known) or known[0] > 0:
        at, v = np.append(0.0, at), np.append(low, v)
    return np.interp(np.arange(len(w)), np.append(at, len(w)), np.append(v, high))


def ascending(w: np.ndarray) -> np.ndarray:
    """The table made to grow by one at least from step to step, within its own range as far as that goes."""
    w, low, high = w.copy(), w.min(), w.max()
    if w[0] > low:  # what falls at the start lies on the line from the least value
        line = low + np.arange(len(w))
        head = int(np.argmin(np.append(w >= line, False)))
        w[:head] = line[:head]
    now = int(w[0]) - 1
    for k in range(len(w)):
        if w[k] <= now:
            w[k] = min(now + 1, high) if now + 1 < high else high
        now = int(w[k])
    if high > w[-1]:
        now = int(w[-1]) + 1
        for k in range(len(w) - 1, -1, -1):
            if w[k] >= now:
                w[k] = now - 1 if now - 1 > low else low + k
            now = int(w[k])
    return w


def smoothed(w: np.ndarray, times: int) -> np.ndarray:
    """The kernel (1, 2, 1) / 4 on odd places, then on even ones, so many times; the ends stay."""
    w = w.copy()
    for _ in range(times):
        for first in (1, 2):
            k = np.arange(first, len(w) - 1, 2)
            w[k] = 0.25 * w[k - 1] + 0.5 * w[k] + 0.25 * w[k + 1]
    return w


def expanded(w: np.ndarray, bits: int) -> np.ndarray:
    """2**bits steps between neighbours, cut to whole numbers."""
    at = np.arange(len(w) << bits) / (1 << bits)
    return np.floor(np.interp(at, np.arange(len(w)), w)).astype(np.int64)


def inverse_map(hist: DataFrame, levels: int, median: bool = False, smooth: int = 0, bits: int = 0, size: int = 256) -> DataFrame:
    """comp, i, w from a joint histogram (comp, ldr, hdr, n): for each component the whole map from LDR to HDR: anchors, holes filled, ascending, smoothed, expanded."""
    run = "sum(n) over (partition by comp, ldr order by hdr)"
    h = hist.selectExpr("comp", "ldr", "hdr", "n", f"{run} as upto", "sum(n) over (partition by comp, ldr) as total")
    g = h.groupBy("comp", "ldr").agg(*[_expr(e, k) for e, k in (("min(hdr)", "low"), ("max(hdr)", "high"), ("sum(hdr * n) / cast(sum(n) as double)", "mean"), ("min(if(upto >= total div 2, hdr, null))", "mid"), ("sum(n)", "n"))])
    g = g.selectExpr("comp", "ldr", f"case when high - low > {levels >> 1} then cast(shiftright(high - low, 1) as double) when {str(median).lower()} and n > 1 then cast(mid as double) else mean end as w", "low", "high")

    def whole(p: pd.DataFrame) -> pd.DataFrame:
        w = np.full(size, np.nan)
        w[p.ldr.astype(int)] = p.w
        out = expanded(smoothed(ascending(filled(w, float(p.low.min()), float(p.high.max()))), smooth), bits)
        return pd.DataFrame({"comp": p.comp.iloc[0], "i": np.arange(len(out)), "w": out})

    return g.groupBy("comp").applyInPandas(whole, "comp bigint, i bigint, w bigint")


def inverted(table: DataFrame, out_bits: int) -> DataFrame:
    """w, i: for every value below 2**out_bits the place where an ascending table (i, w) has it.

    Where the table is flat, the middle of the flat; where it jumps, the upper half of the values between goes to the
    place after the jump and the lower half to the one before. Values above the last are at the last place if the table
    ends in the lower three quarters of the range, else 0, as are those below the first. An end value whose step is more
    than twice the next one continues that step. A table's rows are windowed in one group: they are 65,536 at most.
    """
    top = (1 << out_bits) - 1
    runs = table.groupBy("w").agg(*[_expr(e, k) for e, k in (("min(i)", "low"), ("max(i)", "high"))])
    runs = runs.selectExpr("w", "low", "high", "lag(w) over (order by w) as before", "lag(high) over (order by w) as before_high", "lead(w) over (order by w) as after")
    flat = runs.selectExpr("w", "shiftright(low + high, 1) as i")
    gaps = runs.where("w > before + 1").selectExpr("explode(sequence(before + 1, w - 1)) as v", "w", "before", "low", "before_high").selectExpr("v as w", "if(v > shiftright(before + w + 1, 1) - 1, low, before_high) as i")
    rest = runs.where(f"after is null and w < {top}").selectExpr(f"explode(sequence(w + 1, {top}L)) as v", "w", "high").selectExpr("v as w", f"if(w < {(top + 1) * 3 >> 2}, high, 0L) as i")
    under = runs.where("before is null and w > 0").selectExpr("explode(sequence(0L, w - 1)) as w", "0L as i")
    whole = flat.unionByName(gaps).unionByName(rest).unionByName(under)
    if top <= 4:
        return whole
    ends = whole.selectExpr("w", "i", *[f"{f}(i, {k}) over (order by w) as {f[1]}{k}" for f in ("lag", "lead") for k in (1, 2)])
    first, last = "w = 0 and abs(i - e1) > 2 * abs(e2 - e1)", f"w = {top} and abs(i - a1) > 2 * abs(a2 - a1)"
    return ends.selectExpr("w", f"case when {first} then 2 * e1 - e2 when {last} then 2 * a1 - a2 else i end as i")


def float_bits(v: str, exponent: int = 8, mantissa: int = 23) -> str:
    """The bit pattern of a finite number in a binary float of these widths, rounded toward zero; too small is 0, too large infinity."""
    bias = (1 << (exponent - 1)) - 1
    e = f"greatest(cast(floor(log2(abs({v}))) as bigint), {1 - bias}L)"
    e = f"if(abs({v}) >= pow(2D, cast({e} + 1 as double)), {e} + 1, if(abs({v}) < pow(2D, cast({e} as double)) and {e} > {1 - bias}, {e} - 1, {e}))"  # log2 may be off by an ulp
    m = f"cast(floor(abs({v}) / pow(2D, cast({e} as double)) * {1 << mantissa}D) as bigint)"
    whole = f"({e} + {bias - 1}) * {1 << mantissa}L + {m}"  # the leading one of a normal number adds one to the exponent
    sign = f"if({v} < 0, {1 << (exponent + mantissa)}L, 0L)"
    return f"{sign} + case when {v} = 0 then 0L when abs({v}) >= pow(2D, {bias + 1}D) then {((1 << exponent) - 1) << mantissa}L else {whole} end"


def bits_float(pattern: str, exponent: int = 8, mantissa: int = 23) -> str:
    """The number that a bit pattern stands for (infinities and not-a-number are null)."""
    bias = (1 << (exponent - 1)) - 1
    e, m = f"(shiftright({pattern}, {mantissa}) & {(1 << exponent) - 1}L)", f"({pattern} & {(1 << mantissa) - 1}L)"
    size = f"case when {e} = {(1 << exponent) - 1} then null when {e} = 0 then {m} * pow(2D, {1 - bias - mantissa}D) else ({m} + {1 << mantissa}L) * pow(2D, cast({e} - {bias + mantissa} as double)) end"
    return f"if(({pattern} & {1 << (exponent + mantissa)}L) <> 0, -1D, 1D) * {size}"


def output_converted(px: DataFrame, column: str, bits: int, table: DataFrame | None = None, clip: bool = True, half: bool = False) -> DataFrame:
    """y, x, v: samples through a table (i, w), then clipped to their bits or wrapped; half: as half-float patterns, infinities clipped to the largest number."""
    from pyspark.sql import functions as F

    v = px.select("y", "x", F.col(column).alias("v"))
    if table is not None:
        v = v.join(F.broadcast(table), F.col("v") == F.col("i")).select("y", "x", F.col("w").alias("v"))
    top = 0x7BFF if half else (1 << bits) - 1
    e = f"greatest(-{top + 1 if half else 0}L, least({top}L, v))" if clip or half else f"v & {top}L"
    if half:  # sign and magnitude from a number that grows with the value
        e = f"if({e} < 0, 32768L | (-({e}) - 1), {e})"
    return v.selectExpr("y", "x", f"{e} as v")
