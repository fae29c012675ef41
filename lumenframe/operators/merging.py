"""Base and residual merged by a specification that each image brings along: out = C * LUT(L * base) + R * residual - offset.

The specification is a super box (SPEC) whose children name transforms by number: LTRF, CTRF and RTRF the matrices of the
base, of colour and of the residual (1: none, 2: YCbCr, 4: the reversible one, 5 and up: a matrix that a box MTRX gives),
LPTS a table for each component (a box TONE gives it), OCON the range of the output and whether it is clipped or wrapped.
Nothing of this is in the plan: the boxes are parsed to one row for each image (`specification`), matrices and tables meet it
by image and number, and pixels meet it tile by tile. So images of one table may each have their own.

An image without a specification has YCbCr, no tables, 8 bits, clipped. A number without a box gives a null matrix or
table, and the image's pixels are null. Without a residual the sum has none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.fixed import COLOUR_BITS, FIX_BITS
from lumenframe.operators import boxes as BX
from lumenframe.operators import colour as C
from lumenframe.operators.markers import number

IDENTITY, YCBCR, REVERSIBLE, FREE = 1, 2, 4, 5
#: Lines of a tile.
LINES = 64
_ONE = 1 << FIX_BITS
_STANDARD = {IDENTITY: [_ONE, 0, 0, 0, _ONE, 0, 0, 0, _ONE], YCBCR: [x for row in C.INVERSE for x in row], REVERSIBLE: [_ONE, 0, 0, 0, _ONE, 0, 0, 0, _ONE]}


def matrices(boxes: DataFrame) -> DataFrame:
    """image, id, m: nine numbers of FIX_BITS fractional bits, of boxes MTRX (image, type, data)."""
    word = lambda k: f"({number(f'1 + 2 * {k}', 2, 'data')})"
    signed = f"transform(sequence(0, 8), k -> if({word('k')} >= 32768, {word('k')} - 65536, {word('k')}))"
    return boxes.where("type = 'MTRX' and octet_length(data) = 19").selectExpr("image", f"shiftright({number(0, 1, 'data')}, 4) as id", f"{signed} as m")


def tables(boxes: DataFrame) -> DataFrame:
    """image, id, w: integer tables of boxes TONE, entries of two bytes (of four, beyond 8 extra bits)."""
    first = number(0, 1, "data")
    size = f"if({first} & 15L > 8, 4, 2)"
    entry = f"transform(sequence(0, cast((octet_length(data) - 1) div {size} - 1 as int)), k -> cast(conv(hex(substring(data, 2 + k * {size}, {size})), 16, 10) as bigint))"
    return boxes.where("type = 'TONE' and octet_length(data) > 2").selectExpr("image", f"shiftright({first}, 4) as id", f"{entry} as w")


def matrix_box(id_: str, m: str) -> str:
    """The data of a box MTRX, as SQL text: a number from 5 to 15 and an array of nine numbers."""
    return f"unhex(concat(lpad(hex({id_} * 16 + {FIX_BITS}), 2, '0'), array_join(transform({m}, v -> lpad(hex(if(v < 0, v + 65536, v)), 4, '0')), '')))"


def table_box(id_: str, w: str, bits: int = 0) -> str:
    """The data of a box TONE of entries of two bytes, as SQL text."""
    return f"unhex(concat(lpad(hex({id_} * 16 + {bits}), 2, '0'), array_join(transform({w}, v -> lpad(hex(v), 4, '0')), '')))"


def specification(boxes: DataFrame) -> DataFrame:
    """One row for each image that has boxes (image, en, type, data): base, colour, residual (numbers and matrices), tables, bits, clip."""
    inner = BX.children(boxes).select("image", "type", "data").unionByName(boxes.select("image", "type", "data"))
    of = lambda kind, at: F.max(F.expr(f"case when type = '{kind}' then {number(at, 1, 'data')} end"))
    s = inner.groupBy("image").agg(*[of(k, 0).alias(k) for k in ("LTRF", "CTRF", "RTRF", "OCON")], of("LPTS", 0).alias("t01"), of("LPTS", 1).alias("t23"))
    s = s.selectExpr(
        "image", f"coalesce(shiftright(LTRF, 4), {YCBCR}L) as base", f"coalesce(shiftright(CTRF, 4), {IDENTITY}L) as colour", f"coalesce(shiftright(RTRF, 4), {IDENTITY}L) as residual",
        "8L + coalesce(shiftright(OCON, 4), 0L) as bits", "coalesce(OCON & 2L, 2L) > 0 as clip", "array(shiftright(t01, 4), t01 & 15L, shiftright(t23, 4)) as ids", "t01 is not null as mapped",
    )
    known, mapped = matrices(inner), tables(inner)
    standard = lambda c: f"case {c} " + " ".join(f"when {k} then array({', '.join(f'{x}L' for x in m)})" for k, m in _STANDARD.items()) + " end"
    for c in ("base", "colour", "residual"):
        own = known.select("image", F.col("id").alias(c), F.col("m").alias(f"{c}_own"))
        s = s.join(own, ["image", c], "left").withColumn(f"{c}_matrix", F.expr(f"if({c} >= {FREE}, {c}_own, {standard(c)})")).drop(f"{c}_own")
    for k in range(3):
        own = mapped.select("image", F.col("id").alias("table_id"), F.col("w").alias(f"table_{k}"))
        s = s.withColumn("table_id", F.expr(f"ids[{k}]")).join(own, ["image", "table_id"], "left").drop("table_id")
    return s.drop("ids")


def _merged(c: np.ndarray, r: np.ndarray | None, s) -> np.ndarray | None:
    """Pixels (n, 3) of base samples (COLOUR_BITS fractional bits) and residual samples, by a row of specification()."""
    base, colour, back = (s[f"{k}_matrix"] for k in ("base", "colour", "residual"))
    luts = [s[f"table_{k}"] for k in range(3)]
    if any(m is None for m in (base, colour, back)) or (s["mapped"] and any(t is None for t in luts)):
        return None
    bits = int(s["bits"])
    base, colour, back = (np.asarray(m, np.int64).reshape(3, 3) for m in (base, colour, back))
    shift = FIX_BITS + COLOUR_BITS
    middle = np.array([0, 1, 1]) * (128 << COLOUR_BITS) * int(int(s["base"]) == YCBCR)
    v = np.clip((c - middle) @ base.T + (1 << shift - 1) >> shift, 0, 255)
    if s["mapped"]:
        v = np.stack([np.asarray(t, np.int64)[v[:, k]] for k, t in enumerate(luts)], 1)
    else:
        v = v << bits - 8
    v = v @ colour.T + (1 << FIX_BITS - 1) >> FIX_BITS
    most, half = (1 << bits) - 1, 1 << bits - 1
    if r is not None:
        kind = int(s["residual"])
        if kind == REVERSIBLE:
            y, cb, cr = r[:, 0], r[:, 1] - most - 1, r[:, 2] - most - 1  # differences have a bit more
            g = y - (cb + cr >> 2)
            r = np.stack([cr + g, g, cb + g], 1) & most
        elif kind == YCBCR:
            r = (r - np.array([0, half, half])) @ back.T + (1 << FIX_BITS - 1) >> FIX_BITS
        else:
            r = r @ back.T + (1 << FIX_BITS - 1) >> FIX_BITS
        v = v + r - half
    return np.clip(v, 0, most) if s["clip"] else v & most


def merged(base: DataFrame, specs: DataFrame, residual: DataFrame | None = None, lines: int = LINES) -> DataFrame:
    """image, y, x, r, g, b from base (image, y, x, c0, c1, c2), a row of specification() for each image, and residual (image, y, x, r0, r1, r2)."""
    rows = base.select("image", "y", "x", "c0", "c1", "c2")
    more = residual is not None
    if more:
        rows = rows.join(residual.select("image", "y", "x", "r0", "r1", "r2"), ["image", "y", "x"], "left")
    rows = rows.withColumn("tile", F.expr(f"y div {lines}"))
    tiles = rows.select("image", "tile").distinct().join(specs, "image", "left")
    default = {k: m for k, m in _STANDARD.items() if k in (IDENTITY, YCBCR)}
    plain = {"base": YCBCR, "base_matrix": default[YCBCR], "colour_matrix": default[IDENTITY], "residual": IDENTITY, "residual_matrix": default[IDENTITY], "bits": 8, "clip": True, "mapped": False, "table_0": None, "table_1": None, "table_2": None}
    own = tiles.select(F.col("image").alias("own_image"), F.col("tile").alias("own_tile"), *[F.col(c).alias(c) for c in tiles.columns if c not in ("image", "tile")])

    def done(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame()
        spec = s.iloc[0] if not pd.isna(s["base"].iloc[0]) else plain
        r = p[["r0", "r1", "r2"]].to_numpy() if more else None
        v = _merged(p[["c0", "c1", "c2"]].to_numpy(np.int64), r.astype(np.int64) if r is not None and not pd.isna(r).any() else None, spec)
        out = p[["image", "y", "x"]]
        return out.assign(**{n: v[:, k] if v is not None else None for k, n in enumerate("rgb")})

    return rows.groupBy("image", "tile").cogroup(own.groupBy("own_image", "own_tile")).applyInPandas(done, "image bigint, y bigint, x bigint, r bigint, g bigint, b bigint")
