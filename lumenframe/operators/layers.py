"""Layers and planes that meet by position: equi-joins on pixel keys, and the hierarchy of resolutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.fixed import clamp


def base_layer(px: DataFrame, step: int = 16) -> DataFrame:
    """y, x, base: a coarse version of the red plane, as a lossy base layer would give."""
    return px.selectExpr("y", "x", f"(r div {step}) * {step} + {step // 2} as base")


def residual(original: DataFrame, base: DataFrame, bits: int = 8) -> DataFrame:
    """y, x, res: original minus reconstruction, moved to the middle of a range one bit wider."""
    return original.join(base, ["y", "x"]).selectExpr("y", "x", f"r - base + {1 << bits}L as res")


def merged(base: DataFrame, res: DataFrame, bits: int = 8) -> DataFrame:
    """y, x, v: base plus residual, clipped."""
    return base.join(res, ["y", "x"]).selectExpr("y", "x", f"{clamp(f'base + res - {1 << bits}L', (1 << bits) - 1)} as v")


def with_alpha(px: DataFrame, alpha: DataFrame, opaque: int = 255) -> DataFrame:
    """Every pixel with its alpha, opaque where the alpha plane has none."""
    return px.join(alpha, ["y", "x"], "left").select("y", "x", "r", F.coalesce("alpha", F.lit(opaque)).cast("bigint").alias("alpha"))


def reduced(px: DataFrame, column: str = "r") -> DataFrame:
    """y, x, low: the next smaller level, means of 2x2 samples (of those that are there)."""
    return px.groupBy(F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(F.expr(f"sum({column}) div count(1)").alias("low"))


def differential(px: DataFrame, low: DataFrame, column: str = "r", shift: int = 256) -> DataFrame:
    """y, x, diff: a level minus its replicated smaller level, offset."""
    own = px.selectExpr("y", "x", f"{column} as v", "y div 2 as ly", "x div 2 as lx")
    return own.join(low.selectExpr("y as ly", "x as lx", "low"), ["ly", "lx"]).selectExpr("y", "x", f"v - low + {shift}L as diff")


def from_differential(diff: DataFrame, low: DataFrame, shift: int = 256) -> DataFrame:
    own = diff.selectExpr("y", "x", "diff", "y div 2 as ly", "x div 2 as lx")
    return own.join(low.selectExpr("y as ly", "x as lx", "low"), ["ly", "lx"]).selectExpr("y", "x", f"diff + low - {shift}L as v")


def refined(high: DataFrame, bits: DataFrame, al: int) -> DataFrame:
    """Coefficients (block, k, v) with `al` lower magnitude bits (block, k, low) put back."""
    return high.join(bits, ["block", "k"]).selectExpr("block", "k", f"if(neg, -1, 1) * (shiftleft(v, {al}) + low) as v")


def recombined(planes: DataFrame) -> DataFrame:
    """y, x, c0, c1, c2 from one row for each component (comp, y, x, v)."""
    return planes.groupBy("y", "x").agg(*[F.max(F.when(F.col("comp") == c, F.col("v"))).alias(f"c{c}") for c in range(3)])
