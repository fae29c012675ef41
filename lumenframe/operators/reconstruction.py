"""From files to pixels: coefficients, samples by the file's own quantization tables, upsampling by its own factors, colour.

Everything is keyed by image, and every number that an image's headers give (tables, factors, size) meets its blocks by a
join on the image and component; nothing about an image is in the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.fixed import COLOUR_BITS
from lumenframe.operators import blocks as B
from lumenframe.operators import colour as C
from lumenframe.operators import markers as M
from lumenframe.operators import raster as R


def components(m: DataFrame) -> DataFrame:
    """image, comp, delta (64 steps, row by row), fx, fy (factors to full size), width, height: of an image's first frame. Images of several tables of one number have the last."""
    order = B.zigzag()
    steps = M.quantization(m).groupBy("image", "tq", "k").agg(F.max_by("delta", "seq").alias("delta"))
    place = "array(" + ", ".join(str(order.index(k)) for k in range(64)) + ")"
    tables = steps.groupBy("image", "tq").agg(F.array_sort(F.collect_list(F.struct("k", "delta"))).alias("t")).selectExpr("image", "tq", f"transform({place}, k -> t[k].delta) as delta")
    frames = M.frames(m).groupBy("image").agg(F.min_by(F.struct("seq", "width", "height"), "seq").alias("f"))
    comps = M.components(m).join(frames, "image").where("seq = f.seq")
    most = comps.groupBy("image").agg(F.max("h").alias("most_h"), F.max("v").alias("most_v"))
    return comps.join(most, "image").join(tables, ["image", "tq"]).selectExpr("image", "comp", "delta", "most_h div h as fx", "most_v div v as fy", "f.width as width", "f.height as height")


def samples(blocks: DataFrame, comps: DataFrame) -> DataFrame:
    """image, comp, y, x, v, fx, fy from coefficient blocks (image, comp, by, bx, q) and components()."""
    known = blocks.join(comps.select("image", "comp", "delta", "fx", "fy"), ["image", "comp"])
    c = known.selectExpr("struct(image, comp, `by`, bx, fx, fy) as block", "zip_with(q, delta, (a, d) -> a * d) as c")
    v = B.idct(c).selectExpr("block", "posexplode(v) as (k, v)")
    return v.selectExpr("block.image as image", "block.comp as comp", "block.`by` * 8 + k div 8 as y", "block.bx * 8 + k % 8 as x", "v", "block.fx as fx", "block.fy as fy")


def within(v: DataFrame, comps: DataFrame) -> DataFrame:
    """The samples inside the image: those of blocks that fill up the last column and row of MCUs go before neighbours are looked at."""
    size = comps.selectExpr("image", "comp", "(width + fx - 1) div fx as w", "(height + fy - 1) div fy as h")
    return v.join(size, ["image", "comp"]).where("x < w and y < h").drop("w", "h")


def planes(blocks: DataFrame, m: DataFrame) -> DataFrame:
    """image, y, x, c0, c1, c2 (COLOUR_BITS fractional bits) of three-component images, cut to their size."""
    comps = components(m)
    full = R.upsampled(within(samples(blocks, comps), comps))
    c = full.groupBy("image", "y", "x").agg(*[F.max(F.when(F.col("comp") == k, F.col("v") * (1 << COLOUR_BITS))).alias(f"c{k}") for k in range(3)])
    size = comps.where("comp = 0").select("image", "width", "height")
    return c.join(size, "image").where("x < width and y < height").drop("width", "height")


def pixels(blocks: DataFrame, m: DataFrame) -> DataFrame:
    """image, y, x, r, g, b of three-component images (YCbCr), cut to their size."""
    c = planes(blocks, m).selectExpr("image", "y as py", "x as px", "c0 as y", "c1 as cb", "c2 as cr")
    return C.ycbcr_to_rgb(c, more=("image",)).selectExpr("image", "py as y", "px as x", "r", "g", "b")
