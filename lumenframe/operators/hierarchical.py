"""Hierarchical files: frames of growing size in one file, each but the first the difference from the one before it, expanded.

A closed loop, level by level: the smallest image is coded and decoded; what a decoder has of it is expanded to twice its
size, and the difference from the next level is coded in a differential frame (no level shift), and so on. The last
frame's differences are coded as they are (the transform bypassed, steps of one), so the largest image is exact. A file
has a frame size for all (DHP), and before each differential frame the sign that the last image is expanded (EXP).

Levels meet by sort-merge joins of all their samples, whatever Spark takes their size for: tables of samples are a byte or
two a row on disk, and neither the rows that interpolation makes nor those of unfolded blocks are in its estimate, so a
level of millions of rows would be broadcast through the driver.

Reading is one pass over all frames: a frame is found by the EXP segments before it, every level of every image is decoded
as an image of its own, and levels meet by position, smallest first. Their number is in the plan, nothing else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.tables import written
from lumenframe.operators import blocks as B
from lumenframe.operators import decoding as DE
from lumenframe.operators import raster as R
from lumenframe.operators import scans as S
from lumenframe.operators.entropy import markers
from lumenframe.operators.markers import EXP

DHP, FIRST, DIFFERENTIAL, END = 0xDE, 0xC1, 0xC5, 0xD9
SCRIPT = [((0,), 0, 63, 0, 0)]
#: Levels of an image are images of their own while they are coded: number * MOST + level.
MOST = 8


def reduced(px: DataFrame) -> DataFrame:
    """image, y, x, v: half the size, means of 2x2 samples."""
    return px.groupBy("image", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x")).agg(F.expr("sum(v) div count(1)").alias("v"))


def expanded(px: DataFrame) -> DataFrame:
    """image, y, x, v: twice the size, interpolated."""
    return R.upsampled(px.selectExpr("image", "0L as comp", "y", "x", "v", "2L as fx", "2L as fy")).select("image", "y", "x", "v")


def blocked(px: DataFrame) -> DataFrame:
    """block (image, by, bx), v: samples row by row; sizes are multiples of eight."""
    rows = px.groupBy(F.expr("struct(image, y div 8 as `by`, x div 8 as bx)").alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.expr("y % 8 * 8 + x % 8").alias("k"), "v"))).alias("s"))
    return rows.selectExpr("block", "transform(s, e -> e.v) as v")


def unblocked(blocks: DataFrame) -> DataFrame:
    """image, y, x, v from block (image, by, bx), v."""
    return blocks.selectExpr("block", "posexplode(v) as (k, v)").selectExpr("block.image as image", "block.`by` * 8 + k div 8 as y", "block.bx * 8 + k % 8 as x", "v")


def _coefficients(px: DataFrame, deltas: list[int], level: int, last: int) -> DataFrame:
    """block, q: of the samples (level 0) or differences of a level; those of the last level as they are."""
    b = blocked(px)
    if level == last:
        return b.withColumnRenamed("v", "q")
    return B.quantized(B.fdct(b, level=0 if level else 128), deltas)


def _values(q: DataFrame, deltas: list[int], level: int, last: int) -> DataFrame:
    """image, y, x, v: what a decoder has of coefficients (block, q) of a level."""
    if level == last:
        return unblocked(q.withColumnRenamed("q", "v"))
    c = B.dequantized(q, deltas)
    if not level:
        return unblocked(B.idct(c))
    # Differences have no level and both signs: the middle is added against the clipping, and taken off again.
    return unblocked(B.idct(c, level=1 << 15, high=1 << 16)).selectExpr("image", "y", "x", f"v - {1 << 15}L as v")


def _met(low: DataFrame, own: DataFrame) -> DataFrame:
    """image, y, x, e, v: the samples of a level with those of the one before it, expanded (e)."""
    return expanded(low).withColumnRenamed("v", "e").join(own.hint("merge"), ["image", "y", "x"])


def _summed(low: DataFrame, diff: DataFrame) -> DataFrame:
    both = _met(low, diff)
    return both.selectExpr("image", "y", "x", "greatest(0L, least(255L, e + v)) as v")


def files(px: DataFrame, width: int, height: int, deltas: list[int], levels: int = 3) -> DataFrame:
    """image, seq, marker, payload: marker relations of hierarchical files of grey images (image, y, x, v) of one size."""
    sizes = [px]
    for _ in range(levels - 1):
        sizes.append(written(reduced(sizes[-1])))
    sizes, last, spark, parts, have = sizes[::-1], levels - 1, px.sparkSession, [], None
    for level, own in enumerate(sizes):
        if have is not None:
            own = _met(have, own).selectExpr("image", "y", "x", "v - e as v")
        q = written(_coefficients(own, deltas, level, last))
        values = _values(q, deltas, level, last)
        have = written(values if have is None else _summed(have, values))
        g = S.Geometry(width >> (last - level), height >> (last - level), [(1, 1)])
        blocks = q.selectExpr(f"block.image * {MOST} + {level} as image", "0L as comp", "block.`by` as `by`", "block.bx as bx", "q")
        segs, tables = S.two_pass(blocks, S.script(spark, SCRIPT), g, 0, False)
        steps = deltas if level < last else [1] * 64
        coded = S.files(segs, tables, S.script(spark, SCRIPT), g, [steps], 0, DIFFERENTIAL if level else FIRST)
        rows = markers(coded).where("marker not in (216, 217)").selectExpr(f"image div {MOST} as image", f"{level}L as level", "seq", "marker", "payload")
        parts.append(rows)
        if level:
            parts.append(rows.select("image").distinct().selectExpr("image", f"{level}L as level", "-1L as seq", f"{EXP}L as marker", "X'11' as payload"))
    images = px.select("image").distinct()
    size = f"concat(X'08', unhex('{height:04x}{width:04x}'), X'01011100')"
    parts += [images.selectExpr("image", f"{a}L as level", f"{b}L as seq", f"{m}L as marker", f"{p} as payload") for a, b, m, p in ((-1, 0, 0xD8, "X''"), (-1, 1, DHP, size), (levels, 0, END, "X''"))]
    return reduce(DataFrame.unionByName, parts).selectExpr("image", "row_number() over (partition by image order by level, seq) - 1L as seq", "marker", "payload")


def decoded(m: DataFrame, deltas: list[int], levels: int = 3) -> list[DataFrame]:
    """image, y, x, v of each level, smallest first, from marker relations of hierarchical files."""
    signs = m.where(f"marker = {EXP}").groupBy("image").agg(F.collect_list("seq").alias("signs"))
    own = m.join(signs, "image", "left").selectExpr(f"image * {MOST} + if(signs is null, 0, size(filter(signs, s -> s <= seq))) as image", "seq", "marker", "payload")
    found = written(DE.decode(own.where(f"marker not in ({DHP}, {EXP})")))
    out: list[DataFrame] = []
    for level in range(levels):
        q = found.where(f"image % {MOST} = {level}").selectExpr(f"struct(image div {MOST} as image, `by`, bx) as block", "q")
        values = _values(q, deltas, level, levels - 1)
        out.append(written(values if not out else _summed(out[-1], values)))
    return out
