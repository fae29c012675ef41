"""Deringing: blocks with samples at the ends of the range are moved beyond it and smoothed before they are coded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenframe.operators import blocks as B


def overshot(v: np.ndarray, delta: int, low: int = 0, high: int = 255, least: int = 31) -> np.ndarray:
    """Samples (n, 64) of which those at an end of the range lie beyond it: by as much as the block's mean is away, and at most 2 * delta (or `least`); then three steps of the five-point mean on them, which keep them there."""
    over, total = max(2 * delta, least), v.sum(1, keepdims=True)
    mask = np.where(v <= low, -1, np.where(v >= high, 1, 0))
    x = np.where(mask > 0, high + np.minimum((high << 6) - total >> 6, over), np.where(mask < 0, low - np.minimum(total - (low << 6) >> 6, over), v))
    for _ in range(3):
        p = np.pad(x.reshape(-1, 8, 8), ((0, 0), (1, 1), (1, 1)), mode="edge")
        around = p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:]
        mean = ((4 * x + around.reshape(-1, 64)) | 1) + 3 >> 3
        mean = np.where(x <= low, np.minimum(mean, low), np.where(x >= high, np.maximum(mean, high), mean))
        x = np.where(mask == 0, x, mean)
    return x


def smoothed(blocks: DataFrame, delta: int, low: int = 0, high: int = 255) -> DataFrame:
    """block, v, mod: the samples and what `overshot` makes of them, in Arrow batches. Blocks without a sample at an end, or with all samples at one, stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 64)
            counts = [(v <= low).sum(1), (v >= high).sum(1)]
            some = np.logical_or(*[(c > 0) & (c < 64) for c in counts])
            mod = np.where(some[:, None], overshot(v, delta, low, high), v)
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * 64), pa.array(mod.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("v"), out], names=["block", "v", "mod"])

    return blocks.select("block", "v").mapInArrow(run, "block bigint, v array<bigint>, mod array<bigint>")


def deringed(blocks: DataFrame, deltas: list[int]) -> DataFrame:
    """block, q: quantized coefficients of the smoothed overshooting block, none of a larger magnitude category than without; blocks without extremes, or of one extreme only, stay."""
    rows = smoothed(blocks, deltas[0])
    own = B.quantized(B.fdct(rows.select("block", "v")), deltas).withColumnRenamed("q", "own")
    new = B.quantized(B.fdct(rows.selectExpr("block", "mod as v")), deltas).withColumnRenamed("q", "new")
    top = "shiftleft(1L, length(bin(abs(a)))) - 1"
    merged = f"zip_with(own, transform(new, (n, i) -> struct(n as n, i as i)), (a, b) -> case when b.i = 0 then b.n when a = 0 then 0L else greatest(-({top}), least({top}, b.n)) end)"
    return own.join(new, "block").selectExpr("block", f"{merged} as q")
