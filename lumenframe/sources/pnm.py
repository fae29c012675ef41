"""Netpbm pictures (P5, P6, Pf, PF) as rows of samples, and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_HEAD = re.compile(rb"(P[56fF])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+([-+.\d]+)\s")


def parse(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and samples (height, width, components), top row first; integers or floats."""
    m = _HEAD.match(data)
    if not m:
        raise ValueError("not a P5, P6, Pf or PF picture")
    kind, w, h = m[1], int(m[2]), int(m[3])
    n = 3 if kind in (b"P6", b"PF") else 1
    if kind in (b"Pf", b"PF"):
        v = np.frombuffer(data, "<f4" if float(m[4]) < 0 else ">f4", w * h * n, m.end()).reshape(h, w, n)[::-1]
    else:
        v = np.frombuffer(data, ">u2" if int(m[4]) > 255 else "u1", w * h * n, m.end()).reshape(h, w, n)
    return w, h, v


def build(v: np.ndarray, high: int = 255) -> bytes:
    """A picture of samples (height, width, 1 or 3): P5 or P6 for integers, Pf or PF (little-endian) for floats."""
    h, w, n = v.shape
    if v.dtype.kind == "f":
        return f"P{'F' if n == 3 else 'f'}\n{w} {h}\n-1.0\n".encode() + v[::-1].astype("<f4").tobytes()
    return f"P{6 if n == 3 else 5}\n{w} {h}\n{high}\n".encode() + v.astype(">u2" if high > 255 else "u1").tobytes()


def written(px: DataFrame, rows: int = 64) -> DataFrame:
    """image, file: a P6 picture for each stripe of `rows` full lines of a raster (y, x, r, g, b)."""
    import pandas as pd

    def picture(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["y", "x"])
        w = int(p.x.max()) + 1
        v = p[["r", "g", "b"]].to_numpy()
        return pd.DataFrame({"image": [int(p.image.iloc[0])], "file": [build(v[: len(v) // w * w].reshape(-1, w, 3))]})

    return px.selectExpr(f"y div {rows} as image", "y", "x", "r", "g", "b").groupBy("image").applyInPandas(picture, "image bigint, file binary")


def read(files: DataFrame, rows: int = 64) -> DataFrame:
    """y, x, r, g, b from files of stripes (column file of spark.read.format('binaryFile') is content)."""

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for image, file in zip(b.column("image").to_pylist(), b.column("file").to_pylist(), strict=True):
                w, h, v = parse(file)
                y, x = np.divmod(np.arange(w * h), w)
                c = v.reshape(-1, v.shape[2]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(y + image * rows), pa.array(x), *(pa.array(c[:, min(k, c.shape[1] - 1)]) for k in range(3))], names=["y", "x", "r", "g", "b"])

    return files.mapInArrow(pixels, "y bigint, x bigint, r bigint, g bigint, b bigint")
