"""Predictive lossless scans: errors by restart segment, their Huffman coding, and the way back for every predictor.

Prediction begins anew in each restart segment of some lines, so segments are coded and restored side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.fixed import signed16
from lumenframe.operators import predict, scans, stats


def residuals(px: DataFrame, mode: int, rows: int, bits: int = 8) -> DataFrame:
    """seg, y, x, e: 16-bit prediction errors; a segment's first line is predicted from the left, its first sample by the middle."""
    rule = f"case when x = 0 and y % {rows} = 0 then {1 << (bits - 1)}L when y % {rows} = 0 then a when x = 0 then b else {predict.MODES[mode]} end"
    return predict.neighbours(px).selectExpr(f"y div {rows} as seg", "y", "x", f"{signed16(f'v - ({rule})')} as e")


def restored(e: DataFrame, mode: int, bits: int = 8) -> DataFrame:
    """y, x, v of all modes: a segment's samples are restored diagonal by diagonal, each of which needs only those before it."""

    def back(p: pd.DataFrame) -> pd.DataFrame:
        y, x = p.y.to_numpy() - p.y.min(), p.x.to_numpy()
        err = np.zeros((y.max() + 1, x.max() + 1), np.int64)
        err[y, x] = p.e
        h, w = err.shape
        v = np.zeros((h, w), np.int64)
        v[0, 0] = (1 << (bits - 1)) + err[0, 0]
        v[0] = v[0, 0] + np.concatenate([[0], np.cumsum(err[0, 1:])])
        v[:, 0] = v[0, 0] + np.concatenate([[0], np.cumsum(err[1:, 0])])
        v &= 65535
        for d in range(2, h + w - 1):
            i = np.arange(max(1, d - w + 1), min(h, d))
            j = d - i
            if not len(i):
                continue
            a, b, c = v[i, j - 1], v[i - 1, j], v[i - 1, j - 1]
            guess = {1: a, 2: b, 3: c, 4: a + b - c, 5: a + (b - c >> 1), 6: b + (a - c >> 1), 7: a + b >> 1}[mode]
            v[i, j] = guess + err[i, j] & 65535
        return pd.DataFrame({"y": p.y, "x": p.x, "v": v[y, x]})

    return e.groupBy("seg").applyInPandas(back, "y bigint, x bigint, v bigint")


def tokens(e: DataFrame) -> DataFrame:
    """image, scan, seg, i, tc, th, symbol, value, bits as scans.TOKENS: a category and its bits for each error; -32768 is category 16 without bits."""
    n = f"cast({stats.category('e')} as bigint)"
    t = e.selectExpr("0L as image", "0L as scan", "seg", "row_number() over (partition by seg order by y, x) - 1L as i", "e", f"if(e = -32768, 16L, {n}) as symbol")
    bits = "if(symbol = 16, 0L, symbol)"
    return t.selectExpr("image", "scan", "seg", "i", "0L as tc", "0L as th", "symbol", f"(if(e < 0, e - 1, e)) & (shiftleft(1L, cast({bits} as int)) - 1) as value", f"{bits} as bits")


def round_trip(e: DataFrame) -> DataFrame:
    """seg, y, x, e: errors coded by a table made for them, and read back from the segments' bytes."""
    t = tokens(e)
    tables = scans.code_tables(scans.histogram(t))
    codes = tables.orderBy("size", "symbol").agg(F.collect_list(F.struct("size", "symbol")).alias("t"))  # at most 17 symbols
    places = e.groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("at"))
    rows = scans.segments(t, tables).join(places, "seg").join(F.broadcast(codes.withColumn("image", F.lit(0).cast("bigint"))), "image")

    def read(p: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in p.itertuples():
            own = sorted((x["size"], x["symbol"]) for x in r.t)
            table, bits = scans.lookup(tuple(n for n, _ in own), tuple(s for _, s in own)), scans.Bits(r.data)
            for at in r.at:
                n = bits.symbol(table)
                out.append((r.seg, at["y"], at["x"], -32768 if n == 16 else bits.value(n)))
        return pd.DataFrame(out, columns=["seg", "y", "x", "e"])

    return rows.groupBy("seg").applyInPandas(read, "seg bigint, y bigint, x bigint, e bigint")
