"""Coefficients chosen by rate and distortion: J = D / 4 + R over the values that cost few bits.

Costs are integers in units of 2**-16 bits, so sums are exact in any order. A value q of a coefficient with transform
value c (12 fractional bits) and step d has the distortion 64 * (q - c / d)**2, weighted by LAMBDA; its rate is its code
length plus its own bits. Code lengths are given: those measured on the plainly quantized image (two-pass coding), or a
fixed table's. A symbol without a code can't be chosen.

AC coefficients of a block are a shortest path through the nonzero ones in zig-zag order: each may stay, take the
largest value of one bit less, or join a run of zeros; the end of block follows the last. Blocks are independent.

DC coefficients are a path through all blocks of a component, since each is coded as the difference from the one
before: three candidates a block (one less, as it is, one more), and costs that depend on two neighbours. The path is
not walked by one task. Between two blocks the costs are a 3x3 matrix, and a stretch's cheapest paths between its ends'
candidates are the min-plus product of its matrices, which is associative: each tile of TILE blocks is multiplied by
itself, a component's tile matrices (at most 16,384 in the largest image the format has) are chained in one group, and
with both ends known each tile is traced back by itself.

Restart segments begin without a predecessor. Blocks of the same cost: the lower candidate stays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.tables import spread
from lumenframe.operators.blocks import zigzag
from lumenframe.operators.scans import Geometry

#: 64 times the weight of the squared error, in steps, against a bit; bits of fraction of the transform and of a cost.
LAMBDA, FRACTION, UNIT = 16, 12, 16
TILE, MOST_DC, NONE = 4096, 2047, np.int64(1) << 60
_TILES = "image bigint, comp bigint, tile bigint"


def distortion(q: np.ndarray, c: np.ndarray, delta: np.ndarray | int) -> np.ndarray:
    """In units of 2**-16 bits."""
    e = q * (delta << FRACTION) - c
    return e * e * LAMBDA // (delta * delta << (2 * FRACTION - UNIT))


def categories(v: np.ndarray) -> np.ndarray:
    """The number of bits of |v|."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def rates(tables: DataFrame) -> DataFrame:
    """image, th, dc, ac: code lengths by symbol (0: no code), from rows (image, tc, th, symbol, size)."""
    of = lambda tc: F.map_from_entries(F.collect_list(F.when(F.col("tc") == tc, F.struct("symbol", "size"))))
    maps = tables.groupBy("image", "th").agg(of(0).alias("d"), of(1).alias("a"))
    array = lambda m: f"transform(sequence(0L, 255L), s -> coalesce(element_at({m}, s), 0L))"
    return maps.selectExpr("image", "th", f"{array('d')} as dc", f"{array('a')} as ac")


def numbered(blocks: DataFrame, g: Geometry, interval: int = 0, tile: int = TILE) -> DataFrame:
    """blocks (image, comp, by, bx and more) with their number n in their component's order of coding, tile, th, and first: no block precedes in its restart segment."""
    h, v = (F.array(*[F.lit(f[k]) for f in g.factors])[F.col("comp").cast("int")].cast("bigint") for k in (0, 1))
    b = blocks.withColumns({"h": h, "v": v}).selectExpr("*", f"`by` div v * {g.across} + bx div h as mcu", "`by` % v * h + bx % h as place")
    start = f"place = 0 and mcu % {interval} = 0" if interval else "place = 0 and mcu = 0"
    b = b.selectExpr("*", "mcu * h * v + place as n", f"{start} as first", "least(comp, 1L) as th")
    return b.withColumn("tile", F.expr(f"n div {tile}")).drop("h", "v", "mcu", "place")


def _met(rows: DataFrame, per_tile: DataFrame, of, schema: str) -> DataFrame:
    """of(rows of a tile, the tile's row of per_tile)."""
    keys, own = ["image", "comp", "tile"], ["own_image", "own_comp", "own_tile"]
    other = per_tile.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], *[F.col(c).alias(c) for c in per_tile.columns if c not in keys])
    none = pd.DataFrame()
    return spread(rows, *keys).groupBy(keys).cogroup(spread(other, *own).groupBy(own)).applyInPandas(lambda p, r: of(p, r.iloc[0]) if len(p) and len(r) else none, schema)


def _per_tile(rows: DataFrame, rate: DataFrame, of, schema: str) -> DataFrame:
    """of(rows of a tile, its code lengths)."""
    return _met(rows, rows.select("image", "comp", "tile", "th").distinct().join(rate, ["image", "th"]), of, schema)


# ---- AC


def ac_costs(q: np.ndarray, c: np.ndarray, deltas: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The cost of each block's AC coefficients as they are (rows of 64 in zig-zag order)."""
    total = distortion(q[:, 1:], c[:, 1:], deltas[1:]).sum(axis=1)
    for i, row in enumerate(q.tolist()):
        run, bits = 0, 0
        for k in range(1, 64):
            if not row[k]:
                run += 1
                continue
            n = abs(row[k]).bit_length()
            bits += (run >> 4) * int(sizes[0xF0]) + int(sizes[(run & 15) << 4 | n]) + n
            run = 0
        total[i] += (bits + (int(sizes[0]) if run else 0)) << UNIT
    return total


def ac_chosen(q: np.ndarray, c: np.ndarray, deltas: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 64 coefficients (zig-zag order; the DC is left alone) of least cost, and their costs."""
    n, last = q.shape
    rate = np.where(sizes > 0, sizes, NONE >> UNIT + 4).astype(np.int64) << UNIT
    zeroed = np.zeros((n, last), np.int64)  # the distortion of zeros up to each place
    np.cumsum(distortion(0, c[:, 1:], deltas[1:]), axis=1, out=zeroed[:, 1:])
    best = np.full((n, last), NONE)
    best[:, 0] = 0
    came, value = np.zeros((n, last), np.int64), np.zeros((n, last), np.int64)
    for k in range(1, last):
        i = np.flatnonzero(q[:, k])
        if not len(i):
            continue
        old, bits = q[i, k], categories(q[i, k])
        low = np.sign(old) * ((np.int64(1) << np.maximum(bits - 1, 0)) - 1)
        run = k - 1 - np.arange(k)
        before = best[i, :k] - zeroed[i, :k] + (run >> 4) * (rate[0xF0] if k > 16 else 0)
        before = np.where(best[i, :k] >= NONE, NONE, before)
        symbol = (run & 15) << 4
        ways = []
        for v, b in ((old, bits), (low, bits - 1)):
            own = distortion(v, c[i, k], deltas[k]) + (b << UNIT)
            way = before + rate[symbol[None, :] | b[:, None]] + own[:, None]
            ways.append(np.where(b[:, None] > 0, way, NONE))
        both = np.stack(ways, 1).reshape(len(i), -1)
        at = both.argmin(axis=1)
        best[i, k] = np.minimum(both[np.arange(len(i)), at] + zeroed[i, k - 1], NONE)
        came[i, k], value[i, k] = at % k, np.where(at < k, old, low)
    end = np.where(best >= NONE, NONE, best + zeroed[:, -1:] - zeroed)
    end[:, :-1] += rate[0]
    stop = end.argmin(axis=1)
    cost, out, at = end[np.arange(n), stop], np.zeros_like(q), stop.copy()
    out[:, 0] = q[:, 0]
    while (at > 0).any():
        i = np.flatnonzero(at)
        out[i, at[i]] = value[i, at[i]]
        at[i] = came[i, at[i]]
    return out, cost


def with_ac(blocks: DataFrame, rate: DataFrame, g: Geometry, deltas: list[list[int]], tile: int = TILE) -> DataFrame:
    """image, comp, by, bx, q, plain_cost, cost from blocks (image, comp, by, bx, q, t): AC coefficients of least cost. deltas: of the first and of the other components."""
    order = np.array(zigzag())
    back = np.argsort(order)

    def chosen(p: pd.DataFrame, r) -> pd.DataFrame:
        q, t = (np.array(p[x].to_list(), np.int64)[:, order] for x in ("q", "t"))
        d, sizes = np.array(deltas[min(int(p.comp.iloc[0]), 1)], np.int64)[order], np.asarray(r["ac"], np.int64)
        new, cost = ac_chosen(q, t, d, sizes)
        return p[["image", "comp", "by", "bx"]].assign(q=list(new[:, back]), plain_cost=ac_costs(q, t, d, sizes), cost=cost)

    rows = numbered(blocks, g, tile=tile).select("image", "comp", "tile", "th", "by", "bx", "q", "t")
    return _per_tile(rows, rate.select("image", "th", "ac"), chosen, "image bigint, comp bigint, `by` bigint, bx bigint, q array<bigint>, plain_cost bigint, cost bigint")


# ---- DC


def dc_matrices(q: np.ndarray, c: np.ndarray, before: np.ndarray, first: np.ndarray, delta: int, sizes: np.ndarray) -> np.ndarray:
    """(n, 3, 3): the cost of each block's candidate (last axis) after each candidate of the block before."""
    rate = np.where(sizes > 0, sizes, NONE >> UNIT + 4).astype(np.int64)
    step = np.arange(-1, 2)
    own, last = np.clip(q[:, None] + step, -MOST_DC, MOST_DC), np.clip(before[:, None] + step, -MOST_DC, MOST_DC)
    bits = categories(own[:, None, :] - np.where(first[:, None], 0, last)[:, :, None])
    return distortion(own, c[:, None], delta)[:, None, :] + (rate[bits] + bits << UNIT)


def product(m: np.ndarray) -> np.ndarray:
    """The min-plus product of matrices in a row."""
    while len(m) > 1:
        pairs = np.minimum((m[: len(m) // 2 * 2 : 2, :, :, None] + m[1::2, None, :, :]).min(axis=2), NONE)
        m = np.concatenate([pairs, m[-1:]]) if len(m) % 2 else pairs
    return m[0]


def traced(m: np.ndarray, start: int, end: int) -> np.ndarray:
    """The candidates on a cheapest path through matrices from candidate `start` before the first to `end` at the last."""
    cost = np.full(3, NONE)
    cost[start] = 0
    came = np.zeros((len(m), 3), np.int64)
    for i, x in enumerate(m):
        ways = cost[:, None] + x
        came[i] = ways.argmin(axis=0)
        cost = np.minimum(ways.min(axis=0), NONE)
    path = np.empty(len(m), np.int64)
    for i in range(len(m) - 1, -1, -1):
        path[i], end = end, came[i, end]
    return path


def chained(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For the tiles' matrices in a row: the candidate before each tile, that at its end, and the path's cost."""
    cost, came = np.zeros(3, np.int64), np.zeros((len(m), 3), np.int64)
    for i, x in enumerate(m):
        ways = cost[:, None] + x
        came[i], cost = ways.argmin(axis=0), np.minimum(ways.min(axis=0), NONE)
    start, end = np.empty(len(m), np.int64), np.empty(len(m), np.int64)
    at = int(cost.argmin())
    for i in range(len(m) - 1, -1, -1):
        end[i], at = at, int(came[i, at])
        start[i] = at
    return start, end, int(cost.min())


def _with_halo(rows: DataFrame, tile: int) -> DataFrame:
    """Each tile with the block before it (own = false)."""
    halo = rows.where(f"(n + 1) % {tile} = 0").withColumn("tile", F.col("tile") + 1)
    own = halo.join(rows.select("image", "comp", "tile").distinct(), ["image", "comp", "tile"], "left_semi")
    return rows.withColumn("own", F.lit(True)).unionByName(own.withColumn("own", F.lit(False)))


def with_dc(blocks: DataFrame, rate: DataFrame, g: Geometry, deltas: list[list[int]], interval: int = 0, tile: int = TILE) -> DataFrame:
    """image, comp, by, bx, dc, total from blocks (image, comp, by, bx, q, t): DC coefficients of least cost, and that cost of the whole component."""
    rows = numbered(blocks.selectExpr("image", "comp", "`by`", "bx", "get(q, 0) as q", "get(t, 0) as c"), g, interval, tile)
    rows, rate = _with_halo(rows, tile), rate.select("image", "th", "dc")

    def matrices(p: pd.DataFrame, sizes) -> tuple[pd.DataFrame, np.ndarray]:
        p = p.sort_values("n")
        q, first = p.q.to_numpy(np.int64), p["first"].to_numpy(bool)
        m = dc_matrices(q, p.c.to_numpy(np.int64), np.concatenate([[0], q[:-1]]), first, deltas[min(int(p.comp.iloc[0]), 1)][0], np.asarray(sizes, np.int64))
        own = p.own.to_numpy(bool)
        return p[own], m[own]

    def multiplied(p: pd.DataFrame, r) -> pd.DataFrame:
        own, m = matrices(p, r["dc"])
        return own[["image", "comp", "tile"]].iloc[:1].assign(m=[product(m).ravel()])

    def ends(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("tile")
        start, end, cost = chained(np.array(p.m.to_list(), np.int64).reshape(-1, 3, 3))
        return p[["image", "comp", "tile"]].assign(start=start, end=end, total=cost)

    products = _per_tile(rows, rate, multiplied, f"{_TILES}, m array<bigint>")
    known = spread(products, "image", "comp").groupBy("image", "comp").applyInPandas(ends, f"{_TILES}, start bigint, end bigint, total bigint")

    def chosen(p: pd.DataFrame, r) -> pd.DataFrame:
        own, m = matrices(p, r["dc"])
        dc = np.clip(own.q.to_numpy(np.int64) + traced(m, int(r["start"]), int(r["end"])) - 1, -MOST_DC, MOST_DC)
        return own[["image", "comp", "by", "bx"]].assign(dc=dc, total=int(r["total"]))

    both = known.withColumn("th", F.expr("least(comp, 1L)")).join(rate, ["image", "th"])
    return _met(rows, both, chosen, "image bigint, comp bigint, `by` bigint, bx bigint, dc bigint, total bigint")


def dc_cost(blocks: DataFrame, sizes: list[int], g: Geometry, deltas: list[list[int]], column: str = "q", interval: int = 0) -> DataFrame:
    """image, comp, cost: what DC coefficients (get(column, 0)) cost as they are, by code lengths that all components share."""
    rows = numbered(blocks.selectExpr("image", "comp", "`by`", "bx", f"get({column}, 0) as q", "get(t, 0) as c"), g, interval)
    before = F.when(F.col("first"), F.lit(0)).otherwise(F.lag("q").over(Window.partitionBy("image", "comp").orderBy("n")))
    table, delta = "array(" + ", ".join(f"{s}L" for s in sizes) + ")", "if(comp = 0, {}L, {}L)".format(*(d[0] for d in deltas))
    rows = rows.withColumn("d", F.col("q") - before).selectExpr("*", "if(d = 0, 0, length(bin(abs(d)))) as bits", f"{delta} as delta").selectExpr("*", f"q * delta * {1 << FRACTION} - c as e")
    own = f"e * e * {LAMBDA} div (delta * delta * {1 << (2 * FRACTION - UNIT)}) + (get({table}, bits) + bits) * {1 << UNIT}L"
    return rows.groupBy("image", "comp").agg(F.sum(F.expr(own)).alias("cost"))


def optimised(blocks: DataFrame, rate: DataFrame, g: Geometry, deltas: list[list[int]], interval: int = 0, tile: int = TILE) -> DataFrame:
    """image, comp, by, bx, q: blocks (with t, their transform) by least cost, AC and DC."""
    keys = ["image", "comp", "by", "bx"]
    both = with_ac(blocks, rate, g, deltas, tile).join(with_dc(blocks, rate, g, deltas, interval, tile), keys)
    return both.selectExpr(*[f"`{k}`" for k in keys], "transform(q, (x, i) -> if(i = 0, dc, x)) as q")
