"""Symbol statistics, code tables, checksums and masking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def category(v: str) -> str:
    """The number of bits of |v|."""
    return f"case when {v} = 0 then 0 else length(bin(abs({v}))) end"


def dc_histogram(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy(F.expr(category("diff")).cast("bigint").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


def ac_symbols(q: DataFrame, order: list[int]) -> DataFrame:
    """block, symbol: run/size symbols of each block's AC coefficients in scan order: runs of 16 zeros (0xF0) and the end of block (0x00) included. q: block, q (array)."""
    # Arrays that a lambda looks into are bound first: an inlined one would be computed for each element.
    scan = "get(transform(array(q), w -> transform(array(" + ", ".join(f"{k}" for k in order[1:]) + "), k -> get(w, k))), 0)"
    s = q.selectExpr("block", f"{scan} as s").selectExpr("block", "filter(transform(s, (v, i) -> struct(i as i, v as v)), x -> x.v <> 0) as nz")
    runs = "get(transform(array(nz), z -> transform(z, (x, k) -> struct(x.i - if(k = 0, 0, get(z, k - 1).i + 1) as run, x.v as v))), 0)"
    s = s.selectExpr("block", f"{runs} as r", "if(size(nz) = 0 or element_at(nz, -1).i < 62, array(0L), cast(array() as array<bigint>)) as eob")
    symbols = f"flatten(transform(r, x -> concat(array_repeat(240L, cast(x.run div 16 as int)), array(cast(x.run % 16 * 16 + {category('x.v')} as bigint)))))"
    return s.selectExpr("block", f"explode(concat({symbols}, eob)) as symbol")


def code_sizes(counts: dict[int, int], limit: int = 16) -> dict[int, int]:
    """Code lengths of at most `limit` bits for symbols 0 to 255.

    A reserved symbol, 256, of count 1 keeps one code point free (no code of ones only). Of equal counts the higher
    symbol is merged first, so it lies deeper; the merged node stays at the place of the less frequent one. While a code
    is too long, the counts below the second least one (or one more than that, unless the two are neighbours) are
    raised to it.
    """
    counts = {s: n for s, n in counts.items() if n > 0}
    while True:
        heap = [(n, -s, (s,)) for s, n in counts.items()] + [(1, -256, (256,))]
        heapq.heapify(heap)
        depth = dict.fromkeys([*counts, 256], 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
        if max([0, *(depth[s] for s in counts)]) <= limit:
            return {s: depth[s] for s in counts}
        low, second = sorted(set(counts.values()))[:2] if len(set(counts.values())) > 1 else (max(counts.values()), 1 << 31)
        second += low + 1 != second
        counts = {s: max(n, second) for s, n in counts.items()}


def canonical(sizes: DataFrame) -> DataFrame:
    """symbol, size, code: canonical codes: in order of size and symbol, each the last one plus one, lengthened by zeros. At most 256 rows."""
    w = Window.orderBy("size", "symbol").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.expr("shiftleft(1L, cast(16 - size as int))")).over(w), F.lit(0))
    return sizes.withColumn("before", before).selectExpr("symbol", "size", "shiftright(before, cast(16 - size as int)) as code")


#: Bytes that a checksum takes at a time.
CHECKSUM_PIECE = 1 << 20
_WEIGHTS = np.arange(CHECKSUM_PIECE, 0, -1)


def fletcher(data) -> int:
    """Two sums modulo 255 of the bytes (any buffer), packed: the plain one, and one weighted by the distance to the end."""
    s1 = s2 = 0
    whole = np.frombuffer(data, np.uint8)
    for at in range(0, len(whole), CHECKSUM_PIECE):
        b = whole[at : at + CHECKSUM_PIECE].astype(np.int64)
        s2 = (s2 + len(b) * s1 + int(b @ _WEIGHTS[CHECKSUM_PIECE - len(b) :])) % 255
        s1 = (s1 + int(b.sum())) % 255
    return s1 + s2 * 256


def checksum(data: DataFrame, key: str, column: str) -> DataFrame:
    """key, checksum: `fletcher` of each row's bytes (null: null), linear in them. Rows are taken where they are: no shuffle."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [fletcher(x.as_buffer()) if x.is_valid else None for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.int64())], names=[key, "checksum"])

    return data.select(key, column).mapInArrow(summed, f"`{key}` {data.schema[key].dataType.simpleString()}, checksum bigint")


def masked(blocks: DataFrame, threshold: int) -> DataFrame:
    """block, cells, all_masked: how many 2x2 cells of a block vary more than the threshold, and whether the whole block counts as masked (over 11 of 16)."""
    cell = "transform(sequence(0, 15), c -> array(get(v, c div 4 * 16 + c % 4 * 2), get(v, c div 4 * 16 + c % 4 * 2 + 1), get(v, c div 4 * 16 + c % 4 * 2 + 8), get(v, c div 4 * 16 + c % 4 * 2 + 9)))"
    mean = "transform(cells, p -> struct(p as p, shiftright(aggregate(p, 2L, (s, x) -> s + x), 2) as m))"
    var = "transform(cells, c -> shiftright(aggregate(c.p, 2L, (s, x) -> s + (x - c.m) * (x - c.m)), 2))"
    d = blocks.selectExpr("block", f"{cell} as cells").selectExpr("block", f"{mean} as cells").selectExpr("block", f"{var} as var")
    return d.selectExpr("block", f"cast(size(filter(var, x -> x > {threshold})) as bigint) as cells").selectExpr("block", "cells", "cells > 11 as all_masked")


def cleared(blocks: DataFrame, threshold: int, middle: int = 128) -> DataFrame:
    """block, res from block, v (the original), res: residual samples in 2x2 cells that vary more than the threshold become the middle; all of a block's, if over 11 cells do."""
    # Arrays that a lambda looks into are bound first: an inlined one would be computed for each element.
    cells = "get(transform(array(v), w -> transform(sequence(0, 15), c -> transform(array(0, 1, 8, 9), o -> get(w, c div 4 * 16 + c % 4 * 2 + o)))), 0)"
    over = f"transform(transform({cells}, p -> struct(p as p, shiftright(aggregate(p, 2L, (s, x) -> s + x), 2) as m)), c -> shiftright(aggregate(c.p, 2L, (s, x) -> s + (x - c.m) * (x - c.m)), 2) > {threshold})"
    gone = "struct(o as o, size(filter(o, x -> x)) > 11 as whole)"
    kept = f"transform(res, (r, i) -> if(g.whole or get(g.o, i div 16 * 4 + i % 8 div 2), {middle}L, r))"
    return blocks.selectExpr("block", f"get(transform(transform(array({over}), o -> {gone}), g -> {kept}), 0) as res")


def extremes(blocks: DataFrame) -> DataFrame:
    """block, total, low, high: the sum of a block's samples, and how many are at its least and greatest value of the range."""
    count = lambda v: f"cast(size(filter(v, x -> x = {v})) as bigint)"
    return blocks.selectExpr("block", "aggregate(v, 0L, (s, x) -> s + x) as total", f"{count(0)} as low", f"{count(255)} as high")
