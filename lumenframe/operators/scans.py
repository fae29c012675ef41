"""Scans of several components: sequential, progressive and refining Huffman coding with tables made for the image.

A coded image is one flow of relations: blocks (image, comp, by, bx, q) are placed in each scan that holds their
component; each restart segment of a scan becomes symbols in one group (the serial step: DC prediction, runs of zeros,
runs of ended bands); symbols are counted, each table's code lengths and codes follow from its counts, codes are joined
back, and each segment's bits are packed. Reading goes the other way (`decoding`): markers give tables, frame and scans
as relations (`markers`), and each segment is decoded by itself.

A component's blocks beyond the image (in the last column and row of MCUs) are coded in scans of several components
only.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import tables
from lumenframe.functions.tables import spread
from lumenframe.operators import markers as M
from lumenframe.operators import stats
from lumenframe.operators.blocks import zigzag
from lumenframe.operators.entropy import marker, packed

#: Bits of the largest coefficient of a sequential scan; those of over 15 are coded as large range.
MOST_BITS = 21
#: More MCUs than an image can have: the segment of a scan without restarts.
WHOLE = 1 << 40
TOKENS = "image bigint, scan bigint, seg bigint, i bigint, tc bigint, th bigint, symbol bigint, value bigint, bits bigint"
SCRIPT = "scan bigint, comps array<bigint>, ss bigint, se bigint, ah bigint, al bigint"


class Geometry:
    """factors: (h, v) of each component; the image is width x height samples."""

    def __init__(self, width: int, height: int, factors: list[tuple[int, int]]):
        self.width, self.height, self.factors = width, height, factors
        self.h, self.v = max(h for h, _ in factors), max(v for _, v in factors)
        self.across, self.down = -(-width // (8 * self.h)), -(-height // (8 * self.v))

    def size(self, comp: int) -> tuple[int, int]:
        """Blocks in a row and in a column of a component that hold samples."""
        h, v = self.factors[comp]
        return -(-(-(-self.width * h // self.h)) // 8), -(-(-(-self.height * v // self.v)) // 8)

    def order(self, comps: list[int]) -> list[list[tuple[int, int, int]]]:
        """(comp, by, bx) of each MCU of a scan."""
        if len(comps) == 1:
            w, h = self.size(comps[0])
            return [[(comps[0], y, x)] for y in range(h) for x in range(w)]
        return [
            [(c, my * self.factors[c][1] + j, mx * self.factors[c][0] + i) for c in comps for j in range(self.factors[c][1]) for i in range(self.factors[c][0])]
            for my in range(self.down) for mx in range(self.across)
        ]


def script(spark: SparkSession, scans: list[tuple]) -> DataFrame:
    """Rows of a script of scans: (components, ss, se, ah, al)."""
    return spark.createDataFrame([(k, list(c), *rest) for k, (c, *rest) in enumerate(scans)], SCRIPT)


def placed(blocks: DataFrame, scans: DataFrame, g: Geometry, interval: int) -> DataFrame:
    """image, scan, seg, at, comp, q and the scan's parameters: every block in every scan that codes it, by integer arithmetic on its place."""
    rows = []
    for c, (h, v) in enumerate(g.factors):
        w, n = g.size(c)
        rows.append((c, h, v, w, n))
    size = F.broadcast(blocks.sparkSession.createDataFrame(rows, "comp bigint, h bigint, v bigint, w bigint, n bigint"))
    several = "size(comps) > 1"
    before = "aggregate(filter(comps, c -> c < comp), 0L, (s, c) -> s + element_at(areas, cast(c + 1 as int)))"
    areas = "array(" + ", ".join(f"{h * v}L" for h, v in g.factors) + ") as areas"
    b = blocks.join(size, "comp").join(F.broadcast(scans), F.expr("array_contains(comps, comp)")).selectExpr("*", areas)
    b = b.where(f"{several} or (by < n and bx < w)")
    b = b.selectExpr("*", f"if({several}, by div v * {g.across} + bx div h, by * w + bx) as mcu", f"if({several}, {before} + by % v * h + bx % h, 0L) as place")
    seg = f"mcu div {interval or WHOLE}L"  # a literal would be no key: a shuffle by it would be followed by another
    return b.selectExpr("image", "scan", f"{seg} as seg", "mcu * 64 + place as at", "comp", "q", "ss", "se", "ah", "al")


def _magnitude(v: int) -> tuple[int, int]:
    n = abs(v).bit_length()
    return n, (v if v >= 0 else v - 1) & ((1 << n) - 1)


def first_pass(rows: list[tuple[int, list[int]]], ss: int, se: int, al: int, progressive: bool):
    """(tc, component, symbol, value, bits) of a segment's blocks (component, coefficients in zig-zag order)."""
    before, ended, th = defaultdict(int), 0, 0

    def end():
        nonlocal ended
        if ended:
            n = ended.bit_length() - 1
            yield 1, th, n << 4, ended & ((1 << n) - 1), n
            ended = 0

    for comp, q in rows:
        if ss == 0:
            dc = q[0] >> al
            n, bits = _magnitude(dc - before[comp])
            before[comp] = dc
            yield 0, comp, n, bits, n
        if se == 0:
            continue
        th, run = comp, 0
        band = [(abs(v) >> al) * (1 if v > 0 else -1) for v in q[max(ss, 1) : se + 1]]
        last = max((k for k, v in enumerate(band) if v), default=-1)
        if last >= 0:
            yield from end()
        for v in band[: last + 1]:
            if not v:
                run += 1
                continue
            while run > 15:
                yield 1, comp, 0xF0, 0, 0
                run -= 16
            n, bits = _magnitude(v)
            if n > 15:  # large range: the size alone in a symbol that sequential scans don't use, then the run
                if progressive or n > MOST_BITS:
                    raise ValueError("a coefficient is too large for the scan")
                yield 1, comp, (n - 15) << 4, run << n | bits, n + 4
            else:
                yield 1, comp, run << 4 | n, bits, n
            run = 0
        if last + 1 < len(band):
            ended += 1
            if not progressive or ended == 0x7FFF:
                yield from end()
    yield from end()


def refinement(rows: list[tuple[int, list[int]]], ss: int, se: int, al: int):
    """As first_pass, for the next lower bit; a symbol of -1 is a row of plain bits."""
    ended, held, th = 0, [], 0

    def end():
        nonlocal ended, held
        if ended:
            n = ended.bit_length() - 1
            yield 1, th, n << 4, ended & ((1 << n) - 1), n
            for b in held:
                yield 1, th, -1, b, 1
            ended, held = 0, []

    for comp, q in rows:
        if ss == 0:
            yield 0, comp, -1, q[0] >> al & 1, 1
            continue
        th, run, own = comp, 0, []
        band = [(abs(v) >> al) * (1 if v > 0 else -1) for v in q[ss : se + 1]]
        last = max((k for k, v in enumerate(band) if abs(v) == 1), default=-1)
        for k, v in enumerate(band):
            if not v:
                run += 1
                continue
            while run > 15 and k <= last:
                yield from end()
                yield 1, comp, 0xF0, 0, 0
                yield from ((1, comp, -1, b, 1) for b in own)
                run, own = run - 16, []
            if abs(v) > 1:  # seen before: one more bit
                own.append(abs(v) & 1)
                continue
            yield from end()
            yield 1, comp, run << 4 | 1, int(v > 0), 1
            yield from ((1, comp, -1, b, 1) for b in own)
            run, own = 0, []
        if run or own:
            ended, held = ended + 1, held + own
            if ended == 0x7FFF or len(held) > 900:
                yield from end()
    yield from end()


def grouped(blocks: DataFrame, scans: DataFrame, g: Geometry, interval: int) -> DataFrame:
    """image, scan, seg, ss, se, ah, al, b: the blocks (at, comp, q) of each restart segment of each scan, a segment a row."""
    return spread(placed(blocks, scans, g, interval), "image", "scan", "seg").groupBy("image", "scan", "seg").agg(*[F.first(c).alias(c) for c in ("ss", "se", "ah", "al")], F.collect_list(F.struct("at", "comp", "q")).alias("b"))


def ordered(b: pa.RecordBatch) -> Iterator[tuple[dict, list[tuple[int, list[int]]]]]:
    """The numbers of each row of `grouped`, and its blocks (component, coefficients in zig-zag order) in order."""
    numbers, col, order = b.select([n for n in b.schema.names if n != "b"]).to_pylist(), b.column("b"), np.array(zigzag())
    for i, r in enumerate(numbers):
        rows = col[i].values
        at = np.argsort(rows.field("at").to_numpy(), kind="stable")
        q = rows.field("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, 64)[at][:, order]
        yield r, list(zip(rows.field("comp").to_numpy()[at].tolist(), q.tolist(), strict=True))


#: Tokens of a batch that Python hands back.
BATCH_TOKENS = 1 << 16
_PARTS = ["tc", "th", "symbol", "value", "bits"]
SEGMENT_TOKENS = "image bigint, scan bigint, seg bigint, " + ", ".join(f"{k} array<int>" for k in _PARTS)


def segment_tokens(blocks: DataFrame, scans: DataFrame, g: Geometry, interval: int = 0, progressive: bool = True) -> DataFrame:
    """SEGMENT_TOKENS: the tokens of each segment of each scan, in order; plain bits have symbol -1."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(keys: list, found: list[np.ndarray]) -> pa.RecordBatch:
            off = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32())
            flat = np.concatenate(found).astype(np.int32)
            cols = [pa.array(c, pa.int64()) for c in zip(*keys, strict=True)] + [pa.ListArray.from_arrays(off, pa.array(np.ascontiguousarray(flat[:, k]))) for k in range(5)]
            return pa.RecordBatch.from_arrays(cols, names=["image", "scan", "seg", *_PARTS])

        keys, found, n = [], [], 0
        for b in batches:
            for r, rows in ordered(b):
                own = refinement(rows, r["ss"], r["se"], r["al"]) if r["ah"] else first_pass(rows, r["ss"], r["se"], r["al"], progressive)
                x = np.array(list(own), np.int64).reshape(-1, 5)
                x = np.stack([x[:, 0], np.minimum(x[:, 1], 1), x[:, 2], x[:, 3], x[:, 4]], 1)
                keys.append((r["image"], r["scan"], r["seg"]))
                found.append(x)
                n += len(x)
                if n >= BATCH_TOKENS:
                    yield sent(keys, found)
                    keys, found, n = [], [], 0
        if keys:
            yield sent(keys, found)

    return grouped(blocks, scans, g, interval).mapInArrow(coded, SEGMENT_TOKENS)


def exploded(t: DataFrame) -> DataFrame:
    """TOKENS, a token a row, from SEGMENT_TOKENS."""
    rows = t.select("image", "scan", "seg", F.posexplode(F.arrays_zip(*_PARTS)).alias("i", "x"))
    return rows.selectExpr("image", "scan", "seg", "cast(i as bigint) as i", "cast(x.tc as bigint) as tc", "cast(x.th as bigint) as th", "cast(if(x.symbol < 0, null, x.symbol) as bigint) as symbol", "cast(x.value as bigint) as value", "cast(x.bits as bigint) as bits")


def tokens(blocks: DataFrame, scans: DataFrame, g: Geometry, interval: int = 0, progressive: bool = True) -> DataFrame:
    """TOKENS of every scan: symbols with the table class (tc) and table (th: 0 for the first component, else 1) they are coded by, and plain bits (symbol null)."""
    return exploded(segment_tokens(blocks, scans, g, interval, progressive))


def histogram(t: DataFrame) -> DataFrame:
    """image, scan, tc, th, symbol, n."""
    return t.where("symbol is not null").groupBy("image", "scan", "tc", "th", "symbol").agg(F.count(F.lit(1)).alias("n"))


def code_tables(counts: DataFrame) -> DataFrame:
    """image, scan, tc, th, symbol, size, code: codes of least total length for each table (two-pass coding). A table has at most 256 symbols."""

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                sizes = stats.code_sizes({x["symbol"]: x["n"] for x in sorted(r["s"], key=lambda x: x["symbol"])})
                out += [(r["image"], r["scan"], r["tc"], r["th"], s, n) for s, n in sizes.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 6)], names=["image", "scan", "tc", "th", "symbol", "size"])

    key = ["image", "scan", "tc", "th"]
    s = spread(counts, *key).groupBy(*key).agg(F.collect_list(F.struct("symbol", "n")).alias("s")).mapInArrow(sized, "image bigint, scan bigint, tc bigint, th bigint, symbol bigint, size bigint")
    before = "coalesce(sum(shiftleft(1L, cast(16 - size as int))) over (partition by image, scan, tc, th order by size, symbol rows between unbounded preceding and 1 preceding), 0L)"
    return s.selectExpr("*", f"shiftright({before}, cast(16 - size as int)) as code")


def segments(t: DataFrame, tables: DataFrame) -> DataFrame:
    """image, scan, seg, data: from TOKENS."""
    rows = t.groupBy("image", "scan", "seg").agg(F.array_sort(F.collect_list(F.struct("i", "tc", "th", F.coalesce("symbol", F.lit(-1)).alias("symbol"), "value", "bits"))).alias("x"))
    return packed_segments(rows.selectExpr("image", "scan", "seg", *[f"transform(x, e -> cast(e.{k} as int)) as {k}" for k in _PARTS]), tables)


def packed_segments(t: DataFrame, tables: DataFrame) -> DataFrame:
    """image, scan, seg, data: from SEGMENT_TOKENS. A segment meets its scan's tables in a row."""
    codes = tables.groupBy("image", "scan").agg(F.collect_list(F.struct("tc", "th", "symbol", "size", "code")).alias("t"))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                tc, th, symbol, value, bits = (b.column(k)[i].values.to_numpy().astype(np.int64) for k in _PARTS)
                size, code = np.zeros((2, 2, 257), np.int64), np.zeros((2, 2, 257), np.int64)  # the last one is for plain bits
                x = b.column("t")[i].values
                if x is not None:
                    at = tuple(x.field(k).to_numpy() for k in ("tc", "th", "symbol"))
                    size[at], code[at] = x.field("size").to_numpy(), x.field("code").to_numpy()
                v, n = np.stack([code[tc, th, symbol], value], 1), np.stack([size[tc, th, symbol], bits], 1)
                out.append(packed(v.ravel(), n.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("image", "scan", "seg")), pa.array(out, pa.binary())], names=["image", "scan", "seg", "data"])

    return spread(t, "image", "scan").join(codes, ["image", "scan"], "left").mapInArrow(written, "image bigint, scan bigint, seg bigint, data binary")


def two_pass(blocks: DataFrame, scans: DataFrame, g: Geometry, interval: int = 0, progressive: bool = True) -> tuple[DataFrame, DataFrame]:
    """Segments (image, scan, seg, data) and the tables made for them. Tokens are written once, a segment a row."""
    t = tables.written(segment_tokens(blocks, scans, g, interval, progressive))
    codes = tables.written(code_tables(histogram(exploded(t))))
    return packed_segments(t, codes), codes


def files(segs: DataFrame, tables: DataFrame, scans: DataFrame, g: Geometry, deltas: list[list[int]], interval: int = 0, kind: int = 0xC2, late_height: bool = False) -> DataFrame:
    """image, file. deltas: the quantization tables of the first and the other components. late_height: the height comes after the first scan."""
    coded = segs.groupBy("image", "scan").agg(F.array_sort(F.collect_list(F.struct("seg", "data"))).alias("s"))
    codes = tables.groupBy("image", "scan").agg(F.array_sort(F.collect_list(F.struct("tc", "th", "size", "symbol"))).alias("t"))
    rows = coded.join(codes, ["image", "scan"], "left").join(F.broadcast(scans), "scan")
    order = zigzag()
    frame = bytes([8]) + (0 if late_height else g.height).to_bytes(2, "big") + g.width.to_bytes(2, "big") + bytes([len(g.factors)])
    frame += b"".join(bytes([c + 1, h << 4 | v, min(c, 1)]) for c, (h, v) in enumerate(g.factors))
    start = b"\xff\xd8" + b"".join(marker(M.DQT, bytes([k]) + bytes(d[i] for i in order)) for k, d in enumerate(deltas)) + marker(kind, frame)
    start += marker(M.DRI, interval.to_bytes(2, "big")) if interval else b""

    def joined(p: pd.DataFrame) -> pd.DataFrame:
        out = start
        for k, r in enumerate(p.sort_values("scan").itertuples()):
            own = defaultdict(list)
            for x in r.t if r.t is not None else []:
                own[x["tc"], x["th"]].append((x["size"], x["symbol"]))
            for (tc, th), x in sorted(own.items()):
                counts = np.bincount([n for n, _ in x], minlength=17)[1:17]
                out += marker(M.DHT, bytes([tc << 4 | th]) + bytes(counts.tolist()) + bytes(s for _, s in sorted(x)))
            out += marker(M.SOS, bytes([len(r.comps)]) + b"".join(bytes([c + 1, min(c, 1) * 17]) for c in r.comps) + bytes([r.ss, r.se, r.ah << 4 | r.al]))
            out += b"".join(x["data"] + (bytes([0xFF, 0xD0 + j % 8]) if j + 1 < len(r.s) else b"") for j, x in enumerate(r.s))
            out += marker(M.DNL, g.height.to_bytes(2, "big")) if late_height and k == 0 else b""
        return pd.DataFrame({"image": p.image.iloc[:1], "file": [out + b"\xff\xd9"]})

    return spread(rows, "image").groupBy("image").applyInPandas(joined, "image bigint, file binary")


# ---- reading


@lru_cache(maxsize=64)
def lookup(sizes: tuple[int, ...], symbols: tuple[int, ...]) -> tuple[bytes, bytes]:
    """Symbol and length (0: no code) for each value of the next 16 bits: 128 KB a table."""
    sym, n, at = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8), 0
    for size, s in zip(sizes, symbols, strict=True):
        end = at + (1 << (16 - size))
        sym[at:end], n[at:end] = s, size
        at = end
    return sym.tobytes(), n.tobytes()


class Bits:
    """A segment's bits, most significant first; beyond its end they are ones."""

    def __init__(self, data: bytes):
        self.data, self.at = data.replace(b"\xff\x00", b"\xff") + b"\xff" * 8, 0

    def get(self, n: int) -> int:
        first = self.at >> 3
        v = int.from_bytes(self.data[first : first + 5], "big") >> (40 - (self.at & 7) - n) & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the segment is too short")
        return v

    def symbol(self, table: tuple[bytes, bytes]) -> int:
        v = self.get(16)
        n = table[1][v]
        if not n:
            raise ValueError("no such code")
        self.at -= 16 - n
        return table[0][v]

    def value(self, n: int) -> int:
        v = self.get(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


class Running:
    """What one block of a segment's first pass leaves to the next: DC values by component, and how many blocks are known to have ended."""

    def __init__(self, before: dict | None = None, ended: int = 0):
        self.before, self.ended = defaultdict(int, before or {}), ended


def read_first(bits: Bits, rows: list, tables: dict, ss: int, se: int, al: int, state: Running | None = None, progressive: bool = True) -> None:
    """Fills the blocks (component, zig-zag coefficients) of a segment, or goes on with it from a state. progressive: symbols without a size are runs of ended blocks, else of large range."""
    state = state or Running()
    for comp, q in rows:
        if ss == 0:
            state.before[comp] += bits.value(bits.symbol(tables[0, comp]))
            q[0] = state.before[comp] << al
        k = max(ss, 1)
        if state.ended:
            state.ended -= 1
            continue
        while k <= se:
            s = bits.symbol(tables[1, comp])
            run, n = s >> 4, s & 15
            if n:
                k += run
                q[k] = bits.value(n) * (1 << al)
                k += 1
            elif run == 15:
                k += 16
            elif run and not progressive:
                k += bits.get(4)
                q[k] = bits.value(15 + run) * (1 << al)
                k += 1
            else:
                state.ended = (1 << run) + bits.get(run) - 1
                break


def read_refinement(bits: Bits, rows: list, tables: dict, ss: int, se: int, al: int) -> None:
    ended, one = 0, 1 << al

    def more(q: list[int], k: int) -> None:
        if bits.get(1):
            q[k] += one if q[k] > 0 else -one

    for comp, q in rows:
        if ss == 0:
            q[0] |= bits.get(1) << al
            continue
        k = ss
        while k <= se and not ended:
            s = bits.symbol(tables[1, comp])
            run, new = s >> 4, 0
            if s & 15:
                new = one if bits.get(1) else -one
            elif run < 15:
                ended = (1 << run) + bits.get(run)
                break
            while k <= se:
                if q[k]:
                    more(q, k)
                elif run == 0:
                    q[k] = new
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        if ended:
            for j in range(k, se + 1):
                if q[j]:
                    more(q, j)
            ended -= 1


def decode(m: DataFrame, coder=None) -> DataFrame:
    """As decoding.decode, but valid is false for every block of an image that has a broken one."""
    from lumenframe.operators import decoding  # which builds on this module

    found = decoding.decode(m, coder)
    broken = found.where("not valid").select(F.col("image").alias("broken")).distinct()
    return found.drop("valid").join(broken, F.col("image") == F.col("broken"), "left").selectExpr("image", "comp", "`by`", "bx", "q", "broken is null as valid")
