"""Files to coefficients, a restart segment a row: headers, alignment of segments, first passes side by side, refinements in order.

Headers (one row for each scan: geometry, bands, code tables in force) come from the marker relation without any entropy
coded data. A scan's data come in pieces, each after a restart marker; which segment a piece is, follows from the markers'
numbers modulo 8 (`aligned`): a number one to three ahead of the expected one means that segments were lost, any other one
that the piece is behind (repeated or late) and is dropped. Expected segments meet their pieces by a left join, and each is
decoded by itself: a first pass needs nothing but its own segment. Blocks of several scans (bands of a spectrum) are summed.
Only refinements need what came before them: an image that has some is finished in one group.

The blocks of a lost segment are zeros, those of a broken one are what was read before the break and then zeros; none of
them is valid. A broken refinement changes nothing. An image without a frame or a scan gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.tables import spread, written
from lumenframe.operators import markers as M
from lumenframe.operators import scans as S
from lumenframe.operators.blocks import zigzag

_CODES = "codes array<struct<tc: bigint, comp: bigint, sizes: array<bigint>, symbols: array<bigint>>>"
HEADERS = f"image bigint, scan bigint, width bigint, height bigint, kind bigint, factors array<array<bigint>>, comps array<bigint>, ss bigint, se bigint, ah bigint, al bigint, step bigint, segments bigint, {_CODES}, cond array<array<bigint>>"
NAMES = ["image", "scan", "width", "height", "kind", "factors", "comps", "ss", "se", "ah", "al", "step", "segments", "codes", "cond"]
BLOCKS = "image bigint, comp bigint, `by` bigint, bx bigint, q array<bigint>, valid boolean"
#: Markers ahead by less than this are taken for later segments, others for earlier ones.
AHEAD = 4


def headers(m: DataFrame) -> DataFrame:
    """HEADERS: one row for each scan. segments: how many restart segments it should have, of `step` MCUs each."""
    what = {
        "frame": (M.frames(m), "width, height, marker"), "comp": (M.components(m), "comp, id, h, v"), "scan": (M.scans(m), "place, id, td, ta, ss, se, ah, al"),
        "code": (M.huffman(m), "tc, th, place, size, symbol"), "cond": (M.conditioning(m), "tc, tb, low, high"), "rst": (M.intervals(m), "interval"),
    }
    rows = None
    for name, (df, columns) in what.items():
        df = df.selectExpr("image", "seq", f"'{name}' as what", f"array({columns}) as v")
        rows = df if rows is None else rows.unionByName(df)

    def gathered(p: pd.DataFrame) -> pd.DataFrame:
        parts = {k: sorted(((r.seq, *(None if x is None else int(x) for x in r.v)) for r in x.itertuples()), key=lambda r: r[:2]) for k, x in p.groupby("what")}
        out = []
        if "frame" not in parts or "scan" not in parts:
            return pd.DataFrame(columns=NAMES)
        _, width, height, kind = parts["frame"][0]
        ids = [c[2] for c in parts["comp"]]
        g = S.Geometry(width, height, [(c[3], c[4]) for c in parts["comp"]])
        codes: dict[tuple, dict] = defaultdict(dict)
        for at, tc, th, place, size, symbol in parts.get("code", []):
            codes[tc, th, at][place] = (size, symbol)
        for seq in sorted({s[0] for s in parts["scan"]}):
            of = [s for s in parts["scan"] if s[0] == seq]
            comps = [ids.index(s[2]) for s in of]
            latest = {(tc, th): at for tc, th, at in sorted(codes) if at < seq}  # a later table replaces an earlier one
            tables = []
            for c, s in zip(comps, of, strict=True):
                for tc, th in ((0, s[3]), (1, s[4])):
                    if (tc, th) in latest:
                        x = [v for _, v in sorted(codes[tc, th, latest[tc, th]].items())]
                        tables.append({"tc": tc, "comp": c, "sizes": [n for n, _ in x], "symbols": [v for _, v in x]})
            cond = []
            for c, s in zip(comps, of, strict=True):
                for tc in (0, 1):
                    said = next((r[3:] for r in reversed(parts.get("cond", [])) if r[0] < seq and r[1:3] == (tc, s[3 + tc])), (0, 1) if tc == 0 else (5, 0))
                    cond.append([tc, c, *(int(x or 0) for x in said)])
            mcus = len_order(g, comps)
            step = next((r[1] for r in reversed(parts.get("rst", [])) if r[0] < seq), 0) or max(mcus, 1)
            out.append([p.image.iloc[0], seq, width, height, kind, [list(f) for f in g.factors], comps, *of[0][5:9], step, -(-mcus // step), tables, cond])
        return pd.DataFrame(out, columns=NAMES)

    return spread(rows, "image").groupBy("image").applyInPandas(gathered, HEADERS)


def len_order(g: S.Geometry, comps: list[int]) -> int:
    """The number of MCUs of a scan."""
    if len(comps) > 1:
        return g.across * g.down
    w, h = g.size(comps[0])
    return w * h


def segment_blocks(g: S.Geometry, comps: list[int], first: int, n: int) -> list[tuple[int, int, int]]:
    """(comp, by, bx) of the blocks of MCUs first to first + n - 1, in order."""
    out = []
    for u in range(first, min(first + n, len_order(g, comps))):
        if len(comps) == 1:
            w, _ = g.size(comps[0])
            out.append((comps[0], u // w, u % w))
            continue
        my, mx = divmod(u, g.across)
        for c in comps:
            h, v = g.factors[c]
            out += [(c, my * v + j, mx * h + i) for j in range(v) for i in range(h)]
    return out


def placed(numbers: list[int], segments: int) -> list[int | None]:
    """The segment of each piece by its marker's number (the first piece has none, -1): None where it is dropped."""
    out, wanted = [], 0
    for number in numbers:
        if number < 0:
            out.append(0)
            wanted = 1
            continue
        ahead = (number - (wanted - 1)) % 8
        if ahead < AHEAD and wanted + ahead < segments:
            out.append(wanted + ahead)
            wanted += ahead + 1
        else:
            out.append(None)
    return out


def aligned(m: DataFrame, heads: DataFrame) -> DataFrame:
    """image, scan, seg, seq: which of the image's marker rows has the data of each segment. Only numbers of markers are looked at, no data."""
    scans = heads.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("scan", "segments"))).alias("scans"))
    rows = m.where("marker = 0 or marker between 208 and 215").selectExpr("image", "seq", "if(marker = 0, -1L, marker - 208) as number")
    rows = rows.join(scans, "image").selectExpr("image", "seq", "number", "element_at(filter(scans, x -> x.scan < seq), -1) as s").selectExpr("image", "seq", "number", "s.scan as scan", "s.segments as segments")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                pieces = sorted((x["seq"], x["number"]) for x in r["p"])
                seg = placed([n for _, n in pieces], r["segments"])
                out += [(r["image"], r["scan"], seq, s) for (seq, _), s in zip(pieces, seg, strict=True) if s is not None]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], names=["image", "scan", "seq", "seg"])

    rows = rows.groupBy("image", "scan").agg(F.first("segments").alias("segments"), F.collect_list(F.struct("seq", "number")).alias("p"))
    return rows.where("scan is not null").mapInArrow(numbered, "image bigint, scan bigint, seq bigint, seg bigint")


def segments(m: DataFrame, heads: DataFrame) -> DataFrame:
    """The headers once for each segment that a scan should have (seg), with its data (null: lost)."""
    found = aligned(m, heads).join(m.select("image", "seq", F.col("payload").alias("data")), ["image", "seq"]).drop("seq")
    key = ["image", "scan", "seg"]
    each = heads.select("*", F.explode(F.expr("sequence(0L, segments - 1)")).alias("seg"))
    return spread(each, *key).join(found, key, "left")


def _tables(r) -> dict:
    return {(int(c["tc"]), int(c["comp"])): S.lookup(tuple(map(int, c["sizes"])), tuple(map(int, c["symbols"]))) for c in r.codes}


def _read(r, rows: list, coder) -> bool:
    """Fills the blocks of a segment as far as it can be read; False if it is lost or broken."""
    try:
        if r.data is None:
            return False
        if coder is not None and r.kind in (0xC9, 0xCA):
            coder(r.data, rows, {(int(c[0]), int(c[1])): tuple(map(int, c[2:])) for c in r.cond}, int(r.ss), int(r.se), int(r.ah), int(r.al))
        else:
            bits, tables, band = S.Bits(r.data), _tables(r), (int(r.ss), int(r.se), int(r.al))
            if r.ah:
                S.read_refinement(bits, rows, tables, *band)
            else:
                S.read_first(bits, rows, tables, *band, progressive=r.kind == 0xC2)
    except (ValueError, IndexError, KeyError):
        return False
    return True


def _geometry(r) -> S.Geometry:
    return S.Geometry(int(r.width), int(r.height), [tuple(map(int, f)) for f in r.factors])


#: Segments whose headers are Python objects at a time, and blocks of a batch that Python hands back.
ROWS, BATCH_BLOCKS = 64, 4096


def first_passes(segs: DataFrame, coder=None) -> DataFrame:
    """image, scan, comp, by, bx, q, valid: the blocks of each segment of the scans that aren't refinements. A row is decoded by itself: no shuffle."""
    back = np.argsort(zigzag())
    names = ["image", "scan", "comp", "by", "bx", "q", "valid"]

    def sent(found: list[tuple]) -> pa.RecordBatch:
        n = [len(f[2]) for f in found]
        keys = np.array([k for f in found for k in f[2]], np.int64).reshape(-1, 3)
        q = np.array([x for f in found for _, x in f[3]], np.int64).reshape(-1, 64)[:, back]
        image, scan, valid = (np.repeat(np.array([f[k] for f in found]), n) for k in (0, 1, 4))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * len(q) + 1, 64), pa.int32()), pa.array(q.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(image), pa.array(scan), *(pa.array(np.ascontiguousarray(keys[:, k])) for k in range(3)), flat, pa.array(valid)], names=names)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                for x in b.slice(at, ROWS).to_pylist():
                    r = SimpleNamespace(**x)
                    keys = segment_blocks(_geometry(r), r.comps, r.seg * r.step, r.step)
                    rows = [(k[0], [0] * 64) for k in keys]
                    found.append((r.image, r.scan, keys, rows, _read(r, rows, coder)))
                    n += len(keys)
                    if n >= BATCH_BLOCKS:
                        yield sent(found)
                        found, n = [], 0
        if found:
            yield sent(found)

    return segs.where("ah = 0").mapInArrow(decoded, BLOCKS.replace("comp", "scan bigint, comp", 1))


def refined(blocks: DataFrame, segs: DataFrame, coder=None) -> DataFrame:
    """Blocks (BLOCKS) of images with refinements, which take them in order of scans: a group an image."""
    order = np.array(zigzag())
    back = np.argsort(order)
    more = segs.where("ah > 0").select(F.col("image").alias("own_image"), *[F.col(c).alias(c) for c in segs.columns if c != "image"])

    def done(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        at = {(int(c), int(y), int(x)): k for k, (c, y, x) in enumerate(zip(p.comp, p["by"], p.bx, strict=True))}
        q = [np.asarray(v, np.int64)[order].tolist() for v in p.q]
        valid = p.valid.tolist()
        for r in s.sort_values(["scan", "seg"]).itertuples():
            keys = [k for k in segment_blocks(_geometry(r), [int(c) for c in r.comps], int(r.seg) * int(r.step), int(r.step)) if k in at]
            rows = [(k[0], q[at[k]].copy()) for k in keys]
            if _read(r, rows, coder):
                for k, (_, x) in zip(keys, rows, strict=True):
                    q[at[k]] = x
            else:
                for k in keys:
                    valid[at[k]] = False
        return p[["image", "comp", "by", "bx"]].assign(q=[np.array(x)[back] for x in q], valid=valid)

    return spread(blocks, "image").groupBy("image").cogroup(spread(more, "own_image").groupBy("own_image")).applyInPandas(lambda p, s: done(p, s) if len(p) else p, BLOCKS)


def summed(first: DataFrame) -> DataFrame:
    """image, comp, by, bx, q, valid: the blocks of an image's first passes, each the sum of its bands."""
    total = "aggregate(q, array_repeat(0L, 64), (s, x) -> zip_with(s, x, (a, b) -> a + b))"
    rows = first.groupBy("image", "comp", "by", "bx").agg(F.collect_list("q").alias("q"), F.bool_and("valid").alias("valid"))  # at most a block's scans
    return rows.selectExpr("image", "comp", "`by`", "bx", f"if(size(q) = 1, q[0], {total}) as q", "valid")


def decode(m: DataFrame, coder=None) -> DataFrame:
    """image, comp, by, bx, q, valid: the coefficient blocks of all files (marker relation m), from their own tables. coder: reads a segment of an arithmetic coded scan."""
    heads = written(headers(m))  # a few numbers and tables for each scan
    refining = heads.where("ah > 0").select(F.col("image").alias("refined_image")).distinct()
    same = F.col("image") == F.col("refined_image")
    plain = summed(first_passes(segments(m, heads.join(refining, same, "left_anti")), coder))
    if refining.isEmpty():
        return plain
    segs = segments(m, heads.join(refining, same, "left_semi"))
    return plain.unionByName(refined(summed(first_passes(segs, coder)), segs, coder))
