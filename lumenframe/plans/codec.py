"""Queries of whole scans, marker segments, boxes and arithmetic coding, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.tables import spread, written
from lumenframe.operators import arithmetic as A
from lumenframe.operators import blocks as B
from lumenframe.operators import boxes as BX
from lumenframe.operators import colour as C
from lumenframe.operators import decoding as DE
from lumenframe.operators import deringing as DR
from lumenframe.operators import entropy as E
from lumenframe.operators import lossless as LL
from lumenframe.operators import markers as M
from lumenframe.operators import scans as S
from lumenframe.operators import segments as G
from lumenframe.operators import stats as ST
from lumenframe.operators import tables as TB
from lumenframe.operators import tone as T
from lumenframe.sources import fixtures as X

#: Images of 4 x 4 MCUs in 4:2:0, six blocks each; the last image is filled up with blocks of zeros.
GEOMETRY = S.Geometry(64, 64, [(2, 2), (1, 1), (1, 1)])
SEQUENTIAL = [((0, 1, 2), 0, 63, 0, 0)]
_MCU = "block % 96 div 6"


def image_blocks(q: DataFrame) -> DataFrame:
    """image, comp, by, bx, q from blocks (block, q)."""
    # The images' numbers are few bytes: merged into one task, they would be unfolded there to all blocks.
    grid = spread(q.selectExpr("block div 96 as image"), "image").distinct().selectExpr("image", "explode(sequence(image * 96, image * 96 + 95)) as block")
    full = grid.join(q, "block", "left").selectExpr("image", "block", "coalesce(q, array_repeat(0L, 64)) as q")
    luma = "block % 6 < 4"
    return full.selectExpr("image", f"if({luma}, 0L, block % 6 - 3) as comp", f"{_MCU} div 4 * if({luma}, 2, 1) + if({luma}, block % 6 div 2, 0) as `by`", f"{_MCU} % 4 * if({luma}, 2, 1) + if({luma}, block % 6 % 2, 0) as bx", "q")


def block_rows(found: DataFrame, known: DataFrame) -> DataFrame:
    """block, k, v of the blocks that are there."""
    mcu = "if(comp = 0, `by` div 2 * 4 + bx div 2, `by` * 4 + bx)"
    back = found.selectExpr(f"image * 96 + {mcu} * 6 + if(comp = 0, `by` % 2 * 2 + bx % 2, comp + 3) as block", "q")
    return B.exploded(back.join(known, "block"), "q")


class Coded:
    """One way to code the images: script, restart interval, kind of frame."""

    def __init__(self, quant, scans: list[tuple], interval: int, kind: int, late: bool = False):
        self.quant, self.scans, self.interval, self.kind, self.late = quant, scans, interval, kind, late

    def tokens(self, s: SparkSession, d: str) -> DataFrame:
        return S.tokens(image_blocks(self.quant(X.blocks(s, d))), S.script(s, self.scans), GEOMETRY, self.interval, self.kind == 0xC2)

    def markers(self, s: SparkSession, d: str, deltas: list[int]) -> DataFrame:
        script = S.script(s, self.scans)
        if self.kind in (0xC9, 0xCA):
            segs = A.segments(image_blocks(self.quant(X.blocks(s, d))), script, GEOMETRY, self.interval)
            tables = s.createDataFrame([], "image bigint, scan bigint, tc bigint, th bigint, symbol bigint, size bigint, code bigint")
        else:
            segs, tables = S.two_pass(image_blocks(self.quant(X.blocks(s, d))), script, GEOMETRY, self.interval, self.kind == 0xC2)
        return written(E.markers(S.files(segs, tables, script, GEOMETRY, [deltas, deltas], self.interval, self.kind, self.late)))

    def round_trip(self, deltas: list[int]):
        coder = A.read if self.kind in (0xC9, 0xCA) else None
        return lambda s, d: block_rows(DE.decode(self.markers(s, d, deltas), coder), X.table(s, d, "embeddings").selectExpr("vec_id as block"))


def _payloads(s: SparkSession, d: str, marker: int, payload: str) -> DataFrame:
    """Marker rows with one segment for each document, its payload from doc_id."""
    return X.table(s, d, "documents").selectExpr("doc_id as image", "0L as seq", f"{marker}L as marker", f"{payload} as payload")


def register(add, raster, quant, deltas: list[int], quantized_sql: list[str]) -> None:
    """add, raster: as in the registry; quant: blocks to coefficients; quantized_sql: expressions that end in q (block, k, v)."""
    q_sql = f"with {', '.join(quantized_sql)} select block, k, v from q"
    ways = {
        "e1_interleaved_round_trip": (SEQUENTIAL, 3, 0xC1), "e1_without_restart_round_trip": (SEQUENTIAL, 0, 0xC1), "e3_progressive_round_trip": (G.default_script(), 0, 0xC2),
        "e4_progressive_restart_round_trip": (G.default_script(), 5, 0xC2), "e5_arithmetic_round_trip": (SEQUENTIAL, 4, 0xC9), "e6_arithmetic_progressive_round_trip": (G.default_script(), 0, 0xCA),
    }
    for name, way in ways.items():
        add(name, Coded(quant, *way).round_trip(deltas), q_sql)
    progressive, late = Coded(quant, G.default_script(), 0, 0xC2), Coded(quant, SEQUENTIAL, 0, 0xC1, late=True)
    images = "images as (select distinct vec_id // 96 as image from embeddings)"
    grid = "grid as (select image, image * 96 + r as block, case when r % 6 < 4 then 0 else r % 6 - 3 end as comp from images, range(0, 96) t(r)), dc as (select image, comp, block, coalesce(v, 0) as v from grid left join (select * from q where k = 0) q0 using (block))"
    cat = "case when d = 0 then 0 else length(bin(abs(d))) end"
    add("g1_progressive_dc_histogram", lambda s, d: S.histogram(progressive.tokens(s, d)).where("scan = 0").select("image", "th", "symbol", "n"),
        f"with {', '.join([*quantized_sql, images, grid])} select image, least(comp, 1)::bigint as th, ({cat})::bigint as symbol, count(*) as n from (select image, comp, (v >> 1) - coalesce(lag(v >> 1) over (partition by image, comp order by block), 0) as d from dc) group by all")
    add("g2_refinement_histogram", lambda s, d: S.histogram(progressive.tokens(s, d)).where("scan in (5, 7, 8, 9)"))
    add("x1_two_pass_tables", lambda s, d: S.code_tables(S.histogram(progressive.tokens(s, d))))
    add("io21_late_height", lambda s, d: M.frames(late.markers(s, d, deltas)).select("image", "marker", "precision", "height", "width", "n"), f"with {images} select image, 193 as marker, 8 as precision, 64 as height, 64 as width, 3 as n from images")
    add("io14_components", lambda s, d: M.components(late.markers(s, d, deltas)).drop("seq"), f"with {images} select image, c as comp, c + 1 as id, case when c = 0 then 2 else 1 end as h, case when c = 0 then 2 else 1 end as v, least(c, 1) as tq from images, range(0, 3) t(c)")
    script = [(k, p, c + 1, min(c, 1), *rest) for k, (cs, *rest) in enumerate(G.default_script()) for p, c in enumerate(cs)]
    values = ", ".join("(" + ", ".join(map(str, r)) + ")" for r in script)
    number = "cast(dense_rank() over (partition by image order by seq) - 1 as bigint) as scan"
    add("io15_scan_headers", lambda s, d: M.scans(progressive.markers(s, d, deltas)).selectExpr("image", number, "place", "id", "td", "ta", "ss", "se", "ah", "al"),
        f"with {images}, sc(scan, place, id, t, ss, se, ah, al) as (values {values}) select image, scan, place, id, t as td, t as ta, ss, se, ah, al from images, sc")
    z = ", ".join(f"({k}, {deltas[i]})" for k, i in enumerate(B.zigzag()))
    add("io16_quantization_tables", lambda s, d: M.quantization(late.markers(s, d, deltas)).drop("seq"), f"with {images}, z(k, delta) as (values {z}) select image, tq, 8 as bits, k, delta from images, z, range(0, 2) t(tq)")
    add("io17_code_tables", lambda s, d: M.huffman(progressive.markers(s, d, deltas)).where("tc = 0").select("image", "th", "symbol"),
        f"with {', '.join([*quantized_sql, images, grid])} select distinct image, least(comp, 1)::bigint as th, ({cat})::bigint as symbol from (select image, comp, (v >> 1) - coalesce(lag(v >> 1) over (partition by image, comp order by block), 0) as d from dc)")
    b = BX._bytes
    add("io18_conditioning", lambda s, d: M.conditioning(_payloads(s, d, M.DAC, f"concat({b('doc_id % 4', 1)}, {b('16 * (doc_id % 7 + 1) + doc_id % 3', 1)}, {b('16 + doc_id % 4', 1)}, {b('doc_id % 63 + 1', 1)})")).drop("seq"),
        "select doc_id as image, 0 as tc, doc_id % 4 as tb, doc_id % 3 as low, doc_id % 7 + 1 as high from documents union all select doc_id, 1, doc_id % 4, doc_id % 63 + 1, null from documents")
    five = ["doc_id % 4096", "doc_id % 100", "doc_id % 1000", "doc_id % 5000", "doc_id % 64"]
    add("io19_thresholds", lambda s, d: M.thresholds(_payloads(s, d, M.LSE, f"concat(X'01', {', '.join(b(x, 2) for x in five)})")).drop("seq"), f"select doc_id as image, {', '.join(f'{x} as {n}' for x, n in zip(five, ('high', 't1', 't2', 't3', 'reset'), strict=True))} from documents")
    kinds = {M.APP0: f"concat(cast('JFIF' as binary), X'000102', X'01', {b('doc_id % 600', 2)}, {b('doc_id % 300', 2)}, X'0000')", M.APP14: f"concat(cast('Adobe' as binary), X'0064', X'00000000', {b('doc_id % 3', 1)})", M.APP1: "concat(cast('Exif' as binary), X'0000', X'49492A0008000000', X'0000', X'00000000')"}

    def applications(s: SparkSession, d: str) -> DataFrame:
        rows = [_payloads(s, d, m, p).withColumn("seq", F.lit(k).cast("bigint")) for k, (m, p) in enumerate(kinds.items())]
        return M.application(rows[0].unionByName(rows[1]).unionByName(rows[2]))

    add("io20_application_markers", applications,
        "select doc_id as image, 0 as seq, 'jfif' as kind, 258 as version, 1 as unit, doc_id % 600 as dx, doc_id % 300 as dy, null::bigint as transform, null::boolean as little, null::bigint as entries from documents union all select doc_id, 1, 'adobe', 100, null, null, null, doc_id % 3, null, null from documents union all select doc_id, 2, 'exif', null, null, null, null, null, true, 0 from documents")

    # ---- boxes, from the documents' bytes
    types = "case doc_id % 4 when 0 then 'RESI' when 1 then 'FINE' when 2 then 'ALFA' else 'XXXX' end"

    def boxed(s: SparkSession, d: str, size: int = 1000, wide: bool = False) -> DataFrame:
        data = X.text_bytes(s, d).selectExpr("doc_id as image", "1L + doc_id % 3 as en", f"{types} as type", "data")
        return BX.split(data, size, wide).selectExpr("image", "z as seq", f"{M.APP11}L as marker", "payload")

    n = "octet_length(encode(coalesce(text, '')))"
    count = f"(greatest({n} - 1, 0) // 1000 + 1)"
    for name, wide in (("io22_boxes", False), ("io22_wide_boxes", True)):
        add(name, lambda s, d, w=wide: BX.layered(BX.reassembled(boxed(s, d, wide=w).repartition("image", "seq"))).select("image", "en", "type", "layer", "valid", F.md5("data").alias("md5")),
            f"select doc_id as image, 1 + doc_id % 3 as en, {types} as type, case doc_id % 4 when 0 then 'residual' when 1 then 'base_refinement' when 2 then 'alpha' end as layer, true as valid, md5(coalesce(text, '')) as md5 from documents")
    add("io22_incomplete_boxes", lambda s, d: BX.reassembled(boxed(s, d).where("seq <> 2")).select("image", "valid"), f"select doc_id as image, {count} < 2 as valid from documents")
    add("io23_box_segments", lambda s, d: BX.parts(boxed(s, d)).select("image", "en", "z", "length", "type", F.octet_length("data").cast("bigint").alias("n")),
        f"select doc_id as image, 1 + doc_id % 3 as en, k + 1 as z, {n} + 8 as length, {types} as type, least(1000, {n} - 1000 * k) as n from documents, range(0, {count}) t(k)")
    inner = "concat(repeat('x', cast(doc_id % 50 + k as int)), k)"

    def spec(s: SparkSession, d: str) -> DataFrame:
        rows = X.table(s, d, "documents").selectExpr("doc_id as image", "1L as en", "explode(sequence(0L, doc_id % 3)) as k", "doc_id").selectExpr("image", "en", "k as place", "concat('TY', k, 'Z') as type", f"cast({inner} as binary) as data")
        return BX.super_box(rows)

    add("io24_super_boxes", lambda s, d: BX.children(spec(s, d)).selectExpr("image", "place", "type", "cast(data as string) as data"), "select doc_id as image, k as place, 'TY' || k || 'Z' as type, repeat('x', (doc_id % 50 + k)::int) || k as data from documents, range(0, doc_id % 3 + 1) t(k)")
    add("io25_file_types", lambda s, d: BX.file_type(X.table(s, d, "documents").selectExpr("doc_id as image", "'ftyp' as type", f"concat(cast('jpxt' as binary), {b('doc_id', 4)}, cast(array_join(transform(sequence(1, cast(doc_id % 3 + 1 as int)), k -> if(k = 1, 'xrad', 'acfp')), '') as binary)) as data")).selectExpr("image", "brand", "version", "array_join(compatible, ' ') as compatible"),
        "select doc_id as image, 'jpxt' as brand, doc_id as version, 'xrad' || repeat(' acfp', (doc_id % 3)::int) as compatible from documents")
    add("c13_alpha_modes", lambda s, d: BX.alpha_mode(X.table(s, d, "documents").selectExpr("doc_id as image", "'AMUL' as type", f"{b('16 * (doc_id % 4)', 1)} as data")), "select doc_id as image, ['opaque', 'regular', 'premultiplied', 'matte'][doc_id % 4 + 1] as mode from documents")

    def verified(s: SparkSession, d: str) -> DataFrame:
        own = ST.checksum(X.text_bytes(s, d), "doc_id", "data")
        said = BX.checksums(own.selectExpr("doc_id as image", "'LCHK' as type", f"{b('if(doc_id % 5 = 0, checksum + 1, checksum)', 4)} as data"))
        return own.join(said.withColumnRenamed("image", "doc_id").withColumnRenamed("checksum", "said"), "doc_id").selectExpr("doc_id", "checksum = said as ok")

    add("g11_checksum_boxes", verified, "select doc_id, doc_id % 5 <> 0 as ok from documents")
    add("io12_next_marker", lambda s, d: M.next_of(late.markers(s, d, deltas), (M.SOS, 0xD9)), f"with {images} select image, k as seq, case when k <= 8 then 8 else 11 end as at from images, range(0, 12) t(k)")
    add("io28_injected_marker", lambda s, d: (lambda m: M.injected(m, m.select("image").distinct().selectExpr("image", "1L as before", "254L as marker", "cast('note' as binary) as payload")).selectExpr("image", "seq", "marker"))(late.markers(s, d, deltas).where("seq <= 3")),
        f"with {images}, v(seq, marker) as (values (0, 216), (1, 254), (2, 219), (3, 219), (4, 193)) select image, seq, marker from images, v")

    # ---- lossless scans
    nb = "nb as (select y, x, r as v, lag(r) over (partition by y order by x) as a, lag(r) over (partition by x order by y) as b, lag(r) over (partition by x - y order by y) as c from raster)"
    guess = {5: "a + ((b - c) >> 1)", 6: "b + ((a - c) >> 1)", 7: "(a + b) >> 1"}
    for mode, p in guess.items():
        raster(f"w2_predictor_{mode}_inverse", lambda px, k=mode: LL.restored(LL.residuals(px, k, 8), k), "select y, x, r as v from raster")
        e_sql = f"select y // 8 as seg, y, x, v - (case when x = 0 and y % 8 = 0 then 128 when y % 8 = 0 then a when x = 0 then b else {p} end) as e from nb"
        raster(f"w2_segment_residuals_{mode}", lambda px, k=mode: LL.residuals(px, k, 8), e_sql, nb)
    raster("e8_lossless_huffman_round_trip", lambda px: LL.round_trip(LL.residuals(px, 7, 8)), e_sql, nb)
    raster("e7_lossless_arithmetic_round_trip", lambda px: A.lossless_round_trip(LL.residuals(px, 7, 8), 8, 64).select("y", "x", "e"), e_sql.replace("y // 8 as seg, ", ""), nb)


def register_tone(add, raster, blocks, deltas: list[int], quantized_sql: list[str], quantized) -> None:
    """Tone tables, numbers by bits, deringing and masking. quantized: SQL text of quantized coefficients of a table of samples."""
    hist = lambda px: px.selectExpr("0L as comp", "r as ldr", "cast(floor(luma) as bigint) as hdr").groupBy("comp", "ldr", "hdr").agg(F.count(F.lit(1)).alias("n"))
    h = "h as (select r as ldr, cast(floor(luma) as bigint) as hdr, count(*) as n from raster group by 1, 2), c as (select *, sum(n) over (partition by ldr order by hdr) as upto, sum(n) over (partition by ldr) as total from h)"
    for name, median in (("g9_mean_anchors", False), ("g9_median_anchors", True)):
        mid = "when sum(n) > 1 then min(case when upto >= total // 2 then hdr end)::double" if median else ""
        raster(name, lambda px, m=median: TB.anchors(hist(px), 1024, m).selectExpr("ldr", "round(w, 6) as w", "low", "high"),
               f"select ldr, round(case when max(hdr) - min(hdr) > 512 then ((max(hdr) - min(hdr)) >> 1)::double {mid} else sum(hdr * n) / sum(n)::double end, 6) as w, min(hdr) as low, max(hdr) as high from c group by ldr", h)
    add("g9_inverse_map", lambda s, d: TB.inverse_map(hist(X.raster(s, d)), 1024, smooth=2, bits=2))
    # A table from the data: the raster's levels equalized by their cumulative counts.
    levels = lambda s, d: s.range(256).selectExpr("id as i").join(X.raster(s, d).groupBy(F.col("r").alias("i")).agg(F.count(F.lit(1)).alias("n")), "i", "left").selectExpr("i", "255 * sum(coalesce(n, 0L)) over (order by i) div greatest(sum(n) over (), 1L) as w")
    add("t5_inverted_table", lambda s, d: TB.inverted(levels(s, d), 8),
        f"with {X.RASTER_SQL}, t as (select i, (255 * sum(coalesce(n, 0)) over (order by i) // sum(n) over ())::bigint as w from range(0, 256) r(i) left join (select r as i, count(*) as n from raster group by 1) h using (i)), w as (select j as w from range(0, 256) q(j)), f as (select w, (min(i) + max(i)) >> 1 as i, min(i) as lo, max(i) as hi from t group by w), g as (select w.w, f.i, (select max(x.w) from f x where x.w < w.w) as b, (select min(x.w) from f x where x.w > w.w) as a from w left join f using (w)), r as (select g.w, coalesce(g.i, case when b is null then 0 when a is null then case when (select max(w) from f) < 192 then (select max(i) from t) else 0 end when g.w > ((b + a + 1) >> 1) - 1 then (select lo from f where f.w = a) else (select hi from f where f.w = b) end) as i from g), e as (select w, i, lead(i) over (order by w) as e1, lead(i, 2) over (order by w) as e2, lag(i) over (order by w) as a1, lag(i, 2) over (order by w) as a2 from r) select w, (case when w = 0 and abs(i - e1) > 2 * abs(e2 - e1) then 2 * e1 - e2 when w = 255 and abs(i - a1) > 2 * abs(a2 - a1) then 2 * a1 - a2 else i end)::bigint as i from e")
    add("t7_inverted_curve", lambda s, d: TB.inverted(T.lut(s, *T.SRGB), 16).where("w % 257 = 0").selectExpr("w div 257 as k", "i").join(X.raster(s, d).select(F.col("r").alias("k")), "k").groupBy("k", "i").agg(F.count(F.lit(1)).alias("n")))
    raster("t12_float_bits", lambda px: px.selectExpr("y", "x", f"{TB.float_bits('(luma - 300D)')} as single", f"{TB.float_bits('(luma - 300D)', 5, 10)} as half"),
           "select y, x, " + ", ".join(f"(case when v < 0 then {1 << (e + m)}::bigint else 0 end + case when v = 0 then 0 else (fl + {(1 << (e - 1)) - 2}) * {1 << m}::bigint + cast(floor(abs(v) / power(2.0, fl) * {1 << m}) as bigint) end)::bigint as {n}" for e, m, n in ((8, 23, "single"), (5, 10, "half"))) + " from (select y, x, v, case when abs(v) >= power(2.0, f + 1) then f + 1 when abs(v) < power(2.0, f) then f - 1 else f end as fl from (select y, x, luma - 300 as v, case when luma = 300 then 0 else greatest(floor(log2(abs(luma - 300)))::bigint, -14) end as f from raster))")
    raster("t12_bits_to_float", lambda px: px.selectExpr("y", "x", f"{TB.bits_float('(r * 121L)', 5, 10)} as v"), "select y, x, case when (r * 121) >> 10 = 0 then ((r * 121) & 1023) * power(2.0, -24) else (1024 + ((r * 121) & 1023)) * power(2.0, ((r * 121) >> 10) - 25) end as v from raster")
    raster("t11_output_conversion", lambda px: TB.output_converted(px.selectExpr("y", "x", "r * 3 - 200 as s"), "s", 8), "select y, x, greatest(0, least(255, r * 3 - 200)) as v from raster")
    raster("t11_output_table", lambda px: TB.output_converted(px, "r", 8, px.sparkSession.range(256).selectExpr("id as i", "id * 2 as w"), clip=False), "select y, x, (r * 2) & 255 as v from raster")
    raster("t11_output_half", lambda px: TB.output_converted(px.selectExpr("y", "x", "r * 400 - 20000 as s"), "s", 16, half=True), "select y, x, case when greatest(-31744, least(31743, r * 400 - 20000)) < 0 then 32768 | (-greatest(-31744, r * 400 - 20000) - 1) else least(31743, r * 400 - 20000) end as v from raster")
    cell = "cell as (select block, k // 16 as cy, k % 8 // 2 as cx, (sum(v)::bigint + 2) >> 2 as m from block64 group by all), va as (select block64.block, cy, cx, (sum((v - m) * (v - m))::bigint + 2) >> 2 > 400 as o from block64 join cell on cell.block = block64.block and cy = k // 16 and cx = k % 8 // 2 group by all), al as (select block, count(*) filter (where o) > 11 as a from va group by block)"
    blocks("g12_cleared_residual", lambda b: B.exploded(ST.cleared(b.selectExpr("block", "v", "transform(v, (x, i) -> x - i) as res"), 400), "res"),
           "select b.block, k, case when a or o then 128 else v - k end as v from block64 b join va on va.block = b.block and cy = k // 16 and cx = k % 8 // 2 join al on al.block = b.block", cell)
    step = "(select s.block, s.k, s.mask, case when s.mask = 0 then s.v else case when s.v <= 0 then least(n, 0) when s.v >= 255 then greatest(n, 255) else n end end as v from (select c.block, c.k, c.mask, c.v, (((4 * c.v + coalesce(l.v, c.v) + coalesce(r.v, c.v) + coalesce(u.v, c.v) + coalesce(w.v, c.v)) | 1) + 3) >> 3 as n from {0} c left join {0} l on l.block = c.block and l.k = c.k - 1 and c.k % 8 > 0 left join {0} r on r.block = c.block and r.k = c.k + 1 and c.k % 8 < 7 left join {0} u on u.block = c.block and u.k = c.k - 8 left join {0} w on w.block = c.block and w.k = c.k + 8) s)"
    over = max(2 * deltas[0], 31)
    m0 = f"mk as (select block, k, v, case when v <= 0 then -1 when v >= 255 then 1 else 0 end as mask, sum(v) over (partition by block)::bigint as total from block64), m0 as (select block, k, mask, case mask when 1 then 255 + least((16320 - total) >> 6, {over}) when -1 then 0 - least(total >> 6, {over}) else v end as v from mk), sm as (select block, count(*) filter (where mask = 1) between 1 and 63 or count(*) filter (where mask = -1) between 1 and 63 as s from mk group by block)"
    m1, m2, m3 = (f"m{k + 1} as {step.format(f'm{k}')}" for k in range(3))
    mod = "md as (select m3.block, m3.k, case when s then m3.v else block64.v end as v from m3 join sm on sm.block = m3.block join block64 on block64.block = m3.block and block64.k = m3.k)"
    blocks("d7_overshoot", lambda b: B.exploded(DR.smoothed(b, deltas[0]), "mod"), "select block, k, v from md", m0, m1, m2, m3, mod)
    blocks("d7_deringing", lambda b: B.exploded(DR.deringed(b, deltas), "q"),
           "select q.block, q.k, case when q.k = 0 then nq.v when q.v = 0 then 0 else greatest(-((1 << length(bin(abs(q.v)))) - 1), least((1 << length(bin(abs(q.v)))) - 1, nq.v)) end as v from q join nq on nq.block = q.block and nq.k = q.k",
           *quantized_sql[1:], m0, m1, m2, m3, mod, *quantized("md", "n"))

    shown = lambda t: t.selectExpr("py", "px", *[f"round({k}, 6) as {k}" for k in ("r", "g", "b", "luma")], "clipped")
    luma = " + ".join(f"{n} * {c}" for n, c in zip("rgb", C.LUMA, strict=True))
    v = "v as (select y as py, x as px, greatest((r - 20) / 255.0::double, 0) as a, greatest((g - 20) / 255.0::double, 0) as b, greatest((b - 20) / 255.0::double, 0) as c, least(r, g, b) < 20 as below from raster)"
    rgb = ", ".join(f"a * {p}::double + b * {q}::double + c * {r}::double as {n}" for (p, q, r), n in zip(C.XYZ_TO_RGB, "rgb", strict=True))
    for name, xyz, source in (("io2_read_rgb", False, "select py, px, a as r, b as g, c as b, below as low from v"), ("io2_read_xyz", True, f"select py, px, greatest(r, 0) as r, greatest(g, 0) as g, greatest(b, 0) as b, below or least(r, g, b) < 0 as low from (select py, px, below, {rgb} from v)")):
        raster(name, lambda px, k=xyz: shown(C.triple(px.selectExpr("y", "x", "r - 20 as r", "g - 20 as g", "b - 20 as b"), ("r", "g", "b"), k, 255.0)),
               f"select py, px, round(r, 6) as r, round(g, 6) as g, round(b, 6) as b, round({luma}, 6) as luma, low as clipped from ({source})", v)
    table = ", ".join(f"({k}, {t})" for k, t in enumerate(B.CHROMINANCE))
    add("q2_chrominance_table", lambda s, d: B.scaled_rows(X.table(s, d, "customer").selectExpr("c_custkey as key", "c_custkey % 100 + 1 as quality"), B.CHROMINANCE),
        f"with l(k, t) as (values {table}) select c_custkey as key, k, least(255, greatest(1, (t * (case when q < 50 then 5000 // q else 200 - 2 * q end) + 50) // 100)) as delta from l, (select c_custkey, c_custkey % 100 + 1 as q from customer)")
