"""Queries over whole files: damaged scans, pixels; with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.functions.tables import shared_dir, spread, tasks, written
from lumenframe.operators import blocks as B
from lumenframe.operators import boxes as BX
from lumenframe.operators import colour as C
from lumenframe.operators import decoding as DE
from lumenframe.operators import entropy as E
from lumenframe.operators import hierarchical as HI
from lumenframe.operators import layered as LY
from lumenframe.operators import merging as MG
from lumenframe.operators import reconstruction as RE
from lumenframe.operators import scans as S
from lumenframe.plans.codec import GEOMETRY, SEQUENTIAL, Coded, image_blocks
from lumenframe.sources import fixtures as X
from lumenframe.streaming import decoding as SD

#: Segments of three MCUs; an image has sixteen MCUs, hence six segments.
INTERVAL = 3


def damaged(m: DataFrame) -> DataFrame:
    """Marker rows of which, by image modulo 5, segment 2 is lost (1), repeated (2) or swapped with segment 3 (3), or segments 2 to 4 are lost (4)."""
    moved = "case when image % 5 = 3 and marker = 209 then seq + 1 when image % 5 = 3 and marker = 210 then seq - 1 else seq end"
    kept = m.where("not (image % 5 = 1 and marker = 209) and not (image % 5 = 4 and marker in (209, 210, 211))").selectExpr("image", f"2 * ({moved}) as seq", "marker", "payload")
    again = m.where("image % 5 = 2 and marker = 209").selectExpr("image", "2 * seq + 1 as seq", "marker", "payload")
    return kept.unionByName(again)


#: Matrices of the specifications below (13 fractional bits), and a table of 256 entries for ten bits.
LEFT, TURN, TABLE = [8192, 0, 4096, 8192, -2048, -1024, 8192, 6144, 0], [0, 8192, 0, 0, 0, 8192, 4096, 4096, 0], "transform(sequence(0, 255), i -> (i * i) div 64)"


def specifications(images: DataFrame) -> DataFrame:
    """Boxes (image, en, type, data) of each image, by its number modulo 4: none at all (0); a matrix and a table of its own for ten bits (1); no base matrix, a colour matrix, wrapped (2); the reversible residual (3)."""
    array = lambda m: "array(" + ", ".join(f"{x}L" for x in m) + ")"
    child = lambda when, place, kind, data: f"if(image % 4 = {when}, struct({place}L as place, '{kind}' as type, {data} as data), null)"
    inner = [
        child(1, 0, "LTRF", "X'50'"), child(1, 1, "MTRX", MG.matrix_box("5", array(LEFT))), child(1, 2, "LPTS", "X'3330'"), child(1, 3, "TONE", MG.table_box("3", TABLE, 2)), child(1, 4, "OCON", "X'220000'"),
        child(2, 0, "LTRF", "X'10'"), child(2, 1, "CTRF", "X'60'"), child(2, 2, "MTRX", MG.matrix_box("6", array(TURN))), child(2, 3, "OCON", "X'000000'"),
        child(3, 0, "RTRF", "X'40'"), child(3, 1, "OCON", "X'020000'"),
    ]
    rows = images.selectExpr("image", f"explode(filter(array({', '.join(inner)}), x -> x is not null)) as c").selectExpr("image", "1L as en", "c.place as place", "c.type as type", "c.data as data")
    return BX.super_box(rows)


#: (image modulo 5, segment) that is lost.
LOST = [(1, 2), (3, 2), (4, 2), (4, 3), (4, 4)]


def register(add, quant, deltas: list[int], quantized_sql: list[str], samples_sql: list[str], rgb_sql: str) -> None:
    """samples_sql: expressions that end in i2 (block, k, v), decoded samples; rgb_sql: r, g, b from y, cb, cr."""
    way = Coded(quant, SEQUENTIAL, INTERVAL, 0xC1)

    def resynchronised(s: SparkSession, d: str) -> DataFrame:
        found = DE.decode(damaged(way.markers(s, d, deltas)))
        mcu = "if(comp = 0, `by` div 2 * 4 + bx div 2, `by` * 4 + bx)"
        back = found.selectExpr(f"image * 96 + {mcu} * 6 + if(comp = 0, `by` % 2 * 2 + bx % 2, comp + 3) as block", "q", "valid")
        return back.join(X.table(s, d, "embeddings").selectExpr("vec_id as block"), "block").selectExpr("block", "valid", "posexplode(q) as (k, v)")

    lost = " or ".join(f"(block // 96 % 5 = {i} and block % 96 // 18 = {g})" for i, g in LOST)
    add("st3_damaged_scans", resynchronised, f"with {', '.join(quantized_sql)} select block, not ({lost}) as valid, k, case when {lost} then 0 else v end as v from q")

    def pixels(s: SparkSession, d: str) -> DataFrame:
        m = way.markers(s, d, deltas)
        return RE.pixels(DE.decode(m), m)

    w = GEOMETRY.width
    luma = "g.block % 6 < 4"
    images = "images as (select distinct vec_id // 96 as image from embeddings), grid as (select image, image * 96 + r as block, case when r % 6 < 4 then 0 else r % 6 - 3 end as comp, r // 6 as mcu from images, range(0, 96) g(r))"
    by, bx = f"(mcu // 4 * (case when {luma} then 2 else 1 end) + case when {luma} then g.block % 6 // 2 else 0 end)", f"(mcu % 4 * (case when {luma} then 2 else 1 end) + case when {luma} then g.block % 6 % 2 else 0 end)"
    plane = f"pl as (select image, comp, {by} * 8 + kk // 8 as y, {bx} * 8 + kk % 8 as x, coalesce(i2.v, 128) as v from (select * from grid, range(0, 64) k64(kk)) g left join i2 on i2.block = g.block and i2.k = g.kk)"
    rows = "nr as (select *, coalesce(lag(v) over w, v) as t, coalesce(lead(v) over w, v) as b from pl where comp > 0 window w as (partition by image, comp, x order by y)), ur as (select image, comp, 2 * y + k as y, x, case when k = 0 then (t + 3 * v + 2 - x % 2) >> 2 else (b + 3 * v + 1 + x % 2) >> 2 end as v from nr, range(0, 2) kk(k))"
    cols = "nc as (select *, coalesce(lag(v) over w, v) as l, coalesce(lead(v) over w, v) as r from ur window w as (partition by image, comp, y order by x)), uc as (select image, comp, y, 2 * x + k as x, case when k = 0 then (l + 3 * v + 2) >> 2 else (r + 3 * v + 1) >> 2 end as v from nc, range(0, 2) kk(k))"
    ycc = f"ycc as (select p.image, p.y as py, p.x as px, p.v * 16 as y, u.v * 16 as cb, w.v * 16 as cr from pl p join uc u on u.image = p.image and u.y = p.y and u.x = p.x and u.comp = 1 join uc w on w.image = p.image and w.y = p.y and w.x = p.x and w.comp = 2 where p.comp = 0 and p.x < {w})"
    add("rec_file_to_pixels", pixels, f"with {', '.join([*samples_sql, images, plane, rows, cols, ycc])} select image, py as y, px as x, {rgb_sql} from ycc")

    def planes(s: SparkSession, d: str) -> DataFrame:
        m = way.markers(s, d, deltas)
        return RE.planes(DE.decode(m), m)

    def by_specification(s: SparkSession, d: str) -> DataFrame:
        base = written(planes(s, d))
        boxes = BX.reassembled(BX.split(specifications(base.select("image").distinct()), 100).selectExpr("image", "z as seq", "235L as marker", "payload"))
        residual = base.selectExpr("image", "y", "x", "100L + (y * 3 + x) % 56 as r0", "if(image % 4 = 3, 256L, 100L) + (y + 5 * x) % 50 as r1", "if(image % 4 = 3, 240L, 110L) + (y * x) % 40 as r2")
        return MG.merged(base, MG.specification(boxes), residual)

    matrix = lambda m, v: [f"({' + '.join(f'{x} * {m[3 * i + k]}' for k, x in enumerate(v))})" for i in range(3)]
    clip = lambda x: f"greatest(0, least(255, {x}))"
    flat = [x for row in C.INVERSE for x in row]
    kinds = {0: (flat, True), 1: (LEFT, False), 2: ([8192, 0, 0, 0, 8192, 0, 0, 0, 8192], False), 3: (flat, True)}
    base = "case image % 4 " + "{}" + " end"
    rgb = [base.format(" ".join(f"when {k} then {clip(f'({matrix(m, ["y", "(cb - 2048)" if ycc_ else "cb", "(cr - 2048)" if ycc_ else "cr"])[i]} + 65536) >> 17')}" for k, (m, ycc_) in kinds.items())) for i in range(3)]
    mg = [f"mg as (select image, py as y, px as x, {', '.join(f'{e} as {n}' for e, n in zip(rgb, ('p', 'q', 'o'), strict=True))}, 100 + (py * 3 + px) % 56 as r0, case when image % 4 = 3 then 256 else 100 end + (py + 5 * px) % 50 as r1, case when image % 4 = 3 then 240 else 110 end + (py * px) % 40 as r2 from ycc)"]
    turned = matrix(TURN, ["p", "q", "o"])
    green = "((r0 - (((r1 - 256) + (r2 - 256)) >> 2)) & 255)"
    gap = {"r": ("p", "r0", f"(r2 - 256 + (r0 - (((r1 - 256) + (r2 - 256)) >> 2))) & 255"), "g": ("q", "r1", green), "b": ("o", "r2", f"(r1 - 256 + (r0 - (((r1 - 256) + (r2 - 256)) >> 2))) & 255")}
    out = ", ".join(
        f"case image % 4 when 0 then {clip(f'{p} + {r} - 128')} when 1 then greatest(0, least(1023, ({p} * {p}) // 64 + {r} - 512)) when 2 then (((({turned[i]} + 4096) >> 13) + {r} - 128) & 255) else {clip(f'{p} + ({rev}) - 128')} end as {n}"
        for i, (n, (p, r, rev)) in enumerate(gap.items())
    )
    add("merge_by_specification", by_specification, f"with {', '.join([*samples_sql, images, plane, rows, cols, ycc, *mg])} select image, y, x, {out} from mg")

    def layers(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
        """Files with a residual codestream, and the original samples (image, comp, by, bx, v)."""
        m = way.markers(s, d, deltas)
        original = image_blocks(X.blocks(s, d).withColumnRenamed("v", "q")).withColumnRenamed("q", "v")
        residual = written(LY.residuals(original, base_samples(m)))
        script = S.script(s, SEQUENTIAL)
        segs, tables = S.two_pass(residual, script, GEOMETRY, 0, False)
        second = S.files(segs, tables, script, GEOMETRY, [[1] * 64] * 2, 0, 0xC1)
        return LY.files(LY.embedded(m, second.selectExpr("image", "1L as en", "'RESI' as type", "file as data"), 1000)), original

    def base_samples(m: DataFrame) -> DataFrame:
        found = DE.decode(m).selectExpr("struct(image, comp, `by`, bx) as block", "q")
        return B.idct(B.dequantized(found, deltas)).selectExpr("block.*", "v")

    def residual_codestream(s: SparkSession, d: str) -> DataFrame:
        m = written(E.markers(layers(s, d)[0]))
        second = written(E.markers(LY.embedded_files(m)))
        whole = LY.sums(base_samples(m), DE.decode(second))
        mcu = "if(comp = 0, `by` div 2 * 4 + bx div 2, `by` * 4 + bx)"
        back = whole.selectExpr(f"image * 96 + {mcu} * 6 + if(comp = 0, `by` % 2 * 2 + bx % 2, comp + 3) as block", "v")
        return back.join(X.table(s, d, "embeddings").selectExpr("vec_id as block"), "block").selectExpr("block", "posexplode(v) as (k, v)")

    add("j6_residual_codestream", residual_codestream, f"with {X.BLOCK_SQL} select block, k, v from block64")

    def chunked(s: SparkSession, d: str) -> DataFrame:
        """The files in four batches of chunks, cut at places that depend on the image."""
        files = written(LY.files(way.markers(s, d, deltas))).selectExpr("image", "file", "octet_length(file) div 4 + 7 * (image % 3) as size")
        at = shared_dir(s)
        for n in range(4):
            end = "octet_length(file)" if n == 3 else "size"
            part = files.selectExpr("image", f"{n}L as n", f"substring(file, cast({n} * size + 1 as int), cast({end} as int)) as data")
            spread(part, "image").write.mode("append").parquet(f"{at}/chunks")
        found = SD.run_available(s, f"{at}/chunks", tasks(s))
        mcu = "if(comp = 0, `by` div 2 * 4 + bx div 2, `by` * 4 + bx)"
        back = found.where("valid").selectExpr(f"image * 96 + {mcu} * 6 + if(comp = 0, `by` % 2 * 2 + bx % 2, comp + 3) as block", "q")
        return B.exploded(back.join(X.table(s, d, "embeddings").selectExpr("vec_id as block"), "block"), "q")

    add("st1_chunks_to_blocks", chunked, f"with {', '.join(quantized_sql)} select block, k, v from q")

    # ---- twelve-bit coefficients whose two low bits are refinement scans in boxes
    wide = lambda b: quant(b).selectExpr("block", "transform(q, (v, k) -> v * 16 + k % 16) as q")
    refining = [(c, a, b, al + 1, al) for al in (1, 0) for c, a, b in [((0, 1, 2), 0, 0), *[((k,), 1, 63) for k in range(3)]]]
    fine = Coded(wide, [((0, 1, 2), 0, 0, 0, 2), *[((k,), 1, 63, 0, 2) for k in range(3)], *refining], 0, 0xC2)

    def coefficients(s: SparkSession, d: str, found: DataFrame) -> DataFrame:
        mcu = "if(comp = 0, `by` div 2 * 4 + bx div 2, `by` * 4 + bx)"
        back = found.selectExpr(f"image * 96 + {mcu} * 6 + if(comp = 0, `by` % 2 * 2 + bx % 2, comp + 3) as block", "q")
        return B.exploded(back.join(X.table(s, d, "embeddings").selectExpr("vec_id as block"), "block"), "q")

    def hidden_files(s: SparkSession, d: str) -> DataFrame:
        return written(E.markers(LY.files(LY.hidden(fine.markers(s, d, deltas), 1000))))

    value = "(v * 16 + k % 16)"
    add("q7_hidden_scans", lambda s, d: coefficients(s, d, DE.decode(written(LY.with_hidden(hidden_files(s, d))))), f"with {', '.join(quantized_sql)} select block, k, {value} as v from q")
    add("q7_visible_scans", lambda s, d: coefficients(s, d, DE.decode(hidden_files(s, d))),
        f"with {', '.join(quantized_sql)} select block, k, case when k = 0 then ({value} >> 2) * 4 else sign({value})::bigint * (abs({value}) >> 2) * 4 end as v from q")

    # ---- coefficients of up to 17 bits
    large = Coded(lambda b: b.selectExpr("block", "transform(v, (x, k) -> if((x + k) % 5 < 2, 0L, x * 513 - 65536)) as q"), SEQUENTIAL, INTERVAL, 0xC1)
    add("e2_large_range", lambda s, d: coefficients(s, d, DE.decode(large.markers(s, d, deltas))), f"with {X.BLOCK_SQL} select block, k, case when (v + k) % 5 < 2 then 0 else v * 513 - 65536 end as v from block64")

    # ---- three levels of grey images of 64 x 64; the last one is filled up with grey
    def grey(s: SparkSession, d: str) -> DataFrame:
        b = X.blocks(s, d)
        grid = spread(b.selectExpr("block div 64 as image"), "image").distinct().selectExpr("image", "explode(sequence(image * 64, image * 64 + 63)) as block")
        full = grid.join(b, "block", "left").selectExpr("image", "block % 64 as at", "posexplode(coalesce(v, array_repeat(128L, 64))) as (k, v)")
        return written(full.selectExpr("image", "at div 8 * 8 + k div 8 as y", "at % 8 * 8 + k % 8 as x", "v"))

    def hierarchical(s: SparkSession, d: str) -> DataFrame:
        m = written(E.markers(LY.files(HI.files(grey(s, d), 64, 64, deltas))))
        return HI.decoded(m, deltas)[-1]

    add("j7_hierarchical_files", hierarchical,
        f"with {X.BLOCK_SQL}, g as (select image, image * 64 + a as block, a, k from (select distinct vec_id // 64 as image from embeddings), range(0, 64) t(a), range(0, 64) u(k)) select image, a // 8 * 8 + g.k // 8 as y, a % 8 * 8 + g.k % 8 as x, coalesce(v, 128) as v from g left join block64 on block64.block = g.block and block64.k = g.k")
