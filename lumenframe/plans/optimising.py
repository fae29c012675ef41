"""Queries of coefficients chosen by rate and distortion, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.tables import written
from lumenframe.operators import blocks as B
from lumenframe.operators import decoding as DE
from lumenframe.operators import entropy as E
from lumenframe.operators import ratedistortion as R
from lumenframe.operators import scans as S
from lumenframe.plans.codec import GEOMETRY, SEQUENTIAL, image_blocks
from lumenframe.sources import fixtures as X

#: Code lengths of the standard's luminance tables, by symbol.
DC_SIZES, AC_SIZES = ([t.get(s, (0, 0))[1] for s in range(256)] for t in E.tables())
KEYS = ["image", "comp", "by", "bx"]


def transformed_blocks(b: DataFrame, quant) -> DataFrame:
    """image, comp, by, bx, q, t: images of the fixture's blocks, quantized, with their transform."""
    return image_blocks(quant(b)).join(image_blocks(B.fdct(b).withColumnRenamed("t", "q")).withColumnRenamed("q", "t"), KEYS)


def standard_rates(blocks: DataFrame) -> DataFrame:
    """image, th, dc, ac: the standard's code lengths for every image."""
    arrays = [F.array(*[F.lit(s).cast("bigint") for s in sizes]).alias(n) for n, sizes in (("dc", DC_SIZES), ("ac", AC_SIZES))]
    return blocks.select("image", F.least("comp", F.lit(1)).alias("th")).distinct().select("image", "th", *arrays)


def coded(blocks: DataFrame, interval: int, deltas: list[int]) -> tuple[DataFrame, DataFrame]:
    """Files of blocks (image, comp, by, bx, q) with tables made for them, and those tables."""
    script = S.script(blocks.sparkSession, SEQUENTIAL)
    segs, tables = S.two_pass(blocks, script, GEOMETRY, interval, False)
    return S.files(segs, tables, script, GEOMETRY, [deltas, deltas], interval, 0xC1), tables


def optimised_files(s: SparkSession, d: str, quant, deltas: list[int], interval: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plain files, optimised files and the coefficients chosen. Code lengths are those of the plain files."""
    blocks = written(transformed_blocks(X.blocks(s, d), quant))
    plain, tables = coded(blocks, interval, deltas)
    chosen = written(R.optimised(blocks, R.rates(tables), GEOMETRY, [deltas, deltas], interval))
    return plain, coded(chosen, interval, deltas)[0], chosen


def register(add, quant, deltas: list[int], quantized_sql: list[str]) -> None:
    both = [deltas, deltas]

    def dc(s: SparkSession, d: str, interval: int) -> DataFrame:
        blocks = transformed_blocks(X.blocks(s, d), quant)
        new = blocks.drop("q").join(R.with_dc(blocks, standard_rates(blocks), GEOMETRY, both, interval, tile=16), KEYS).selectExpr(*[f"`{k}`" for k in KEYS], "t", "array(dc) as q")
        plain, cost = (R.dc_cost(b, DC_SIZES[:16], GEOMETRY, both, interval=interval).withColumnRenamed("cost", n) for b, n in ((blocks, "plain_cost"), (new, "cost")))
        return plain.join(cost, ["image", "comp"])

    grid = "images as (select distinct vec_id // 96 as image from embeddings), grid as (select image, image * 96 + r as block, case when r % 6 < 4 then 0 else r % 6 - 3 end as comp, r // 6 as mcu from images, range(0, 96) g(r))"
    size = lambda sizes, x: f"list_value({', '.join(map(str, sizes))})[{x} + 1]"
    bits = lambda v: f"(case when {v} = 0 then 0 else length(bin(abs({v}))) end)"
    error = lambda v, delta, c: f"(({v} * {delta} * 4096 - {c})::hugeint * ({v} * {delta} * 4096 - {c}) // ({delta} * {delta} * 16))::bigint"
    rate = lambda diff: f"65536 * ({size(DC_SIZES[:12], bits(diff))} + {bits(diff)})"
    for name, interval in (("x4_dc_trellis", 0), ("x4_dc_trellis_restart", 3)):
        first = f"mcu % {interval} = 0 and (comp > 0 or block % 6 = 0)" if interval else "n = 1"
        series = f"dcs as (select *, {first} as fst, coalesce(lag(v) over (partition by image, comp order by n), 0) as p from (select image, comp, mcu, block, row_number() over (partition by image, comp order by block) as n, coalesce(q.v, 0) as v, coalesce(t.c, 0) as c from grid left join (select * from q where k = 0) q using (block) left join (select * from t where k = 0) t using (block)))"
        ways = [[f"j{a} + {rate(f'(v + {b - 1} - case when fst then 0 else p + {a - 1} end)')}" for a in range(3)] for b in range(3)]
        steps = ", ".join(f"(least({', '.join(w)}) + {error(f'(v + {b - 1})', deltas[0], 'c')})::bigint as j{b}" for b, w in enumerate(ways))
        walk = f"st(image, comp, n, j0, j1, j2) as (select distinct image, comp, 0::bigint, 0::bigint, 0::bigint, 0::bigint from dcs union all select dcs.image, dcs.comp, dcs.n, {steps} from st join dcs on dcs.image = st.image and dcs.comp = st.comp and dcs.n = st.n + 1)"
        plain = f"plain as (select image, comp, max(n) as n, sum({error('v', deltas[0], 'c')} + {rate('(v - case when fst then 0 else p end)')})::bigint as plain_cost from dcs group by image, comp)"
        sql = f"with recursive {', '.join([*quantized_sql, grid, series, walk, plain])} select image, comp, plain_cost, least(j0, j1, j2) as cost from plain join st using (image, comp, n)"
        add(name, lambda s, d, i=interval: dc(s, d, i), sql)

    def ac(s: SparkSession, d: str) -> DataFrame:
        blocks = transformed_blocks(X.blocks(s, d), quant)
        new = R.with_ac(blocks, standard_rates(blocks), GEOMETRY, both)
        again = R.with_ac(new.select(*KEYS, "q").join(blocks.select(*KEYS, "t"), KEYS), standard_rates(blocks), GEOMETRY, both).selectExpr(*[f"`{k}`" for k in KEYS], "plain_cost as cost")
        return new.drop("cost", "q").join(again, KEYS)

    order = B.zigzag()
    zz = f"zz(z, k, delta) as (values {', '.join(f'({z}, {k}, {deltas[k]})' for z, k in enumerate(order))})"
    lists = f"coef as (select block, z, q.v, {error('0', 'delta', 't.c')} as dz, {error('q.v', 'delta', 't.c')} as dk, {error('(sign(q.v)::bigint * ((1::bigint << greatest(' + bits('q.v') + ' - 1, 0)) - 1))', 'delta', 't.c')} as dl, {bits('q.v')} as b from q join t using (block, k) join zz using (k) where z > 0), per as (select block, list(b order by z) as b, list(dz order by z) as dz, list(dk order by z) as dk, list(dl order by z) as dl from coef group by block)"
    table = "list_value(" + ", ".join(str(x or 1 << 40) for x in AC_SIZES) + ")"
    run = "(k - 1 - l)"
    way = lambda dist, b: f"j[l + 1] - zc[l + 1] + zc[k] + {dist}[k] + 65536 * (({run} >> 4) * {AC_SIZES[0xF0]} + ac[(({run} & 15) << 4) + {b} + 1] + {b})"
    best = f"list_min([case when j[l + 1] is null then null when b[k] > 1 then least({way('dk', 'b[k]')}, {way('dl', '(b[k] - 1)')}) else {way('dk', 'b[k]')} end for l in range(0, k)])"
    walk = f"st(block, k, j, zc) as (select block, 1::bigint, [0::bigint], [0::bigint] from per union all select block, k + 1, list_append(j, case when b[k] = 0 then null else {best} end::bigint), list_append(zc, zc[k] + dz[k]) from st join per using (block), tb where k < 64)"
    plain = f"nz as (select *, z - 1 - coalesce(lag(z) over (partition by block order by z), 0) as r from coef where v <> 0), pl as (select per.block, (list_sum(dz) + coalesce((select sum(dk - dz + 65536 * ((r >> 4) * {AC_SIZES[0xF0]} + ac[((r & 15) << 4) + b + 1] + b)) from nz, tb where nz.block = per.block), 0) + case when coalesce((select max(z) from nz where nz.block = per.block), 0) < 63 then 65536 * {AC_SIZES[0]} else 0 end)::bigint as plain_cost from per)"
    end = f"list_min([j[l + 1] + zc[64] - zc[l + 1] + case when l < 63 then 65536 * {AC_SIZES[0]} else 0 end for l in range(0, 64)])"
    place = "(block % 96 // 6)"
    by = f"case when block % 6 < 4 then {place} // 4 * 2 + block % 6 // 2 else {place} // 4 end as \"by\", case when block % 6 < 4 then {place} % 4 * 2 + block % 6 % 2 else {place} % 4 end as bx"
    empty = 65536 * AC_SIZES[0]
    add("x2_ac_trellis", ac, f"with recursive {', '.join([*quantized_sql, grid, zz, f'tb as (select {table} as ac)', lists, walk, plain])} select block // 96 as image, comp, {by}, coalesce(plain_cost, {empty}) as plain_cost, coalesce({end}, {empty}) as cost from grid left join pl using (block) left join (select * from st where k = 64) e using (block)")

    def sizes(s: SparkSession, d: str) -> DataFrame:
        plain, small, chosen = optimised_files(s, d, quant, deltas)
        found = DE.decode(written(E.markers(small))).withColumnRenamed("q", "found").join(chosen, KEYS)
        same = found.groupBy("image").agg(F.bool_and(F.col("valid") & (F.col("found") == F.col("q"))).alias("same"))
        return plain.selectExpr("image", "cast(octet_length(file) as bigint) as plain_bytes").join(small.selectExpr("image", "cast(octet_length(file) as bigint) as bytes"), "image").join(same, "image")

    add("x2_x4_file_sizes", sizes)
