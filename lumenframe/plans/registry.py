"""Every registered query of the image operators, with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.tables import written
from lumenframe.operators import blocks as B
from lumenframe.operators import colour as C
from lumenframe.operators import decoding as DE
from lumenframe.operators import entropy as E
from lumenframe.operators import layers as L
from lumenframe.operators import lifting as LI
from lumenframe.operators import nearlossless as NL
from lumenframe.operators import predict as P
from lumenframe.operators import raster as R
from lumenframe.operators import segments as G
from lumenframe.operators import stats as S
from lumenframe.operators import tone as T
from lumenframe.plans import codec, files, optimising
from lumenframe.sources import fixtures as X
from lumenframe.sources import pnm as N
from lumenframe.streaming import incremental as I

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "d1_fdct_quant_stats"


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _raster(name: str, of: Callable[[DataFrame], DataFrame], sql: str, *more: str) -> None:
    """A query over the raster; sql selects from raster (and further table expressions)."""
    _add(name, lambda s, d: of(X.raster(s, d)), f"with {', '.join([X.RASTER_SQL, *more])} {sql}")


def _blocks(name: str, of: Callable[[DataFrame], DataFrame], sql: str, *more: str) -> None:
    _add(name, lambda s, d: of(X.blocks(s, d)), f"with {', '.join([X.BLOCK_SQL, *more])} {sql}")


def _values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) as (values {', '.join('(' + ', '.join(map(str, r)) + ')' for r in rows)})"


def _clip(x: str, high: int = 255) -> str:
    return f"greatest(0, least({high}, {x}))"


# ---- colour
_F, _I = C.FORWARD, C.INVERSE
_y = [f"{_clip(f'(r * {a} + g * {b} + b * {c} + {o} + 256) >> 9', 4095)}" for (a, b, c), o in zip(_F, (0, 128 << 13, 128 << 13), strict=True)]
_raster("c1_rgb_to_ycbcr", C.rgb_to_ycbcr, f"select y as py, x as px, {_y[0]} as y, {_y[1]} as cb, {_y[2]} as cr from raster")
_ycc = f"ycc as (select y as py, x as px, {_y[0]} as y, {_y[1]} as cb, {_y[2]} as cr from raster)"
_rgb = ", ".join(f"{_clip(f'(y * {a} + (cb - 2048) * {b} + (cr - 2048) * {c} + 65536) >> 17')} as {n}" for (a, b, c), n in zip(_I, "rgb", strict=True))
_raster("c2_ycbcr_to_rgb", lambda px: C.ycbcr_to_rgb(C.rgb_to_ycbcr(px)), f"select py, px, {_rgb} from ycc", _ycc)
_raster("c4_identity", C.identity, "select y as py, x as px, r * 16 as r, g * 16 as g, b * 16 as b from raster")
_raster("c5_reversible", C.reversible, "select y as py, x as px, (r + 2 * g + b) >> 2 as ry, b - g as cb, r - g as cr from raster")
_raster("c5_reversible_inverse", lambda px: C.reversible_inverse(C.reversible(px)), "select y as py, x as px, r, g, b from raster")
_raster("c6_lossless_modulo", C.lossless_modulo, "select y as py, x as px, (r - g + 128 + 256) % 256 as dr, g, (b - g + 128 + 256) % 256 as db from raster")
_raster("c6_lossless_modulo_inverse", lambda px: C.lossless_modulo_inverse(C.lossless_modulo(px)), "select y as py, x as px, r, g, b from raster")
_XYZ = [[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]]
_ff = ", ".join(f"(r * {int(a * 8192 + 0.5)} + g * {int(b * 8192 + 0.5)} + b * {int(c * 8192 + 0.5)} + 4096) >> 13 as c{k}" for k, (a, b, c) in enumerate(_XYZ))
_raster("c7_freeform", lambda px: C.freeform(px, _XYZ), f"select y as py, x as px, {_ff} from raster")
_raster("c12_half_to_double", lambda px: px.selectExpr("y", "x", f"{C.half_to_double('(r * 121)')} as v", f"{C.sign_magnitude('(r * 256)')} as m"),
        "select y, x, case when (r * 121) & 1023 = 0 and (r * 121) >> 10 = 0 then 0.0 when (r * 121) >> 10 = 0 then ((r * 121) & 1023) * power(2.0, -24) else (1024 + ((r * 121) & 1023)) * power(2.0, ((r * 121) >> 10) - 25) end as v, case when r * 256 >= 32768 then -((r * 256) & 32767) - 1 else r * 256 end as m from raster")
_raster("c14_rounding", lambda px: px.selectExpr("y", "x", *[f"{C.rounded_shift(f'(r * 1000 - g * 777)', k)} as s{k}" for k in (4, 9, 13)]),
        f"select y, x, {', '.join(f'(r * 1000 - g * 777 + {1 << k >> 1}) >> {k} as s{k}' for k in (4, 9, 13))} from raster")

# ---- blocks
_m = B.matrix()
_M = _values("m", "f, i, c", [(f, i, _m[f, i]) for f in range(8) for i in range(8)])
_u = "u as (select block, m.f as f, k % 8 as x, (sum(v * c)::bigint + 256) >> 9 as u from block64 join m on m.i = k // 8 group by all)"
_t = "t as (select block, u.f * 8 + m.f as k, sum(u * c)::bigint - case when u.f * 8 + m.f = 0 then 4194304 else 0 end as c from u join m on m.i = x group by block, u.f, m.f)"
_D = B.scaled(B.LUMINANCE, 75)
_d = _values("d", "k, delta, inv", [(k, x, i) for k, (x, i) in enumerate(zip(_D, B.reciprocals(_D), strict=True))])
_q = "q as (select block, k, (c * inv + case when c > 0 then 1 else 0 end + (1::bigint << 41)) >> 42 as v from t join d using (k))"
_blocks("d1_fdct", lambda b: B.exploded(B.fdct(b), "t"), "select block, k, c as v from t", _M, _u, _t)
_quant = lambda b: B.quantized(B.fdct(b), _D)
_blocks("q4_quantize", lambda b: B.exploded(_quant(b), "q"), "select block, k, v from q", _M, _u, _t, _d, _q)
_blocks(FLAGSHIP, lambda b: B.flagship(b), "select k, count(*) filter (where v <> 0) as nonzero, sum(abs(v))::bigint as magnitude from q group by k", _M, _u, _t, _d, _q)
_dz = "q as (select block, k, case when k = 0 then (c * inv + case when c > 0 then 1 else 0 end + (1::bigint << 41)) >> 42 else (c * inv + case when c < 0 then (1::bigint << 40) - 1 else 0 end + (3::bigint << 39)) >> 42 end as v from t join d using (k))"
_blocks("q5_deadzone", lambda b: B.exploded(B.quantized(B.fdct(b), _D, deadzone=True), "q"), "select block, k, v from q", _M, _u, _t, _d, _dz)
_deq = "deq as (select block, k, v * delta as c from q join d using (k))"
_blocks("q6_dequantize", lambda b: B.exploded(B.dequantized(_quant(b), _D), "c"), "select block, k, c as v from deq", _M, _u, _t, _d, _q, _deq)
_i1 = "i1 as (select block, k // 8 as f, m.i as x, (sum(deq.c * m.c)::bigint + 256) >> 9 as u from deq join m on m.f = k % 8 group by block, k // 8, m.i)"
_i2 = f"i2 as (select block, m.i * 8 + x as k, {_clip('((sum(u * c)::bigint + 2048) >> 12) + 128')} as v from i1 join m using (f) group by block, m.i, x)"
_blocks("d2_idct", lambda b: B.exploded(B.idct(B.dequantized(_quant(b), _D)), "v"), "select block, k, v from i2", _M, _u, _t, _d, _q, _deq, _i1, _i2)
_err = "select max(abs(i2.v - block64.v))::bigint as worst, sum(abs(i2.v - block64.v))::bigint as total from i2 join block64 using (block, k)"
_add("d2_round_trip_error", lambda s, d: B.exploded(B.idct(B.dequantized(_quant(X.blocks(s, d)), _D)), "v").withColumnRenamed("v", "w").join(X.samples(s, d), ["block", "k"])
     .agg(F.max(F.abs(F.col("w") - F.col("v"))).alias("worst"), F.sum(F.abs(F.col("w") - F.col("v"))).alias("total")), f"with {', '.join([X.BLOCK_SQL, _M, _u, _t, _d, _q, _deq, _i1, _i2])} {_err}")
_blocks("d6_dct_bypass", lambda b: b.selectExpr("block", "posexplode(transform(v, x -> (x - 128) div 3)) as (k, v)"), "select block, k, case when v < 128 then -((128 - v) // 3) else (v - 128) // 3 end as v from block64")
_zz = B.zigzag()
_Z = _values("z", "place, k", enumerate(_zz))
_blocks("o1_zigzag", lambda b: b.selectExpr("block", f"posexplode(transform({B._array(_zz)}, k -> get(v, cast(k as int)))) as (place, v)"), "select block, place, v from block64 join z using (k)", _Z)
# Tables for qualities that are data: one for each part (or supplier), whose key gives the quality.
_quality = lambda s, d, t, k: X.table(s, d, t).selectExpr(f"{k} as key", f"{k} % 100 + 1 as quality")
_scale = "(t * (case when q < 50 then 5000 // q else 200 - 2 * q end) + 50) // 100"
_add("q1_quality_scaling", lambda s, d: B.scaled_rows(_quality(s, d, "part", "p_partkey"), B.LUMINANCE),
     f"with {_values('l', 'k, t', enumerate(B.LUMINANCE))} select p_partkey as key, k, least(255, greatest(1, {_scale})) as delta from l, (select p_partkey, p_partkey % 100 + 1 as q from part)")
_add("q4_reciprocals", lambda s, d: X.table(s, d, "part").selectExpr("p_partkey % 255 + 1 as delta").distinct().selectExpr("delta", "cast(floor(cast(cast(1073741824D / delta as float) as double) + 0.5D) as bigint) as inv"),
     "select distinct d as delta, cast(floor(cast(cast(1073741824 as float) / cast(d as float) as double) + 0.5) as bigint) as inv from (select p_partkey % 255 + 1 as d from part)")
_blocks("q7_hidden_bits", lambda b: b.selectExpr("block", "posexplode(v) as (k, v)").selectExpr("block", "k", "shiftright(v, 2) as high", "v & 3L as low"), "select block, k, v >> 2 as high, v & 3 as low from block64")
_blocks("q8_point_transform", lambda b: B.exploded(_quant(b), "q").selectExpr("block", "k", "if(k = 0, shiftright(v, 1), v div 2) as v"),
        "select block, k, case when k = 0 then v >> 1 when v < 0 then -((-v) // 2) else v // 2 end as v from q", _M, _u, _t, _d, _q)
_blocks("f6_spectral_selection", lambda b: B.exploded(_quant(b), "q").where(F.col("k").isin(_zz[1:6])), f"select block, k, v from q where k in ({', '.join(map(str, _zz[1:6]))})", _M, _u, _t, _d, _q)
_blocks("j9_refinement", lambda b: (lambda q: L.refined(q.selectExpr("block", "k", "v < 0 as neg", "shiftright(abs(v), 1) as v"), q.selectExpr("block", "k", "abs(v) & 1L as low"), 1))(B.exploded(_quant(b), "q")),
        "select block, k, v from q", _M, _u, _t, _d, _q)
_blocks("j10_table_lookup", lambda b: B.exploded(b, "v").join(F.broadcast(b.sparkSession.range(64).selectExpr("id as k", f"get({B._array(_D)}, cast(id as int)) as delta")), "k").select("block", "k", (F.col("v") * F.col("delta")).alias("v")),
        "select block, k, v * delta as v from block64 join d using (k)", _d)

# ---- statistics
_cat = lambda v: f"case when {v} = 0 then 0 else length(bin(abs({v}))) end"
_segs = lambda s, d: G.numbered(B.exploded(_quant(X.blocks(s, d)), "q").where("k = 0").selectExpr("block as mcu", "v as dc"), 8)
_SEG = [X.BLOCK_SQL, _M, _u, _t, _d, _q, "seg as (select block // 8 as seg, block as mcu, v as dc from q where k = 0)"]
_diff = "diff as (select seg, mcu, dc - coalesce(lag(dc) over (partition by seg order by mcu), 0) as diff from seg)"
_add("w1_dpcm", lambda s, d: P.dpcm(_segs(s, d)), f"with {', '.join([*_SEG, _diff])} select * from diff")
_add("w1_dpcm_inverse", lambda s, d: P.dpcm_inverse(P.dpcm(_segs(s, d))), f"with {', '.join(_SEG)} select * from seg")
_add("g1_dc_histogram", lambda s, d: S.dc_histogram(P.dpcm(_segs(s, d))), f"with {', '.join([*_SEG, _diff])} select {_cat('diff')} as symbol, count(*) as n from diff group by 1")
_nz = "nz as (select block, place, v, place - coalesce(lag(place) over (partition by block order by place), 0) - 1 as run from q join z using (k) where v <> 0 and place > 0)"
_sym = f"sym as (select block, (run % 16) * 16 + {_cat('v')} as symbol from nz union all select block, 240 from nz, range(0, run // 16) union all select block, 0 from (select block, max(case when v <> 0 then place else 0 end) as last from q join z using (k) group by block) where last < 63)"
_add("g1_ac_symbol_histogram", lambda s, d: S.ac_symbols(_quant(X.blocks(s, d)), _zz).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")),
     f"with {', '.join([*_SEG[:-1], _Z, _nz, _sym])} select symbol::bigint as symbol, count(*) as n from sym group by 1")
_raster("g3_predictive_histogram", lambda px: P.residuals(px, 4).groupBy(F.expr(f"cast({S.category('e')} as bigint)").alias("symbol")).agg(F.count(F.lit(1)).alias("n")),
        f"select {_cat('e')} as symbol, count(*) as n from e4 group by 1", "nb as (select y, x, r as v, lag(r) over (partition by y order by x) as a, lag(r) over (partition by x order by y) as b, lag(r) over (partition by x - y order by y) as c from raster)",
        "e4 as (select case when x = 0 and y = 0 then v - 128 when y = 0 then v - a when x = 0 then v - b else v - (a + b - c) end as e from nb)")


def _sized(p):
    """Code sizes of a table of at most 17 symbols."""
    sizes = S.code_sizes(dict(zip(p["symbol"].tolist(), p["n"].tolist(), strict=True)))
    return p[["symbol"]].assign(size=[sizes[x] for x in p["symbol"].tolist()])


def _code_table(s: SparkSession, d: str) -> DataFrame:
    return S.dc_histogram(P.dpcm(_segs(s, d))).withColumn("tc", F.lit(0)).groupBy("tc").applyInPandas(_sized, "symbol bigint, size bigint")


_add("g4_code_sizes", _code_table)
_add("g5_canonical_codes", lambda s, d: S.canonical(X.table(s, d, "nation").selectExpr("cast(n_nationkey as bigint) as symbol", "case when n_nationkey < 3 then 3L when n_nationkey < 20 then 5L else 7L end as size")),
     "with s as (select n_nationkey::bigint as symbol, case when n_nationkey < 3 then 3 when n_nationkey < 20 then 5 else 7 end as size from nation) select symbol, size, coalesce(sum(1::bigint << (16 - size)) over (order by size, symbol rows between unbounded preceding and 1 preceding), 0)::bigint >> (16 - size) as code from s")
_add("g10_checksum", lambda s, d: S.checksum(X.text_bytes(s, d), "doc_id", "data"),
     "with b as (select doc_id, octet_length(encode(coalesce(text, ''))) as n, unnest(regexp_extract_all(hex(encode(coalesce(text, ''))), '..')) as h, generate_subscripts(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), 1) as i from documents), w as (select doc_id, sum(('0x' || h)::bigint) as s1, sum(('0x' || h)::bigint * (n - i + 1)) as s2 from b group by doc_id) select doc_id, (coalesce(s1, 0) % 255 + coalesce(s2, 0) % 255 * 256)::bigint as checksum from documents left join w using (doc_id)")
_add("g11_checksum_verified", lambda s, d: S.checksum(X.text_bytes(s, d), "doc_id", "data").join(S.checksum(G.reassembled(G.split(X.text_bytes(s, d), "doc_id", 1000), "doc_id"), "doc_id", "data").withColumnRenamed("checksum", "found"), "doc_id").select("doc_id", (F.col("checksum") == F.col("found")).alias("ok")),
     "select doc_id, true as ok from documents")
_var = "cell as (select block, k // 16 as cy, k % 8 // 2 as cx, (sum(v)::bigint + 2) >> 2 as m from block64 group by all), vv as (select block, cy, cx, (sum((v - m) * (v - m))::bigint + 2) >> 2 as var from block64 join cell on cell.block = block64.block and cy = k // 16 and cx = k % 8 // 2 group by all)"
_blocks("g12_variance_masking", lambda b: S.masked(b, 400), "select block, count(*) filter (where var > 400) as cells, count(*) filter (where var > 400) > 11 as all_masked from vv group by block", _var.replace("select block, cy, cx, (sum((v", "select cell.block as block, cy, cx, (sum((v"))
_blocks("g13_extremes", S.extremes, "select block, sum(v)::bigint as total, count(*) filter (where v = 0) as low, count(*) filter (where v = 255) as high from block64 group by block")
_add("g14_mcu_size", lambda s, d: R.mcu_sizes(X.table(s, d, "part").selectExpr("p_partkey", "p_size % 4 + 1L as a", "p_partkey % 4 + 1 as b", "p_partkey % 3 + 1 as c"), [("a", "b"), ("b", "c"), ("1", "2")], "p_partkey"),
     "select p_partkey, lcm(p_size % 4 + 1, p_partkey % 4 + 1)::bigint as w, lcm(lcm(p_partkey % 4 + 1, p_partkey % 3 + 1), 2)::bigint as h from part")

# ---- prediction
_NB = "nb as (select y, x, r as v, lag(r) over (partition by y order by x) as a, lag(r) over (partition by x order by y) as b, lag(r) over (partition by x - y order by y) as c, lag(r) over (partition by x + y order by y) as d, lag(r, 2) over (partition by x order by y) as e from raster)"
_rule = {1: "a", 2: "b", 3: "c", 4: "a + b - c", 5: "a + ((b - c) >> 1)", 6: "b + ((a - c) >> 1)", 7: "(a + b) >> 1"}
for _mode, _p in _rule.items():
    _raster(f"w2_predictor_{_mode}", lambda px, k=_mode: P.residuals(px, k), f"select y, x, v - (case when x = 0 and y = 0 then 128 when y = 0 then a when x = 0 then b else {_p} end) as e from nb", _NB)
_raster("w2_predictor_1_inverse", lambda px: P.restored_left(P.residuals(px, 1)), "select y, x, r as v from raster")
for _mode, _back in ((2, P.restored_top), (3, P.restored_corner), (4, P.restored_linear)):
    _raster(f"w2_predictor_{_mode}_inverse", lambda px, k=_mode, f=_back: f(P.residuals(px, k)), "select y, x, r as v from raster")
_raster("w5_point_shift", lambda px: P.residuals(px, 2, shift=2), "select y, x, v - (case when x = 0 and y = 0 then 32 when y = 0 then a when x = 0 then b else b end) as e from nb",
        "nb as (select y, x, r >> 2 as v, lag(r >> 2) over (partition by y order by x) as a, lag(r >> 2) over (partition by x order by y) as b from raster)")
_raster("w4_wrap", lambda px: px.selectExpr("y", "x", f"{C.rounded_shift('0L', 0)} as z", f"{P.signed16('r * 700 - g * 500')} as w"), "select y, x, 0 as z, ((r * 700 - g * 500 + 32768) & 65535) - 32768 as w from raster")
_t1, _t2, _t3 = P.thresholds(8)
_qg = lambda g: f"case when {g} <= -{_t3} then -4 when {g} <= -{_t2} then -3 when {g} <= -{_t1} then -2 when {g} < 0 then -1 when {g} <= 0 then 0 when {g} < {_t1} then 1 when {g} < {_t2} then 2 when {g} < {_t3} then 3 else 4 end"
_ls = f"ls as (select y, x, case when c >= greatest(a, b) then least(a, b) when c <= least(a, b) then greatest(a, b) else a + b - c end as p, {_qg('(d - b)')} as q1, {_qg('(b - c)')} as q2, {_qg('(c - a)')} as q3 from (select y, x, coalesce(a, b, 0) as a, coalesce(b, 0) as b, coalesce(c, case when x = 0 then e end, 0) as c, coalesce(d, b, 0) as d from nb))"
_neg = "(q1 < 0 or (q1 = 0 and q2 < 0) or (q1 = 0 and q2 = 0 and q3 < 0))"
_raster("w6_w9_contexts", P.contexts, f"select y, x, p, case when {_neg} then -q1 * 81 + (-q2 + 4) * 9 - q3 + 4 + 2 else q1 * 81 + (q2 + 4) * 9 + q3 + 4 + 2 end as ctx, {_neg} as negative, q1 = 0 and q2 = 0 and q3 = 0 as run from ls", _NB, _ls)

# ---- regions, order and layout
_raster("f1_region", lambda px: R.region(px, 10, 5, 40, 30, "rb"), "select y, x, r, b from raster where y between 5 and 30 and x between 10 and 40")
_raster("f2_block_inside", lambda px: R.block_inside(px, 8, 8, 50, 60), "select distinct y // 8 as by, x // 8 as bx, x // 8 * 8 >= 8 and x // 8 * 8 + 7 <= 50 and y // 8 * 8 >= 8 and y // 8 * 8 + 7 <= 60 as inside from raster")
_sub = R.subsampled_region(11, 7, 40, 33, 2, 2)
_raster("f3_subsampled_region", lambda px: R.downsampled(px, 2, 2).where(F.col("x").between(_sub[0], _sub[2]) & F.col("y").between(_sub[1], _sub[3])),
        "select y // 2 as y, x // 2 as x, sum(r * w)::bigint // (count(distinct y) * 2) as v from (select *, case when x = max(x) over (partition by y) then 2 - x % 2 else 1 end as w from raster) where x // 2 between 5 and 20 and y // 2 between 3 and 16 group by 1, 2")
_raster("f4_strided_view", lambda px: R.every(px, 4, 2, 1, 1), "select y // 2 as y, x // 4 as x, r, g, b from raster where x % 4 = 1 and y % 2 = 1")
_raster("f7_clip_and_wrap", lambda px: R.clipped(px, 16, 235, 8), "select y, x, greatest(16, least(235, r * 3 - 200)) as clip, (r * 3 - 200) & 255 as wrap from raster")
_b = "bl as (select distinct y // 8 as by, x // 8 as bx from raster)"
_raster("j1_mcu_interleave", lambda px: R.mcu_order(px, 4),
        'select 0 as comp, "by", bx, "by" // 2 * 4 + bx // 2 as mcu, "by" % 2 * 2 + bx % 2 as place from bl union all select c, "by", bx, "by" * 4 + bx, 3 + c from (select distinct "by" // 2 as "by", bx // 2 as bx from bl), range(1, 3) t(c)', _b)
_raster("j2_recombine", lambda px: L.recombined(px.selectExpr("y", "x", "stack(3, 0, r, 1, g, 2, b) as (comp, v)")), "select y, x, r as c0, g as c1, b as c2 from raster")
_raster("o2_early_stop", lambda px: G.decoded_until(px.selectExpr("y * 64 + x as mcu", "r as dc"), 999), "select y * 64 + x as mcu, r as dc from raster where y * 64 + x <= 999")
_raster("o3_priority_order", lambda px: px.selectExpr("y div 8 as by", "x div 8 as bx").distinct().selectExpr("by", "bx", "row_number() over (partition by by order by (bx * 5) % 8, bx) as turn"),
        'select "by", bx, row_number() over (partition by "by" order by (bx * 5) % 8, bx) as turn from bl', _b)
_script = [(k, c, a, b, ah, al) for k, (cs, a, b, ah, al) in enumerate(G.default_script()) for c in cs]
_add("o4_progressive_script", lambda s, d: X.table(s, d, "embeddings").selectExpr("vec_id div 64 as image", "vec_id % 3 as comp").distinct().join(F.broadcast(s.createDataFrame(_script, "scan bigint, comp bigint, ss bigint, se bigint, ah bigint, al bigint")), "comp").select("image", "scan", "comp", "ss", "se", "ah", "al"),
     f"with {_values('t', 'scan, comp, ss, se, ah, al', _script)}, c as (select distinct vec_id // 64 as image, vec_id % 3 as comp from embeddings) select image, scan, comp, ss, se, ah, al from c join t using (comp)")

# ---- resampling
for _sx, _sy in ((2, 1), (2, 2), (3, 3), (4, 4), (1, 2)):
    _raster(f"r1_downsample_{_sx}x{_sy}", lambda px, a=_sx, b=_sy: R.downsampled(px, a, b),
            f"select y // {_sy} as y, x // {_sx} as x, sum(r * w)::bigint // (count(distinct y) * {_sx}) as v from (select *, case when x = max(x) over (partition by y) then {_sx} - x % {_sx} else 1 end as w from raster) group by 1, 2")
_up = "up as (select x, y, r as c, coalesce(lag(r) over (partition by x order by y), r) as t, coalesce(lead(r) over (partition by x order by y), r) as b from raster)"
_across = "up as (select x, y, r as c, coalesce(lag(r) over (partition by y order by x), r) as l, coalesce(lead(r) over (partition by y order by x), r) as r from raster)"
_V = {2: ["(t + 3 * c + 2 - x % 2) >> 2", "(b + 3 * c + 1 + x % 2) >> 2"], 3: ["(t + 3 * c + 2 - x % 2) >> 2", "c", "(b + 3 * c + 1 + x % 2) >> 2"],
      4: ["(3 * t + 5 * c + 4 - x % 2) >> 3", "(t + 7 * c + 3 + x % 2) >> 3", "(b + 7 * c + 4 - x % 2) >> 3", "(3 * b + 5 * c + 3 + x % 2) >> 3"]}
_H = {2: ["(l + 3 * c + 2) >> 2", "(r + 3 * c + 1) >> 2"], 3: ["(l + 3 * c + 2) >> 2", "c", "(r + 3 * c + 1) >> 2"], 4: ["(3 * l + 5 * c + 2) >> 3", "(l + 7 * c + 1) >> 3", "(r + 7 * c + 2) >> 3", "(3 * r + 5 * c + 1) >> 3"]}
for _n in (2, 3, 4):
    _raster(f"r3_upsample_rows_{_n}", lambda px, n=_n: R.upsampled_rows(px, n), " union all ".join(f"select y * {_n} + {k} as y, x, {e} as v from up" for k, e in enumerate(_V[_n])), _up)
    _raster(f"r4_upsample_columns_{_n}", lambda px, n=_n: R.upsampled_columns(px, n), " union all ".join(f"select y, x * {_n} + {k} as x, {e} as v from up" for k, e in enumerate(_H[_n])), _across)

# ---- layers
_base = "base as (select y, x, r // 16 * 16 + 8 as base from raster)"
_raster("j4_residual", lambda px: L.residual(px, L.base_layer(px)), "select y, x, r - base + 256 as res from raster join base using (y, x)", _base)
_raster("j3_merge", lambda px: L.merged(L.base_layer(px), L.residual(px, L.base_layer(px))), "select y, x, r as v from raster")
_raster("j5_alpha", lambda px: L.with_alpha(px, px.where("x < 32").selectExpr("y", "x", "b as alpha")), "select y, x, r, case when x < 32 then b else 255 end as alpha from raster")
_low = "low as (select y // 2 as y, x // 2 as x, sum(r)::bigint // count(*) as low from raster group by 1, 2)"
_raster("j8_differential", lambda px: L.differential(px, L.reduced(px)), "select raster.y, raster.x, r - low + 256 as diff from raster join low on low.y = raster.y // 2 and low.x = raster.x // 2", _low)
_raster("j7_hierarchical_merge", lambda px: (lambda low: L.from_differential(L.differential(px, low), low))(L.reduced(px)), "select y, x, r as v from raster")
_raster("r8_reduce", L.reduced, "select * from low", _low)
_raster("w14_cell_means", lambda px: px.groupBy(F.expr("y div 2").alias("cy"), F.expr("x div 2").alias("cx")).agg(F.expr("shiftright(sum(r) + 2, 2)").alias("mean")),
        "select y // 2 as cy, x // 2 as cx, (sum(r)::bigint + 2) >> 2 as mean from raster group by 1, 2")

# ---- tone
_raster("g6_luma_statistics", T.luma_statistics, "select count(*) as n, round(avg(luma), 6) as mean, round(avg(ln(luma)), 6) as log_mean, round(min(luma), 6) as low, round(max(luma), 6) as high from raster where luma > 0")
_raster("g7_joint_histogram", T.joint_histogram, "select r as ldr, cast(floor(luma) as bigint) as hdr, count(*) as n from raster group by 1, 2")
_raster("g8_component_histogram", T.component_histogram, " union all ".join(f"select {k} as comp, {c} as ldr, cast(floor(luma) as bigint) as hdr, count(*) as n from raster group by all" for k, c in enumerate("rgb")))
_raster("g9_inverse_table", T.inverse_table, "select r as ldr, cast(floor(avg(floor(luma)) + 0.5) as bigint) as w from raster group by 1")
_CURVES = [("identity", ()), ("gamma", T.SRGB[1]), ("linear", (0.25, 0.75)), ("exponential", (0.5, 1.5, 2.0, -1.0)), ("logarithmic", (2.0, 1.0, 1.0, 0.0)), ("gamma_offset", (0.1, 0.9, 0.5))]
_sqlish = lambda e: __import__("re").sub(r"(?<=[\d.])D\b", "::double", e)
_v = "(id / 255.0D)"
_raster("t1_curves", lambda px: px.where("r > 0").selectExpr("y", "x", "r as id").selectExpr("y", "x", *[f"round({T.curve(k, _v, p)}, 9) as c{i}" for i, (k, p) in enumerate(_CURVES)]),
        f"select y, x, {', '.join(f'round({_sqlish(T.curve(k, _v, p))}, 9) as c{i}' for i, (k, p) in enumerate(_CURVES))} from (select y, x, r as id from raster where r > 0)")
_raster("t2_inverse_curves", lambda px: px.where("r > 0").selectExpr("y", "x", "r as id").selectExpr("y", "x", *[f"round({T.inverse_curve(k, f'({T.curve(k, _v, p)})', p)}, 9) as c{i}" for i, (k, p) in enumerate(_CURVES)]),
        f"select y, x, {', '.join(f'round(r / 255.0::double, 9) as c{i}' for i in range(len(_CURVES)))} from raster where r > 0")
_raster("t3_curve_table", lambda px: T.curve_table(px, "r", *T.SRGB),
        f"select id as i, cast(floor(({_sqlish(T.curve(*T.SRGB[:1], _v, T.SRGB[1]))}) * 65535 + 0.5) as bigint) as w, coalesce(n, 0) as n from range(0, 256) t(id) left join (select r, count(*) as n from raster group by r) h on h.r = t.id")
_raster("t4_apply_curve", lambda px: px.join(F.broadcast(T.lut(px.sparkSession, *T.SRGB)), px.r == F.col("i")).selectExpr("y", "x", "w as v"),
        f"select y, x, cast(floor(({_sqlish(T.curve('gamma', '(r / 255.0D)', T.SRGB[1]))}) * 65535 + 0.5) as bigint) as v from raster")
_raster("t9_reinhard", T.reinhard, "select y, x, cast(floor(255 * (0.18 * luma / k) / (1 + 0.18 * luma / k) + 0.5) as bigint) as v from raster, (select exp(avg(ln(luma))) as k from raster where luma > 0)")

# ---- segments and container
_add("st5_restart_segments", _segs, f"with {', '.join(_SEG)} select mcu, dc, seg, seg % 8 as rst from seg")
_add("st4_missing_segment", lambda s, d: (lambda g: G.resynchronised(g.where("seg <> 3").select("seg", "mcu", "dc"), g.select("seg", "mcu")))(_segs(s, d)), f"with {', '.join(_SEG)} select seg, mcu, case when seg = 3 then 0 else dc end as dc, seg <> 3 as valid from seg")
_raster("st3_marker_distance", lambda px: px.selectExpr("y", "x", f"{G.marker_distance('r % 8', 'g % 8')} as distance"),
        "select y, x, case when (r % 8 - g % 8 + 8) % 8 <= 3 then (r % 8 - g % 8 + 8) % 8 else (r % 8 - g % 8 + 8) % 8 - 8 end as distance from raster")
_st = "placed as (select doc_id, i + coalesce(sum(case when byte = 255 then 1 else 0 end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as place, byte from stuff)"
_add("e16_byte_stuffing", lambda s, d: G.stuffed(X.stuffing_bytes(s, d), "doc_id"), f"with {X.STUFF_SQL}, {_st} select doc_id, place, byte from placed union all select doc_id, place + 1, 0 from placed where byte = 255")
_add("e16_byte_unstuffing", lambda s, d: G.unstuffed(G.stuffed(X.stuffing_bytes(s, d), "doc_id"), "doc_id"), f"with {X.STUFF_SQL} select doc_id, i, byte from stuff")
_add("io23_box_split", lambda s, d: G.split(X.text_bytes(s, d), "doc_id", 1000).select("doc_id", F.col("seq").cast("bigint").alias("seq"), F.octet_length("payload").cast("bigint").alias("n"), F.md5("payload").alias("md5")),
     "select doc_id, seq, least(1000, octet_length(encode(coalesce(text, ''))) - seq * 1000) as n, md5(encode(coalesce(text, ''))[seq * 1000 + 1 : seq * 1000 + 1000]) as md5 from documents, range(0, greatest(octet_length(encode(coalesce(text, ''))) - 1, 0) // 1000 + 1) t(seq)")
_add("io22_box_reassembly", lambda s, d: G.reassembled(G.split(X.text_bytes(s, d), "doc_id", 1000).repartition("doc_id", "seq"), "doc_id").select("doc_id", "n", F.md5("data").alias("md5")),
     "select doc_id, greatest(octet_length(encode(coalesce(text, ''))) - 1, 0) // 1000 + 1 as n, md5(coalesce(text, '')) as md5 from documents")

# ---- files and entropy coding (images of 64 blocks, 8 in a row, a restart segment for each row)
_coded = lambda s, d: E.encode(_quant(X.blocks(s, d)).selectExpr("block div 64 as image", "block % 64 div 8 as seg", "block % 64 as mcu", "q"))
_files = lambda s, d: E.files(_coded(s, d), _D, 8, 8)
_found = lambda s, d: DE.decode(written(E.markers(_files(s, d)))).selectExpr("image * 64 + `by` * 8 + bx as block", "q")
_add("e1_huffman_round_trip", lambda s, d: B.exploded(_found(s, d), "q").join(X.table(s, d, "embeddings").selectExpr("vec_id as block"), "block"), f"with {', '.join(_SEG[:-1])} select block, k, v from q")
_add("e2_file_to_samples", lambda s, d: B.exploded(B.idct(B.dequantized(_found(s, d), _D)), "v").join(X.table(s, d, "embeddings").selectExpr("vec_id as block"), "block"), f"with {', '.join([X.BLOCK_SQL, _M, _u, _t, _d, _q, _deq, _i1, _i2])} select block, k, v from i2")
_add("io13_marker_segments", lambda s, d: E.markers(_files(s, d)).groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "marker"))), lambda x: F.hex(x["marker"])), " ").alias("markers")),
     "select vec_id // 64 as image, 'D8 DB C0 C4 C4 DD DA 0' || coalesce(string_agg(' D' || ((vec_id % 64 // 8 - 1) % 8), '' order by vec_id) filter (where vec_id % 8 = 0 and vec_id % 64 > 0), '') || ' D9' as markers from embeddings group by 1")
_add("io14_frame_information", lambda s, d: E.information(E.markers(_files(s, d))), "select vec_id // 64 as image, least(8, count(*)) * 8 as width, (count(*) + 7) // 8 * 8 as height, 8 as precision, 1 as components from embeddings group by 1")
_add("e1_coded_size", lambda s, d: _coded(s, d).groupBy("image").agg(F.sum(F.octet_length("data")).alias("bytes")))
_add("io1_pnm_round_trip", lambda s, d: N.read(N.written(X.raster(s, d).join(X.raster(s, d).groupBy("y").agg(F.count(F.lit(1)).alias("n")).where("n = 64"), "y"))),
     f"with {X.RASTER_SQL} select y, x, r, g, b from raster where y in (select y from raster group by y having count(*) = 64)")
_add("st1_incremental_segments", lambda s, d: I.run_available(s, f"{d}/embeddings.parquet*", 8), "select vec_id // 8 as seg, count(*) as n, count(*) = 8 as complete from embeddings group by 1")
_full = lambda s, d: X.raster(s, d).join(X.raster(s, d).groupBy("y").agg(F.count(F.lit(1)).alias("n")).where("n = 64"), "y")
_FULL_SQL = f"with {X.RASTER_SQL}, fl as (select * from raster where y in (select y from raster group by y having count(*) = 64))"
_add("e11_ls_lossless_round_trip", lambda s, d: NL.round_trip(_full(s, d)).select("y", "x", "v"), f"{_FULL_SQL} select y, x, r as v from fl")
_add("e11_ls_near_lossless_error", lambda s, d: NL.round_trip(_full(s, d), near=3).join(X.raster(s, d), ["y", "x"]).agg(F.count(F.lit(1)).alias("n"), (F.max(F.abs(F.col("v") - F.col("r"))) <= 3).alias("bounded")),
     f"{_FULL_SQL} select count(*) as n, true as bounded from fl")
for _name, _by in (("line", False), ("sample", True)):
    _add(f"e13_{_name}_interleaved", lambda s, d, k=_by: NL.round_trip_together(_full(s, d), k), f"{_FULL_SQL} select y, x, r, g, b from fl")
    _add(f"e13_{_name}_interleaved_error", lambda s, d, k=_by: NL.round_trip_together(_full(s, d), k, near=2).join(X.raster(s, d).selectExpr("y", "x", "r as r0", "g as g0", "b as b0"), ["y", "x"]).selectExpr("y", "greatest(abs(r - r0), abs(g - g0), abs(b - b0)) as e").groupBy("y").agg((F.max("e") <= 2).alias("bounded")),
         f"{_FULL_SQL} select y, true as bounded from fl group by y")
_defaults = [(b, n, *P.thresholds(b, n)) for b in range(8, 13) for n in (0, 2)]
_raster("w13_default_thresholds", lambda px: px.selectExpr("y", "x", "8 + r % 5 as bits", "2 * (g % 2) as near").join(F.broadcast(px.sparkSession.createDataFrame(_defaults, "bits bigint, near bigint, t1 bigint, t2 bigint, t3 bigint")), ["bits", "near"]),
        "select y, x, bits, near, f + 2 + 3 * near as t1, 4 * f + 3 + 5 * near as t2, 17 * f + 4 + 7 * near as t3 from (select y, x, 8 + r % 5 as bits, 2 * (g % 2) as near, (least((1 << (8 + r % 5)::int) - 1, 4095) + 128) >> 8 as f from raster)")
_hh = "hh as (select y, x // 2 as x, (coalesce(l, c0) + 3 * c0 + 3 * coalesce(c1, c0) + coalesce(r2, c1, c0) + 2) >> 2 as h from (select y, x, r as c0, lead(r) over w as c1, lag(r) over w as l, lead(r, 2) over w as r2 from raster window w as (partition by y order by x)) where x % 2 = 0)"
_vv = "vv as (select y, x, h, lag(h) over w as a, lead(h) over w as n, lead(h, 2) over w as b from hh window w as (partition by x order by y))"
_raster("r2_smoothed_half", R.smoothed_half, "select y // 2 as y, x, (2 * (h + coalesce(n, h)) + (coalesce(a, h) + h) + (coalesce(n, h) + coalesce(b, n, h))) // 16 as v from vv where y % 2 = 0", _hh, _vv)
_raster("c11_four_components", lambda px: C.four_components(px.withColumn("k", F.expr("(r + b) % 256"))), f"select y as py, x as px, {_y[0]} as y, {_y[1]} as cb, {_y[2]} as cr, (r + b) % 256 * 16 as k from raster")
_raster("c8_inverse_matrix", lambda px: C.freeform(px, [[round(c, 4) for c in row] for row in C.inverted([[2, 0, 0], [0, 4, 0], [1, 0, 1]])]),
        "select y as py, x as px, (r * 4096 + 4096) >> 13 as c0, (g * 2048 + 4096) >> 13 as c1, (r * -4096 + b * 8192 + 4096) >> 13 as c2 from raster")
_add("io25_brands", lambda s, d: G.brands(X.table(s, d, "documents").selectExpr("doc_id", "cast(concat('jpx ', lang, '  ', 'abcd') as binary) as data"), "en  "),
     "select doc_id, 'jpx ' as brand, coalesce(lang = 'en', false) as compatible from documents")
_add("q3_residual_scale", lambda s, d: B.scaled_rows(_quality(s, d, "supplier", "s_suppkey"), B.LUMINANCE, residual_double=True),
     f"with {_values('l', 'k, t', enumerate(B.LUMINANCE))} select s_suppkey as key, k, 2 * least(255, greatest(1, {_scale})) as delta from l, (select s_suppkey, s_suppkey % 100 + 1 as q from supplier)")
_add("o5_sequential_script", lambda s, d: X.table(s, d, "part").selectExpr("p_partkey as image", "explode(sequence(0L, cast(p_size as bigint) % 12)) as comp").selectExpr("image", "comp div 4 as scan", "comp"),
     "select p_partkey as image, c // 4 as scan, c as comp from part, range(0, 12) t(c) where c <= p_size % 12")
_add("d3_lifting_transform", lambda s, d: B.exploded(LI.transformed(X.blocks(s, d)), "c"))
_blocks("d4_lifting_round_trip", lambda b: B.exploded(LI.restored(LI.transformed(b)), "v"), "select block, k, v from block64")
codec.register(_add, _raster, _quant, _D, [X.BLOCK_SQL, _M, _u, _t, _d, _q])
optimising.register(_add, _quant, _D, [X.BLOCK_SQL, _M, _u, _t, _d, _q])
files.register(_add, _quant, _D, [X.BLOCK_SQL, _M, _u, _t, _d, _q], [X.BLOCK_SQL, _M, _u, _t, _d, _q, _deq, _i1, _i2], _rgb)


def _quantized_sql(table: str, prefix: str) -> list[str]:
    """Expressions that end in <prefix>q (block, k, v): quantized coefficients of a table (block, k, v) of samples."""
    return [
        f"{prefix}u as (select block, m.f as f, k % 8 as x, (sum(v * c)::bigint + 256) >> 9 as u from {table} join m on m.i = k // 8 group by all)",
        f"{prefix}t as (select block, u.f * 8 + m.f as k, sum(u * c)::bigint - case when u.f * 8 + m.f = 0 then 4194304 else 0 end as c from {prefix}u u join m on m.i = x group by block, u.f, m.f)",
        f"{prefix}q as (select block, k, (c * inv + case when c > 0 then 1 else 0 end + (1::bigint << 41)) >> 42 as v from {prefix}t join d using (k))",
    ]


codec.register_tone(_add, _raster, _blocks, _D, [X.BLOCK_SQL, _M, _u, _t, _d, _q], _quantized_sql)
