"""Tone statistics and parametric curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def luma_statistics(px: DataFrame) -> DataFrame:
    """n, mean, log_mean, low, high of positive luma, rounded to 6 places."""
    p = px.where("luma > 0")
    return p.agg(F.count(F.lit(1)).alias("n"), *[F.round(e, 6).alias(k) for k, e in (("mean", F.avg("luma")), ("log_mean", F.avg(F.log("luma"))), ("low", F.min("luma")), ("high", F.max("luma")))])


def curve(kind: str, v: str, p: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0)) -> str:
    """The value of a parametric curve at v."""
    a, b, c, d = (*p, 0.0, 0.0, 0.0, 0.0)[:4]
    return {
        "zero": "0D", "constant": "1D", "identity": v,
        "gamma": f"case when {v} >= {a}D then pow(({v} + {c}D) / {1 + c}D, {b}D) else {((a + c) / (1 + c)) ** b}D * {v} / {a or 1.0}D end",
        "linear": f"{v} * {b - a}D + {a}D",
        "exponential": f"{c}D * exp({v} * {b - a}D + {a}D) + {d}D",
        "logarithmic": f"case when {v} > 0 then {'' if a > 0 else '-'}ln(pow({abs(a)}D * {v}, {b}D) + {c}D) + {d}D end",
        "gamma_offset": f"case when {v} > 0 then {b - a}D * pow({v}, {c}D) + {a}D else {a}D end",
    }[kind]


def inverse_curve(kind: str, v: str, p: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0)) -> str:
    """Where the curve has the value v; kinds without an inverse raise."""
    a, b, c, d = (*p, 0.0, 0.0, 0.0, 0.0)[:4]
    if kind in ("zero", "constant") or kind in ("linear", "exponential") and b <= a:
        raise ValueError(f"a {kind} curve with these parameters has no inverse")
    knee = ((a + c) / (1 + c)) ** b if kind == "gamma" else 0.0
    return {
        "identity": v,
        "gamma": f"case when {v} > {knee}D then pow({v}, {1 / (b or 1)}D) * {1 + c}D - {c}D else {v} * {a}D / {knee or 1.0}D end",
        "linear": f"({v} - {a}D) / {(b - a) or 1}D",
        "exponential": f"(ln(({v} - {d}D) / {c or 1}D) - {a}D) / {(b - a) or 1}D",
        "logarithmic": f"pow(exp({v} - {d}D) - {c}D, {1 / (b or 1)}D) / {a or 1}D" if a > 0 else f"-pow(exp({d}D - {v}) - {c}D, {1 / (b or 1)}D) / {a or 1}D",
        "gamma_offset": f"case when {v} > {a}D then pow(({v} - {a}D) / {(b - a) or 1}D, {1 / (c or 1)}D) else 0D end",
    }[kind]


SRGB = ("gamma", (0.04045, 2.4, 0.055))


def curve_table(px: DataFrame, column: str, kind: str, p: tuple[float, ...], size: int = 256, high: int = 65535) -> DataFrame:
    """i, w, n: the whole curve as an integer table, and how many of the samples in a column are at each level."""
    counts = px.groupBy(F.col(column).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    return lut(px.sparkSession, kind, p, size, high).join(counts, "i", "left").select("i", "w", F.coalesce("n", F.lit(0)).alias("n"))


def lut(spark, kind: str, p: tuple[float, ...], size: int = 256, high: int = 65535) -> DataFrame:
    """i, w: the curve as an integer table."""
    return spark.range(size).selectExpr("id as i", f"cast(floor({curve(kind, f'(id / {size - 1}D)', p)} * {high}D + 0.5D) as bigint) as w")


def reinhard(px: DataFrame) -> DataFrame:
    """y, x, v: the global operator: luma scaled by its log mean, compressed to 0..255. One aggregation, then a projection."""
    key = px.where("luma > 0").agg(F.exp(F.avg(F.log("luma"))).alias("key")).first().key or 1.0
    w = f"0.18D * luma / {key!r}D"
    return px.selectExpr("y", "x", f"cast(floor(255D * ({w}) / (1D + {w}) + 0.5D) as bigint) as v")


def joint_histogram(px: DataFrame) -> DataFrame:
    """ldr, hdr, n."""
    return px.groupBy(F.col("r").alias("ldr"), F.expr("cast(floor(luma) as bigint)").alias("hdr")).agg(F.count(F.lit(1)).alias("n"))


def component_histogram(px: DataFrame) -> DataFrame:
    """comp, ldr, hdr, n."""
    return px.selectExpr("stack(3, 0, r, 1, g, 2, b) as (comp, ldr)", "cast(floor(luma) as bigint) as hdr").groupBy("comp", "ldr", "hdr").agg(F.count(F.lit(1)).alias("n"))


def inverse_table(px: DataFrame) -> DataFrame:
    """ldr, w: each LDR value's mean HDR value, rounded half up."""
    return px.groupBy(F.col("r").alias("ldr")).agg(F.expr("cast(floor(avg(floor(luma)) + 0.5) as bigint)").alias("w"))
