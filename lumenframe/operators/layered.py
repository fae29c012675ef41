"""What a file hides in boxes: a second codestream of residuals, and refinement scans that only some decoders see.

The encoder is a closed loop of two chained jobs: the base file is written and decoded, and the residual is the original
minus what a decoder will see, so base plus residual is the original, whatever the base lost. Residual samples are coded as
they are (the transform bypassed) in a sequential scan of their own, which travels as a box of type RESI, split over APP11
segments before the base's first scan. A decoder that knows no boxes sees the base alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import boxes as BX
from lumenframe.operators import markers as M
from lumenframe.operators.entropy import markers

KEYS = ["image", "comp", "by", "bx"]


def residuals(original: DataFrame, decoded: DataFrame) -> DataFrame:
    """image, comp, by, bx, q: original minus decoded samples (both image, comp, by, bx, v)."""
    both = original.join(decoded.withColumnRenamed("v", "w"), KEYS)
    return both.selectExpr(*[f"`{k}`" for k in KEYS], "zip_with(v, w, (a, b) -> a - b) as q")


def sums(decoded: DataFrame, residual: DataFrame) -> DataFrame:
    """image, comp, by, bx, v: decoded samples plus residuals (q); blocks without a residual stay as decoded."""
    both = decoded.join(residual.select(*KEYS, "q"), KEYS, "left")
    return both.selectExpr(*[f"`{k}`" for k in KEYS], "if(q is null, v, zip_with(v, q, (a, b) -> a + b)) as v")


def files(m: DataFrame) -> DataFrame:
    """image, file from a marker relation (image, seq, marker, payload): the inverse of entropy.markers."""
    two = lambda v: f"unhex(lpad(hex({v}), 4, '0'))"
    code = f"concat(X'FF', unhex(lpad(hex(marker), 2, '0')))"
    body = f"case when marker = 0 then payload when marker in (216, 217) then {code} when marker between 208 and 215 then concat({code}, payload) else concat({code}, {two('octet_length(payload) + 2')}, payload) end"
    rows = m.selectExpr("image", "seq", f"hex({body}) as piece").groupBy("image").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("p"))
    return rows.selectExpr("image", "unhex(array_join(transform(p, x -> x.piece), '')) as file")


def embedded(m: DataFrame, boxes: DataFrame, size: int = 65_000) -> DataFrame:
    """The marker relation m with boxes (image, en, type, data) in APP11 segments before the first scan."""
    first = m.where(f"marker = {M.SOS}").groupBy("image").agg(F.min("seq").alias("before"))
    parts = BX.split(boxes, size).join(first, "image")
    both = m.selectExpr("image", "seq as a", "1 as b", "0L as c", "0L as d", "marker", "payload").unionByName(
        parts.selectExpr("image", "before as a", "0 as b", "en as c", "z as d", f"{M.APP11}L as marker", "payload"))
    return both.selectExpr("image", "row_number() over (partition by image order by a, b, c, d) - 1L as seq", "marker", "payload")


def embedded_files(m: DataFrame, kind: str = "RESI") -> DataFrame:
    """image, file: the codestreams in whole boxes of this type."""
    return BX.reassembled(m).where(f"type = '{kind}' and valid").selectExpr("image", "data as file")


def hidden(m: DataFrame, size: int = 65_000) -> DataFrame:
    """The marker relation m whose refinement scans (with their tables) lie in a box of type FINE instead: what is left is a file of fewer bits.

    A script's refinements follow its first passes, so what is hidden is one stretch before the end of the image.
    """
    first = M.scans(m).where("ah > 0").groupBy("image").agg(F.min("seq").alias("sos"))
    data = "(marker = 0 or marker between 208 and 215)"
    start = m.join(first, "image").where(f"{data} and seq < sos").groupBy("image").agg(F.max("seq").alias("last"))
    known = m.join(start, "image", "left")
    inside = known.where("seq > last and marker <> 217").select("image", "seq", "marker", "payload")
    rest = known.where("last is null or seq <= last or marker = 217").select("image", "seq", "marker", "payload")
    return embedded(rest, files(inside).selectExpr("image", "1L as en", "'FINE' as type", "file as data"), size)


def with_hidden(m: DataFrame) -> DataFrame:
    """The marker relation m with the scans of its FINE boxes before the end of the image: the inverse of hidden."""
    inner = markers(embedded_files(m, "FINE").selectExpr("image", "concat(X'FFD8', file, X'FFD9') as file")).where("marker not in (216, 217)")
    end = m.where("marker = 217").groupBy("image").agg(F.min("seq").alias("end"))
    more = inner.join(end, "image").selectExpr("image", "end as a", "0 as b", "seq as c", "marker", "payload")
    both = m.where(f"marker <> {M.APP11}").selectExpr("image", "seq as a", "1 as b", "0L as c", "marker", "payload").unionByName(more)
    return both.selectExpr("image", "row_number() over (partition by image order by a, b, c) - 1L as seq", "marker", "payload")
