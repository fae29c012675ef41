"""Boxes in APP11 segments: the header of every segment, splitting, reassembly with checks, super boxes, kinds.

A segment's payload is 'JP', a box number En (2 bytes) and a sequence number Z (4 bytes, from 1), then the box header
(length, 4 bytes; type, 4 bytes; for a length of 1, 8 more bytes of length) and a part of the box's data. The header is
repeated in each segment. All in SQL functions: a box's parts meet in one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.markers import APP11, number

# Box types and the layer they belong to.
LAYERS = {"RESI": "residual", "FINE": "base_refinement", "RFIN": "residual_refinement", "ALFA": "alpha", "AFIN": "alpha_refinement", "ARES": "alpha_residual", "ARRF": "alpha_residual_refinement"}
SUPER = ("SPEC", "ASPC")
ALPHA_MODES = {0: "opaque", 1: "regular", 2: "premultiplied", 3: "matte"}


def _bytes(value: str, n: int) -> str:
    return f"unhex(lpad(hex({value}), {2 * n}, '0'))"


def split(boxes: DataFrame, size: int = 65_533 - 18, wide: bool = False) -> DataFrame:
    """image, en, z, payload: segments of boxes (image, en, type, data). wide: with the 8 bytes of length that a box over 4 GB needs."""
    header = 16 if wide else 8
    length = f"concat({_bytes('1L', 4)}, cast(type as binary), {_bytes(f'octet_length(data) + {header}L', 8)})" if wide else f"concat({_bytes(f'octet_length(data) + {header}L', 4)}, cast(type as binary))"
    parts = boxes.selectExpr("image", "en", "data", f"{length} as head", f"explode(sequence(0, greatest(octet_length(data) - 1, 0) div {size})) as k")
    start = f"concat(cast('JP' as binary), {_bytes('en', 2)}, {_bytes('k + 1L', 4)}, head, substring(data, k * {size} + 1, {size}))"
    return parts.selectExpr("image", "en", "k + 1L as z", f"{start} as payload")


def parts(m: DataFrame) -> DataFrame:
    """image, en, z, length, type, header, data: the APP11 segments that hold boxes."""
    p = m.where(f"marker = {APP11} and substring(payload, 1, 2) = cast('JP' as binary) and octet_length(payload) >= 16")
    p = p.selectExpr("image", "payload", f"{number(2, 2)} as en", f"{number(4, 4)} as z", f"{number(8, 4)} as short", "decode(substring(payload, 13, 4), 'ISO-8859-1') as type")
    p = p.selectExpr("*", f"if(short = 1, {number(16, 8)}, short) as length", "if(short = 1, 16L, 8L) as header")
    return p.selectExpr("image", "en", "z", "length", "type", "header", "substring(payload, cast(9 + header as int)) as data")


def reassembled(m: DataFrame) -> DataFrame:
    """image, en, type, data, valid: boxes whole again. Not valid: a sequence number is missing or occurs twice, or the size isn't the header's."""
    p = parts(m).groupBy("image", "en", "type").agg(F.array_sort(F.collect_list(F.struct("z", "data"))).alias("p"), F.min("length").alias("least"), F.max("length").alias("length"), F.max("header").alias("header"))
    whole = p.selectExpr("image", "en", "type", "unhex(array_join(transform(p, x -> hex(x.data)), '')) as data", "transform(p, x -> x.z) as z", "least", "length", "header")
    return whole.selectExpr("image", "en", "type", "data", "least = length and octet_length(data) + header = length and z = sequence(1L, cast(size(z) as bigint)) as valid")


def children(boxes: DataFrame) -> DataFrame:
    """image, en, place, type, data: the boxes inside super boxes, in order. A child that reaches beyond its parent ends the walk."""
    kinds = ", ".join(f"'{k}'" for k in SUPER)
    size = number("s.at", 4, "data")
    step = f"if(coalesce({size}, 0L) < 8 or s.at + {size} > octet_length(data), struct(cast(octet_length(data) as bigint) as at, s.found as found), struct(s.at + {size} as at, concat(s.found, array(s.at)) as found))"
    walk = f"aggregate(sequence(0, octet_length(data) div 8), struct(0L as at, cast(array() as array<bigint>) as found), (s, i) -> if(s.at >= octet_length(data), s, {step}))"
    c = boxes.where(f"type in ({kinds})").selectExpr("image", "en", "data", f"posexplode({walk}.found) as (place, at)")
    return c.selectExpr("image", "en", "cast(place as bigint) as place", "decode(substring(data, cast(at + 5 as int), 4), 'ISO-8859-1') as type", f"substring(data, cast(at + 9 as int), cast({number('at', 4, 'data')} - 8 as int)) as data")


def super_box(inner: DataFrame, kind: str = "SPEC") -> DataFrame:
    """image, en, type, data: one super box from children (image, en, place, type, data)."""
    each = f"concat({_bytes('octet_length(data) + 8L', 4)}, cast(type as binary), data)"
    rows = inner.selectExpr("image", "en", "place", f"hex({each}) as piece").groupBy("image", "en").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("p"))
    return rows.selectExpr("image", "en", f"'{kind}' as type", "unhex(array_join(transform(p, x -> x.piece), '')) as data")


def layered(boxes: DataFrame) -> DataFrame:
    """The boxes with the layer that their data belong to (null: no data box)."""
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in LAYERS.items())
    return boxes.selectExpr("*", f"case type {cases} end as layer")


def file_type(boxes: DataFrame) -> DataFrame:
    """image, brand, version, compatible: of file type boxes (type ftyp)."""
    each = "transform(sequence(2, octet_length(data) div 4 - 1), k -> decode(substring(data, 4 * k + 1, 4), 'ISO-8859-1'))"
    f = boxes.where("type = 'ftyp' and octet_length(data) >= 8")
    return f.selectExpr("image", "decode(substring(data, 1, 4), 'ISO-8859-1') as brand", f"{number(4, 4, 'data')} as version", f"if(octet_length(data) < 12, cast(array() as array<string>), {each}) as compatible")


def alpha_mode(boxes: DataFrame) -> DataFrame:
    """image, mode: how an image's alpha plane is meant (type AMUL: its first four bits); nothing is composed here."""
    cases = " ".join(f"when {k} then '{v}'" for k, v in ALPHA_MODES.items())
    return boxes.where("type = 'AMUL'").selectExpr("image", f"case shiftright({number(0, 1, 'data')}, 4) {cases} end as mode")


def checksums(boxes: DataFrame) -> DataFrame:
    """image, checksum: what checksum boxes (type LCHK) say."""
    return boxes.where("type = 'LCHK'").selectExpr("image", f"{number(0, 4, 'data')} as checksum")
