"""Marker segments as relations, in SQL functions alone: each parser takes the rows (image, seq, marker, payload) of
`entropy.markers` and gives a row for each table, component, scan or field. Payloads are without marker and length.

Numbers are big-endian and unsigned. A payload that ends early gives nulls for what is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

DQT, DHT, DAC, DRI, SOS, DNL, LSE, EXP, APP0, APP1, APP11, APP14, COM = 0xDB, 0xC4, 0xCC, 0xDD, 0xDA, 0xDC, 0xF8, 0xDF, 0xE0, 0xE1, 0xEB, 0xEE, 0xFE
FRAMES = (0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF, 0xF7)
_SKIPPED = "array(" + ", ".join(f"{k}L" for k in (DQT, DHT, DAC, DRI, DNL, LSE, EXP, *range(0xE0, 0xF0), COM)) + ")"


def number(at: str | int, n: int = 1, column: str = "payload") -> str:
    """The n bytes from place `at` (0 is the first) as a number."""
    return f"if(octet_length({column}) >= ({at}) + {n}, cast(conv(hex(substring({column}, cast(({at}) + 1 as int), {n})), 16, 10) as bigint), null)"


def _tables(m: DataFrame, code: int, size: str) -> DataFrame:
    """image, seq, at, payload: one row for each table of a segment that holds several; size: bytes of the table at place `s.at`."""
    # The walk from table to table, at most one for each byte; ends are where the next table would begin after the payload.
    walk = f"aggregate(sequence(1, octet_length(payload)), struct(0L as at, cast(array() as array<bigint>) as found), (s, i) -> if(s.at >= octet_length(payload), s, struct(s.at + {size} as at, concat(s.found, array(s.at)) as found)))"
    return m.where(f"marker = {code} and octet_length(payload) > 0").selectExpr("image", "seq", "payload", f"explode({walk}.found) as at")


def quantization(m: DataFrame) -> DataFrame:
    """image, seq, tq, bits, k, delta: k in zig-zag order."""
    size = f"1 + 64 * (1 + shiftright({number('s.at')}, 4))"
    t = _tables(m, DQT, size).selectExpr("image", "seq", "payload", "at", f"{number('at')} & 15L as tq", f"shiftright({number('at')}, 4) as wide")
    t = t.selectExpr("image", "seq", "payload", "at", "tq", "wide", "explode(sequence(0L, 63L)) as k")
    return t.selectExpr("image", "seq", "tq", "8 + 8 * wide as bits", "k", f"if(wide = 0, {number('at + 1 + k')}, {number('at + 1 + 2 * k', 2)}) as delta")


def huffman(m: DataFrame) -> DataFrame:
    """image, seq, tc, th, place, size, symbol: symbols in order of code; tc: 0 DC, 1 AC."""
    counts = lambda at: f"transform(sequence(1, 16), j -> {number(f'{at} + j')})"
    total = f"aggregate({counts('s.at')}, 0L, (a, n) -> a + n)"
    t = _tables(m, DHT, f"17 + {total}").selectExpr("image", "seq", "payload", "at", f"shiftright({number('at')}, 4) as tc", f"{number('at')} & 15L as th", f"{counts('at')} as counts")
    t = t.selectExpr("image", "seq", "payload", "at", "tc", "th", "posexplode(flatten(transform(counts, (n, j) -> array_repeat(cast(j + 1 as bigint), cast(n as int))))) as (place, size)")
    return t.selectExpr("image", "seq", "tc", "th", "cast(place as bigint) as place", "size", f"{number('at + 17 + place')} as symbol")


def conditioning(m: DataFrame) -> DataFrame:
    """image, seq, tc, tb, low, high: of arithmetic coding; for DC (tc 0) the bounds of differences, for AC (tc 1) low is the band limit."""
    t = _tables(m, DAC, "2").selectExpr("image", "seq", f"shiftright({number('at')}, 4) as tc", f"{number('at')} & 15L as tb", f"{number('at + 1')} as v")
    return t.selectExpr("image", "seq", "tc", "tb", "if(tc = 0, v & 15L, v) as low", "if(tc = 0, shiftright(v, 4), null) as high")


def frames(m: DataFrame) -> DataFrame:
    """image, seq, marker, precision, height, width, n: of every kind of frame; a height of 0 is replaced by that of the image's DNL segment."""
    f = m.where(f"marker in {FRAMES}").selectExpr("image", "seq", "marker", f"{number(0)} as precision", f"{number(1, 2)} as height", f"{number(3, 2)} as width", f"{number(5)} as n")
    late = m.where(f"marker = {DNL}").groupBy("image").agg({"payload": "max"}).withColumnRenamed("max(payload)", "p").selectExpr("image", f"{number(0, 2, 'p')} as lines")
    return f.join(late, "image", "left").selectExpr("image", "seq", "marker", "precision", "if(height = 0, coalesce(lines, 0L), height) as height", "width", "n")


def components(m: DataFrame) -> DataFrame:
    """image, seq, comp, id, h, v, tq: the components of every frame, in order."""
    f = m.where(f"marker in {FRAMES}").selectExpr("image", "seq", "payload", f"explode(sequence(0L, {number(5)} - 1)) as comp")
    at = lambda k: number(f"6 + 3 * comp + {k}")
    return f.selectExpr("image", "seq", "comp", f"{at(0)} as id", f"shiftright({at(1)}, 4) as h", f"{at(1)} & 15L as v", f"{at(2)} as tq")


def scans(m: DataFrame) -> DataFrame:
    """image, seq, place, id, td, ta, ss, se, ah, al: a row for each component of each scan."""
    s = m.where(f"marker = {SOS}").selectExpr("image", "seq", "payload", f"{number(0)} as n").selectExpr("*", "explode(sequence(0L, n - 1)) as place")
    end = lambda k: number(f"1 + 2 * n + {k}")
    return s.selectExpr("image", "seq", "place", f"{number('1 + 2 * place')} as id", f"shiftright({number('2 + 2 * place')}, 4) as td", f"{number('2 + 2 * place')} & 15L as ta",
                        f"{end(0)} as ss", f"{end(1)} as se", f"shiftright({end(2)}, 4) as ah", f"{end(2)} & 15L as al")


def thresholds(m: DataFrame) -> DataFrame:
    """image, seq, high, t1, t2, t3, reset: near-lossless parameters; other kinds of LSE segments are left out."""
    f = m.where(f"marker = {LSE} and {number(0)} = 1")
    return f.selectExpr("image", "seq", *[f"{number(1 + 2 * k, 2)} as {n}" for k, n in enumerate(("high", "t1", "t2", "t3", "reset"))])


def application(m: DataFrame) -> DataFrame:
    """image, seq, kind, and the fields of JFIF (version, unit, dx, dy), Adobe (version, transform) and EXIF (little: byte order, entries of the first directory)."""
    name = lambda n: f"decode(substring(payload, 1, {n}), 'ISO-8859-1')"
    kind = f"case when marker = {APP0} and {name(4)} = 'JFIF' then 'jfif' when marker = {APP14} and {name(5)} = 'Adobe' then 'adobe' when marker = {APP1} and {name(4)} = 'Exif' then 'exif' end"
    little = "substring(payload, 7, 2) = X'4949'"
    entries = f"if({little}, {number(14)} + 256 * {number(15)}, {number(14, 2)})"
    return m.selectExpr("image", "seq", "payload", f"{kind} as kind").where("kind is not null").selectExpr(
        "image", "seq", "kind", f"case kind when 'jfif' then {number(5, 2)} when 'adobe' then {number(5, 2)} end as version", f"if(kind = 'jfif', {number(7)}, null) as unit",
        f"if(kind = 'jfif', {number(8, 2)}, null) as dx", f"if(kind = 'jfif', {number(10, 2)}, null) as dy", f"if(kind = 'adobe', {number(11)}, null) as transform",
        f"if(kind = 'exif', {little}, null) as little", f"if(kind = 'exif', {entries}, null) as entries",
    )


def intervals(m: DataFrame) -> DataFrame:
    """image, seq, interval: restart intervals, each in force from its place on."""
    return m.where(f"marker = {DRI}").selectExpr("image", "seq", f"{number(0, 2)} as interval")


def next_of(m: DataFrame, codes: tuple[int, ...]) -> DataFrame:
    """image, seq, at: for each segment the place of the first one from there on whose marker is one of the codes (null: none is left)."""
    return m.selectExpr("image", "seq", f"min(if(marker in ({', '.join(map(str, codes))}), seq, null)) over (partition by image order by seq rows between current row and unbounded following) as at")


def injected(m: DataFrame, extra: DataFrame) -> DataFrame:
    """The segments with further ones (image, before, marker, payload) put in before the place `before`; places are numbered anew."""
    both = m.selectExpr("image", "2 * seq + 1 as at", "marker", "payload").unionByName(extra.selectExpr("image", "2 * before as at", "marker", "payload"))
    return both.selectExpr("image", "row_number() over (partition by image order by at) - 1L as seq", "marker", "payload")
