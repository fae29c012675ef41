"""Restart segments, stuffing and container boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(units: DataFrame, interval: int) -> DataFrame:
    """Units (mcu, dc) with their restart segment and the marker that ends it (modulo 8)."""
    return units.select("mcu", "dc", F.expr(f"mcu div {interval}").alias("seg"), F.expr(f"mcu div {interval} % 8").alias("rst"))


def resynchronised(seen: DataFrame, expected: DataFrame) -> DataFrame:
    """seg, mcu, dc, valid: units of all expected segments; those of a segment that is missing are 0 and not valid."""
    return expected.join(seen, ["seg", "mcu"], "left").select("seg", "mcu", F.coalesce("dc", F.lit(0)).alias("dc"), F.col("dc").isNotNull().alias("valid"))


def marker_distance(found: str, wanted: str) -> str:
    """How many segments a restart marker is ahead of the one expected: 1 to 3 ahead are skipped segments, others are behind."""
    return f"case when ({found} - {wanted} + 8) % 8 <= 3 then ({found} - {wanted} + 8) % 8 else ({found} - {wanted} + 8) % 8 - 8 end"


def stuffed(rows: DataFrame, key: str) -> DataFrame:
    """key, place, byte: a 0 follows each FF."""
    w = Window.partitionBy(key).orderBy("i")
    before = F.coalesce(F.sum(F.when(F.col("byte") == 255, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select(key, (F.col("i") + before).alias("at"), F.when(F.col("byte") == 255, F.array(F.lit(255), F.lit(0))).otherwise(F.array(F.col("byte").cast("int"))).alias("bytes"))
    return placed.select(key, "at", F.posexplode("bytes").alias("k", "byte")).select(key, (F.col("at") + F.col("k")).alias("place"), F.col("byte").cast("bigint").alias("byte"))


def unstuffed(rows: DataFrame, key: str) -> DataFrame:
    """key, i, byte: the 0 after each FF taken out."""
    w = Window.partitionBy(key).orderBy("place")
    keep = rows.withColumn("before", F.lag("byte").over(w)).where("not (byte = 0 and coalesce(before, 0) = 255)")
    return keep.select(key, (F.row_number().over(w) - 1).cast("bigint").alias("i"), "byte")


def split(data: DataFrame, key: str, size: int) -> DataFrame:
    """key, seq, payload: a box's bytes in segments of at most `size`."""
    # The bytes are bound first: an inlined expression would be computed for each segment.
    parts = f"get(transform(array(data), w -> transform(sequence(0, greatest(octet_length(w) - 1, 0) div {size}), k -> substring(w, k * {size} + 1, {size}))), 0)"
    return data.select(key, F.expr(f"posexplode({parts})").alias("seq", "payload"))


def reassembled(parts: DataFrame, key: str) -> DataFrame:
    """key, n, data: segments put back in order of their sequence number."""
    p = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("p"))
    return p.select(key, F.size("p").cast("bigint").alias("n"), F.expr("unhex(array_join(transform(p, x -> hex(x.payload)), ''))").alias("data"))


def decoded_until(units: DataFrame, last: int) -> DataFrame:
    """Early termination as a filter that reaches the scan."""
    return units.where(F.col("mcu") <= last)


def default_script(components: int = 3) -> list[tuple[tuple[int, ...], int, int, int, int]]:
    """The default progressive script: components, first and last coefficient, bits kept before, bits kept after."""
    every, colour = tuple(range(components)), range(1, components)
    first = [(every, 0, 0, 0, 1), ((0,), 1, 5, 0, 2), *[((c,), 1, 63, 0, 1) for c in colour], ((0,), 6, 63, 0, 2), ((0,), 1, 63, 2, 1)]
    return first + [(every, 0, 0, 1, 0), *[((c,), 1, 63, 1, 0) for c in (*colour, 0)]]


def brands(boxes: DataFrame, wanted: str) -> DataFrame:
    """doc_id, brand, compatible: the major brand of a file type box (4 bytes, then compatible brands of 4 bytes each), and whether it or the list has `wanted`."""
    each = "transform(sequence(0, greatest(octet_length(data) div 4 - 1, 0)), k -> decode(substring(data, 4 * k + 1, 4), 'ISO-8859-1'))"
    return boxes.selectExpr("doc_id", f"{each} as b").selectExpr("doc_id", "get(b, 0) as brand", f"array_contains(b, '{wanted}') as compatible")


def sequential_script(components: int) -> list[tuple[int, ...]]:
    """Scans of at most four components each."""
    return [tuple(range(k, min(k + 4, components))) for k in range(0, components, 4)]
