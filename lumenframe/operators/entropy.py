"""Huffman coding of baseline scans, and whole files: serial work, one restart segment a group.

Blocks (image, seg, mcu, q) are coded group by group with the standard's tables, and the segments of an image are joined
to a JPEG file. Reading goes from file to marker relation; `scans.decode` goes on from there with the file's own tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.blocks import zigzag

# The luminance code tables of ITU-T T.81, Annex K (numbers of codes by length; symbols in order of code).
DC_BITS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_SYMBOLS = list(range(12))
AC_BITS = [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]
AC_SYMBOLS = [
    0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1,
    0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82, 0x09, 0x0A, 0x16, 0x17, 0x18, 0x19, 0x1A, 0x25, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x34, 0x35, 0x36, 0x37,
    0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A,
    0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3,
    0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3,
    0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xE1, 0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF1, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA,
]


def codes(bits: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length): canonical codes."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(maxsize=1)
def tables() -> tuple[dict, dict]:
    """(code, length) by symbol of DC and AC."""
    return codes(DC_BITS, DC_SYMBOLS), codes(AC_BITS, AC_SYMBOLS)


def packed(values: np.ndarray, bits: np.ndarray) -> bytes:
    """The values' bits, one after another, filled up with ones, a 0 byte after each FF."""
    bits = bits.astype(np.int64)
    row = np.repeat(np.arange(len(bits)), bits)
    at = np.arange(len(row)) - np.repeat(np.cumsum(bits) - bits, bits)
    b = values.astype(np.int64)[row] >> (bits[row] - 1 - at) & 1
    return np.packbits(np.append(b, np.ones(-len(b) % 8, np.int64)).astype(np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def encoded_segment(blocks: list[list[int]]) -> bytes:
    """Coefficient blocks (raster order) of one segment: DC differences and AC runs, Huffman coded."""
    dc, ac = tables()
    order, out, before = zigzag(), [], 0
    for q in blocks:
        diff, before = q[0] - before, q[0]
        size = abs(diff).bit_length()
        out += [dc[size], ((diff if diff >= 0 else diff - 1) & (1 << size) - 1, size)]
        run = 0
        last = max((k for k in range(1, 64) if q[order[k]]), default=0)
        for k in range(1, last + 1):
            v = q[order[k]]
            if not v:
                run += 1
                continue
            while run > 15:
                out.append(ac[0xF0])
                run -= 16
            size = abs(v).bit_length()
            out += [ac[run << 4 | size], ((v if v >= 0 else v - 1) & (1 << size) - 1, size)]
            run = 0
        if last < 63:
            out.append(ac[0])
    v = np.array(out, np.int64).reshape(-1, 2)
    return packed(v[:, 0], v[:, 1])


def encode(blocks: DataFrame) -> DataFrame:
    """image, seg, n, data from (image, seg, mcu, q)."""

    def coded(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("mcu")
        return pd.DataFrame({"image": p.image.iloc[:1], "seg": p.seg.iloc[:1], "n": [len(p)], "data": [encoded_segment([list(map(int, q)) for q in p.q])]})

    return blocks.select("image", "seg", "mcu", "q").groupBy("image", "seg").applyInPandas(coded, "image bigint, seg bigint, n bigint, data binary")


def marker(code: int, payload: bytes = b"") -> bytes:
    return bytes([0xFF, code]) + ((len(payload) + 2).to_bytes(2, "big") + payload if payload else b"")


def header(width: int, height: int, deltas: list[int], interval: int) -> bytes:
    """SOI, quantization table, frame, code tables, restart interval and scan of one 8-bit component."""
    scan = bytes(deltas[k] for k in zigzag())
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return (
        b"\xff\xd8" + marker(0xDB, b"\0" + scan) + marker(0xC0, frame) + marker(0xC4, b"\0" + bytes(DC_BITS) + bytes(DC_SYMBOLS))
        + marker(0xC4, b"\x10" + bytes(AC_BITS) + bytes(AC_SYMBOLS)) + marker(0xDD, interval.to_bytes(2, "big")) + marker(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def files(segments: DataFrame, deltas: list[int], interval: int, across: int) -> DataFrame:
    """image, file: each image's segments in order, with restart markers between them. across: blocks in a row."""
    parts = segments.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("seg", "n", "data"))).alias("s"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s in b.column("s").to_pylist():
                n = sum(x["n"] for x in s)
                data = b"".join(x["data"] + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(s) else b"") for k, x in enumerate(s))
                out.append(header(8 * min(n, across), 8 * -(-n // across), deltas, interval) + data + b"\xff\xd9")
            yield pa.RecordBatch.from_arrays([b.column("image"), pa.array(out, pa.binary())], names=["image", "file"])

    return parts.mapInArrow(joined, "image bigint, file binary")


def parsed(file: bytes) -> list[tuple[int, bytes]]:
    """(marker, payload) in order; entropy coded data follow as payloads of SOS (0xDA, after its header) and of restart markers."""
    if file[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    out, at = [(0xD8, b"")], 2
    while at + 1 < len(file):
        if file[at] != 0xFF:
            raise ValueError("a marker was expected")
        code = file[at + 1]
        at += 2
        if code == 0xD9:
            out.append((code, b""))
            break
        if not 0xD0 <= code <= 0xD7:
            n = int.from_bytes(file[at : at + 2], "big")
            out.append((code, file[at + 2 : at + n]))
            at += n
            if code != 0xDA:
                continue
            code = 0  # the first segment of the scan
        end = at
        while end + 1 < len(file) and not (file[end] == 0xFF and file[end + 1] != 0):
            end = file.find(b"\xff", end + 1 if file[end] != 0xFF else end + 2)
            end = len(file) if end < 0 else end
        out.append((code, file[at:end]))
        at = end
    return out


def markers(images: DataFrame) -> DataFrame:
    """image, seq, marker, payload of every file; marker 0 is the data that follow SOS. A file that isn't one has a row with marker -1."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for image, file in zip(b.column("image").to_pylist(), b.column("file").to_pylist(), strict=True):
                try:
                    rows += [(image, k, code, data) for k, (code, data) in enumerate(parsed(file or b""))]
                except ValueError:
                    rows.append((image, 0, -1, None))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["image", "seq", "marker", "payload"])

    return images.mapInArrow(split, "image bigint, seq bigint, marker bigint, payload binary")


def information(m: DataFrame) -> DataFrame:
    """image, width, height, precision, components from the frame markers."""
    number = lambda at, n: F.conv(F.hex(F.substring("payload", at, n)), 16, 10).cast("bigint")
    return m.where("marker = 192").select("image", number(4, 2).alias("width"), number(2, 2).alias("height"), number(1, 1).alias("precision"), number(6, 1).alias("components"))
