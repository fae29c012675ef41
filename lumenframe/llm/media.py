"""Texts as lossless WebP images: stored, read back, and described by features of the pixels.

A text's UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, are the samples of a grey image 64 pixels wide
(wider above 1 MB, several images above 256 MB). Stored with subtract-green, so that one prefix code carries the
samples, and with back-references; texts of at most 16 different bytes are stored by a palette with bundled pixels. A
predictor transform (left or top neighbour, for the whole image) comes first where it lowers the samples' entropy.
The stored file is then decoded again and everything else is computed from what was read back. `stored` and `read`
are general: `read` takes any lossless WebP file.

Defined results: null is the empty text, stored as 64 bytes 0. Equal texts have equal values. Repeated rows keep a row
each. Extra columns are ignored. An empty table gives an empty result. A file that can't be decoded raises.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import kit, webp

ROW, MOST_BYTES = 64, 1 << 28


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(max(ROW, -(-len(data) // ROW) * ROW) - len(data), np.uint8)])


def stored(payload: np.ndarray) -> bytes:
    """One WebP file after another that hold the samples (a positive multiple of 64)."""
    out = []
    for at in range(0, len(payload), MOST_BYTES):
        v = payload[at : at + MOST_BYTES].astype(np.int64)
        width = ROW * -(-len(v) // (ROW * webp.MOST))
        v = np.concatenate([v, np.zeros(-len(v) % width, np.int64)])
        grey = 255 << 24 | v << 16 | v << 8 | v
        few = len(np.flatnonzero(np.bincount(v, minlength=256))) <= 16
        mode = 0 if few else predictor(v, width)
        modes = (9, np.full((-(-len(v) // width >> 9) + 1, -(-width >> 9) + 1), mode)) if mode else None
        out.append(webp.encode(grey, width, palette=few, grey=not few, lz=True, predictor=modes))
    return b"".join(out)


def entropy(v: np.ndarray) -> float:
    """Bits a sample of a code by frequency alone."""
    share = np.bincount(v, minlength=256)
    share = share[share > 0] / len(v)
    return float(-(share * np.log2(share)).sum())


def predictor(v: np.ndarray, width: int) -> int:
    """The predictor mode after which samples have the least entropy: 0 (no transform), 1 (left) or 2 (top)."""
    costs = [entropy(v), entropy(np.diff(v, prepend=0) & 255)]
    if len(v) > width:
        costs.append(entropy((v - np.concatenate([np.zeros(width, np.int64), v[:-width]])) & 255))
    return int(np.argmin(costs))


def read(files: bytes, n: int) -> np.ndarray:
    """The first n green samples of the images."""
    parts, at = [], 0
    while at < len(files):
        size = 8 + int.from_bytes(files[at + 4 : at + 8], "little")
        px, _ = webp.decode(files[at : at + size])
        parts.append((px >> 8 & 255).astype(np.uint8))
        at += size
    return np.concatenate(parts)[:n]


def features(samples: np.ndarray) -> dict[str, str]:
    """Mean, deviation, entropy and mean step to the right neighbour of a grey image, and a 64-bit difference hash of its 8 x 9 block means."""
    share = np.bincount(samples, minlength=256) / len(samples)
    some, level = share[share > 0], np.arange(256)
    mean = share @ level
    image = samples.reshape(-1, ROW).astype(np.int16)
    step = np.abs(np.diff(image, axis=1)).mean()
    rows = np.minimum(np.linspace(0, len(image), 9).astype(int)[:-1], len(image) - 1)
    columns = np.linspace(0, ROW, 10).astype(int)
    # Sums of each band of rows (of one row where the image has fewer than eight), then of each band of columns.
    block = np.add.reduceat(np.add.reduceat(image, rows, axis=0, dtype=np.int64), columns[:-1], axis=1) / np.diff(columns)
    bits = np.packbits((block[:, 1:] > block[:, :-1]).ravel()).tobytes().hex()
    return {"mean": f"{mean:.4f}", "deviation": f"{np.sqrt(max(0.0, share @ level**2 - mean**2)):.4f}", "entropy": f"{-(some * np.log2(some)).sum() + 0:.4f}", "step": f"{step:.4f}", "dhash": bits}


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in kit.slices(batches):
        data, off = kit.utf8(part.column("text"))
        rows = []
        for a, b in zip(off.tolist(), off.tolist()[1:], strict=False):
            payload = padded(data[a:b])
            file = stored(payload)
            back = read(file, len(payload))
            rows.append((b - a, len(back), file, back.tobytes(), ";".join(f"{k}={v}" for k, v in features(back).items())))
        n, size, file, back, feature = zip(*rows, strict=True)
        yield kit.batch(
            doc_id=part.column("doc_id"), n_bytes=pa.array(n, pa.int64()), payload_bytes=pa.array(size, pa.int64()), media=pa.array(file, pa.binary()),
            payload_sha256=pa.array([hashlib.sha256(x).hexdigest() for x in back]), tail_crc32=pa.array([zlib.crc32(x[-ROW:]) for x in back], pa.int64()), feature=pa.array(feature),
        )


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, media (the stored files), payload_sha256 and tail_crc32 (of the samples read back), feature."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_media, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, media binary, payload_sha256 string, tail_crc32 bigint, feature string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media(kit.documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
