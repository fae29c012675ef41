import hashlib
import zlib

import numpy as np
from pyspark.sql import types as T

from lumenframe.llm import media, webp

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("media", T.StringType()), T.StructField("feature", T.StringType())])


def test_op10(spark, tmp_path):
    rng = np.random.default_rng(1)
    texts = [None, "", "a", "x" * 64, "ab" * 500, "é😀\n" * 77, "".join(map(chr, rng.integers(1, 0xD000, 3000))), "the end " * 9000, "z" * 1_200_000, *(" ".join(rng.choice(["of", "the", "thndre"], k)) for k in range(40))]
    rows = [(None if k == 3 else k // 2, t) for k, t in enumerate(texts)] + [(2, "ab" * 500)]
    spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op10(spark, str(tmp_path)).collect()
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        p = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    by = {}
    for r in got:
        assert by.setdefault(r.payload_sha256, r[5:]) == r[5:]
    assert all(r.media_bytes < 64 + r.payload_bytes * 1.1 for r in got)


def test_stored_file_is_a_grey_picture():
    text = np.frombuffer(b"a plain text that repeats, a plain text that repeats; " * 9, np.uint8)
    p = media.padded(text)
    px, width = webp.decode(media.stored(p))
    assert width == 64 and ((px >> 16 & 255) == p).all() and ((px & 255) == p).all() and (px >> 24 == 255).all()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert media.op10(spark, str(tmp_path)).collect() == []
