"""What the operators of this package share: written tables, Arrow text as bytes, words and their hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a Python task works on at a time; a longer text is taken whole, alone.
SLICE_BYTES = 2 << 20
_own_dirs: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or on one machine (tests) one of our own where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: executors and driver share no folder")
        if app not in _own_dirs:
            _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        base = _own_dirs[app]
    return f"{base.rstrip('/')}/lumenframe-{app}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    keep = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, keep)
    return spark.read.schema(df.schema).parquet(path)


#: Spark removes the shuffle files of a finished query at once, rather than when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def removed(df: DataFrame) -> None:
    """Delete the files of a table that written() made and that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def fold(doc_id: str = "doc_id", n: int = 4):
    """crc32 of the id as text, modulo n (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


# ---- Arrow text as bytes


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of at most `most` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def column_slices(column: pa.Array, most: int = 1 << 20) -> list[pa.Array]:
    """A text column in parts of at most `most` bytes or one row."""
    return [b.column("text") for b in slices(iter([batch(text=column)]), most=most)]


def text_slices(texts: list[str], rows: int = 64, most: int = 1 << 18) -> Iterator[pa.Array]:
    """Texts of the driver as columns of at most `rows` rows and `most` bytes, or one row: one at a time, no copy of them all."""
    for at in range(0, len(texts), rows):
        yield from column_slices(pa.array(texts[at : at + rows]), most)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and the offsets of its rows in them. Null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    n, buffers = len(column), column.buffers()
    off = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))


# ---- words and hashes, for a whole slice at once

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross a row's border, and where each row's runs begin."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    border = np.zeros(n + 1, bool)
    border[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes, from prefix sums of a polynomial."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(_BASE_INVERSE, len(data) + 1)[starts])


#: Two primes under 2**31; the bases and the values of bytes are drawn once.
_PRIMES = (2_147_483_647, 2_147_483_629)
_BASES = tuple(int(_rng.integers(1 << 29, p - 1)) for p in _PRIMES)
_VALUES = tuple(_rng.permutation(1 << 16)[:256].astype(np.int64) + 1 for _ in _PRIMES)


def residue_powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo prime."""
    out = np.ones(max(n, 1), np.int64)
    size, step = 1, base
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * step % prime
        size, step = size + more, step * step % prime
    return out[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range of bytes from polynomials modulo two primes: 62 bits, mixed to 64.

    Two different words of n bytes share it for at most n of 2**31 bases in each of both; no pair does for all bases, as
    pairs do modulo a power of two.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.zeros(len(starts), np.uint64)
    for prime, base, value in zip(_PRIMES, _BASES, _VALUES, strict=True):
        sums = np.zeros(len(data) + 1, np.int64)  # each term is under 2**31: exact for 2**32 bytes
        np.cumsum(value[data] * residue_powers(base, prime, len(data)) % prime, out=sums[1:])
        back = residue_powers(pow(base, -1, prime), prime, len(data) + 1)[starts]
        h = (sums[ends] - sums[starts]) % prime * back % prime
        out = out << np.uint64(31) | h.astype(np.uint64)
    return mixed(out)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item of rows of these lengths: its row, and its place there."""
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    return row, np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def taken(data: np.ndarray, off: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows `index` of a ragged array, and the offsets of the result."""
    lengths = off[index + 1] - off[index]
    out = np.zeros(len(index) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return data[np.arange(out[-1]) - np.repeat(out[:-1] - off[index], lengths)], out


def row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of the rows of a ragged array, along the first axis; an empty row has 0."""
    sums = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]
