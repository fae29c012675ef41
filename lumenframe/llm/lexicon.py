"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon of frequent words.

Words of the whole corpus are counted, and the `size` most frequent (those at least as frequent as a threshold that
the counts' histogram gives) are compiled on the driver into a minimal acyclic automaton: states with equal futures
are one state, so words share suffixes as well as prefixes. Each arc carries a number, and the numbers along a word's
path add up to the word's rank in sorted order; a table has the ids of each rank. The arrays lie in one file in the
shared folder that Spark distributes to the executors; each Python worker memory-maps it. The distinct words of a
slice of text walk the automaton together, one byte a step; words that leave it are unseen, and are merged exactly by
the tokenizer's merge ranks.

Defined results: null is the empty text; an empty text has no ids and decodes to the empty string. Special tokens
spelled out in a text become their ids, as the tokenizers library does. Repeated rows keep a row each. Extra columns
are ignored. An empty table gives an empty result (and a lexicon of no words).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import kit, wordbpe

SIZE = 50_000


def automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct words, with a number on each arc."""
    known: dict[tuple, int] = {}
    arcs: list[tuple[int, int, int, int]] = []  # state, byte, target, number
    final: list[int] = []
    size: list[int] = []  # words from a state on

    def closed(node: list) -> int:
        """The state of a finished trie node [is_word, [(byte, state)]]."""
        key = (node[0], tuple(node[1]))
        if key in known:
            return known[key]
        state = known[key] = len(final)
        final.append(node[0])
        number = node[0]
        for byte, target in node[1]:
            arcs.append((state, byte, target, number))
            number += size[target]
        size.append(number)
        return state

    path: list[list] = [[0, []]]
    before = b""
    for w in words:
        same = 0
        while same < min(len(w), len(before)) and w[same] == before[same]:
            same += 1
        for at in range(len(before), same, -1):
            state = closed(path.pop())
            path[-1][1].append((before[at - 1], state))
        path += [[0, []] for _ in range(len(w) - same)]
        path[-1][0] = 1
        before = w
    for at in range(len(before), 0, -1):
        state = closed(path.pop())
        path[-1][1].append((before[at - 1], state))
    root = closed(path.pop())
    a = np.array(sorted(arcs), np.int64).reshape(-1, 4)
    return {"keys": a[:, 0] << 8 | a[:, 1], "targets": a[:, 2].copy(), "numbers": a[:, 3].copy(), "final": np.array(final, np.int64), "root": np.array([root])}


_PARTS = ("keys", "targets", "numbers", "final", "root", "offsets", "ids")


def packed(parts: dict[str, np.ndarray]) -> bytes:
    head = np.array([len(parts[k]) for k in _PARTS], np.int64)
    return b"".join(np.ascontiguousarray(x, np.int64).tobytes() for x in (head, *(parts[k] for k in _PARTS)))


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str):
        data = np.memmap(path, np.int64, "r")
        at = len(_PARTS)
        for k, n in zip(_PARTS, data[: len(_PARTS)].tolist(), strict=True):
            setattr(self, k, data[at : at + n])
            at += n

    def ranks(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The rank of each word (rows of bytes) in the lexicon, or -1."""
        out = np.full(len(off) - 1, -1, np.int64)
        word, lengths = np.arange(len(off) - 1), np.diff(off)
        state, rank = np.full(len(word), self.root[0]), np.zeros(len(word), np.int64)
        step = 0
        while len(word):
            over = lengths[word] == step
            if over.any():
                ended = over & (self.final[state] > 0)
                out[word[ended]] = rank[ended]
                word, state, rank = word[~over], state[~over], rank[~over]
            if not len(word) or not len(self.keys):
                break
            key = state << 8 | data[off[word] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            go = self.keys[arc] == key
            word, arc = word[go], arc[go]
            state, rank = self.targets[arc], rank[go] + self.numbers[arc]
            step += 1
        return out


@lru_cache(maxsize=2)
def _mapped(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def _counts(vocabulary: str):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.loaded(vocabulary)
        for part in kit.slices(batches):
            words, n = bpe.counted(part.column("text"))
            yield kit.batch(word=pa.array(words, pa.binary()), n=n)

    return counts


def frequent(docs: DataFrame, vocabulary: str, size: int = SIZE) -> list[bytes]:
    """At most `size` words: those whose count in all documents reaches the least threshold that leaves no more."""
    counts = docs.select("text").mapInArrow(_counts(vocabulary), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = kit.written(counts.where("n > 1"), "word-counts")
    grade = F.floor(F.log2("n") * 64)  # under 4,096 grades at any size of input
    left, least = size, None
    for r in counts.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("g")).collect():
        left -= r.words
        if left < 0:
            break
        least = r.least
    found = [] if least is None else [bytes(r.word) for r in counts.where(F.col("n") >= least).select("word").collect()]
    kit.removed(counts)
    return sorted(found)


def compiled(spark: SparkSession, words: list[bytes], vocabulary: str) -> str:
    """Compile sorted words, put the file into the shared folder and have Spark distribute it. Returns its name."""
    bpe = wordbpe.loaded(vocabulary)
    off = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    ids, ids_off = bpe.merged(np.frombuffer(b"".join(words), np.uint8), off)
    data = packed(automaton(words) | {"offsets": ids_off, "ids": ids})
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:20]}.bin"
    jvm, path = spark._jvm, f"{kit.shared_dir(spark)}/{name}"
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        out = fs.create(p, True)
        out.write(bytearray(data))
        out.close()
        spark.sparkContext.addFile(path)
    return name


def _encoded(vocabulary: str, name: str | None):
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, lexicon = wordbpe.loaded(vocabulary), _mapped(name) if name else None
        for part in kit.slices(batches):
            ids, off = bpe.encoded(part.column("text"), lexicon)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer((off * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
            yield kit.batch(doc_id=part.column("doc_id"), n_tokens=np.diff(off), ids=raw.cast(pa.binary()))

    return encoded


def encode(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    vocabulary = vocabulary or wordbpe.default_path()
    docs = docs.select("doc_id", "text")
    name = compiled(docs.sparkSession, frequent(docs, vocabulary, size), vocabulary)
    return docs.mapInArrow(_encoded(vocabulary, name), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids binary")


def _decoded(vocabulary: str, names: list[str]):
    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = wordbpe.loaded(vocabulary)
        for b in kit.slices(batches, "ids"):
            text = [bpe.decoded(np.frombuffer(x.as_py() or b"", "<u4").astype(np.int64)).decode(errors="replace") for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(text, pa.string())], names=[*names, "decoded"])

    return decoded


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The columns of `encoded`, and decoded: the token strings joined by single spaces, special tokens included."""
    vocabulary = vocabulary or wordbpe.default_path()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decoded(vocabulary, encoded.columns), schema + ", decoded string")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(kit.documents(spark, sf_dir)))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


