import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lumenframe.llm import lexicon, packing, wordbpe

PATH = wordbpe.default_path()
LIB = Tokenizer.from_file(PATH)
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("length", T.StringType())])


def texts():
    r = random.Random(5)
    alpha = "abcXYZ éÉßΣσςİıǅﬁ½²٣、。'sT́  　\u0085​\x1c\x00<|>日本 😀🇩🇪\n\t!?'ll've don't-×÷"
    fixed = ["", " ", "<|endoftext|>", "x<|endoftext|>y <|endoftext|", "<|ENDOFTEXT|>", "aaaaaaaaa aaaa!!!!!!!!", "ΑΣ ΣΑΣ", "ȟᲉ", "it's we'll ''s 'sofa", "word " * 3000, "z" * 30_000]
    return fixed + ["".join(r.choice(alpha) for _ in range(r.randint(0, 40))) for _ in range(600)]


def test_ids_are_the_librarys():
    ids, off = wordbpe.loaded(PATH).encoded(pa.array([None, *texts()]))
    want = [[], *(LIB.encode(t, add_special_tokens=False).ids for t in texts())]
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == want


def test_automaton(tmp_path):
    r = random.Random(2)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 7))).encode() for _ in range(500)} | {b"running", b"jumping", "é".encode()})
    parts = lexicon.automaton(words)
    assert len(parts["final"]) < 400  # shared suffixes
    (tmp_path / "x").write_bytes(lexicon.packed(parts | {"offsets": np.arange(len(words) + 1), "ids": np.arange(len(words))}))
    lex = lexicon.Lexicon(str(tmp_path / "x"))
    look = words + [b"runnin", b"runningg", b"", b"zzz", b"abcabcabc"]
    off = np.concatenate([[0], np.cumsum([len(w) for w in look])])
    assert lex.ranks(np.frombuffer(b"".join(look), np.uint8), off).tolist() == [*range(len(words)), -1, -1, -1, -1, words.index(b"abcabcabc") if b"abcabcabc" in words else -1]


def test_op5(spark, tmp_path):
    rows = [(None, "no id"), (1, None), *enumerate(texts(), 2), (5, "again"), (5, "again")]
    spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in lexicon.op5(spark, str(tmp_path)).collect()), key=str)
    want = []
    for d, t in rows:
        ids = LIB.encode(t or "", add_special_tokens=False).ids
        text = LIB.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_frequent(spark):
    df = spark.createDataFrame([("a a a b b c c d",), (None,), ("a b Σ σ'll",)], "text string")
    assert lexicon.frequent(df, PATH, 2) == [b"a", b"b"]
    assert lexicon.frequent(df, PATH, 99) == sorted([b"a", b"b", b"c", "σ".encode()])
    assert lexicon.frequent(df, PATH, 0) == []


@pytest.mark.parametrize("rows", [[], [(None, "lone"), (1, None), (2, ""), (3, "long word " * 2500), (3, "long word " * 2500), *((k, "a b c " * k) for k in range(10, 400))]])
def test_op9(spark, tmp_path, rows):
    spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op9(spark, str(tmp_path)).collect()
    want = Counter()
    for d, t in rows:
        ids = [*LIB.encode(t or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            p = ids[s : s + 2048]
            want[d, s, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048


def test_patterns():
    rng = np.random.default_rng(3)
    counts = Counter(rng.integers(1, 2049, 20_000).tolist()) | Counter({2048: 5000, 7: 9000})
    packs = packing.patterns(counts)
    placed = Counter()
    for c, lengths in packs:
        assert sum(lengths) <= 2048
        for n in lengths:
            placed[n] += c
    assert placed == counts
    total = sum(n * c for n, c in counts.items())
    assert total / (2048 * sum(c for c, _ in packs)) > 0.98
