import re
from collections import Counter

import numpy as np
import pytest

from lumenframe.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, n string, rank string"


def brute(rows, least, share=50, top=2000):
    f, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cand = {x: n for x, n in f.items() if len(x[1]) > 1 and n >= least}
    longer = Counter()
    for (lang, w), n in cand.items():
        if len(w) == 3:
            for part in (w[:2], w[1:]):
                longer[lang, part] = max(longer[lang, part], n)
    out = []
    for lang in sorted({x for x, _ in cand}):
        best = []
        for (of, w), a in cand.items():
            if of != lang or 100 * longer[of, w] >= share * a:
                continue
            score, k = min((1_000_000 * a * a // (f[of, w[:k]] * f[of, w[k:]]), k) for k in range(1, len(w)))
            best.append((-score, -a, " ".join(w).encode(), f[of, w[:k]], f[of, w[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return out


def found(df, **options):
    return sorted(tuple(r) for r in collocations.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("seed,size,branch", [(0, 2 << 20, 1 << 18), (1, 700, 50)])
def test_against_brute_force(spark, seed, size, branch):
    rng = np.random.default_rng(seed)
    vocab = ["New", "york", "CITY", "été", "the", "of", "x y", "Ω", "a"] + [f"w{k}" for k in range(12)]
    rows = [(None, "no id, no id; no id", "en"), (1, None, "en"), (2, "", None), (3, "the the the " * 30, "fr"), (4, "\t ..,, \n", "de"), (5, "z" * 100_000 + " the of", "en")]
    for k in range(80):
        words = list(rng.choice(vocab, rng.integers(0, 90)))
        for _ in range(rng.integers(0, 4)):
            at = rng.integers(0, len(words) + 1)
            words[at:at] = ["New", "york", "city"] if k % 3 else ["of", "the"]
        gaps = rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ! ", "\x0b"], len(words), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.04, 0.03, 0.03])
        rows.append((k % 50, "".join(w + g for w, g in zip(words, gaps, strict=True)), [None, "en", "und", "de"][k % 4]))
    df = spark.createDataFrame([(*r, "p", "n", "r") for r in rows], SCHEMA).repartition(3)
    assert found(df, slice_bytes=size, branch=branch) == brute(rows, 10) and len(brute(rows, 10)) > 5
    assert found(df, least=3, top=7, slice_bytes=size, branch=branch) == brute(rows, 3, top=7)


def test_bitmaps_over_block_borders():
    """Phrases across the borders of 64-bit blocks and none across an unused position."""
    rng = np.random.default_rng(2)
    n = 1000
    words, used = rng.integers(0, 5, n), rng.random(n) < 0.9
    order = np.lexsort((np.arange(n), words))
    order = order[used[order]]
    b = collocations.Bitmaps.of(words[order], order >> 6, np.uint64(1) << (order & 63).astype(np.uint64))
    assert b.counts(5).tolist() == [int((used & (words == k)).sum()) for k in range(5)]
    pairs, left, right = collocations.extended(b, b, collocations._owners(b, n))
    want = Counter((int(words[i]), int(words[i + 1])) for i in range(n - 1) if used[i] and used[i + 1])
    assert {(int(x), int(y)): int(c) for x, y, c in zip(left, right, pairs.counts(len(left)), strict=True)} == want
    triples, p, c = collocations.extended(pairs, b, collocations._owners(b, n))
    want = Counter(tuple(words[i : i + 3].tolist()) for i in range(n - 2) if used[i : i + 3].all())
    assert {(int(left[x]), int(right[x]), int(y)): int(k) for x, y, k in zip(p, c, triples.counts(len(p)), strict=True)} == want


def test_the_filter_only_spares_work(spark, monkeypatch):
    """A filter with nearly every bit set finds the same."""
    rows = [(k, "in spite of it all, in spite of " + " ".join(f"u{k % 7}" for _ in range(3)), "en") for k in range(40)]
    df = spark.createDataFrame([(*r, "p", "n", "r") for r in rows], SCHEMA)
    monkeypatch.setattr(collocations, "FILTER_WORDS", 2)
    assert found(df) == brute(rows, 10)


def test_scores_beyond_64_bits(spark):
    assert spark.sql("select (cast(3000000000 as decimal(19, 0)) * cast(3000000000 as decimal(19, 0)) * 1000000) div (cast(4000000000 as decimal(19, 0)) * cast(9000000000 as decimal(19, 0))) as s").first().s == 10**6 * 9 * 10**18 // (36 * 10**18)


def test_empty(spark):
    got = collocations.collocations(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
