import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from lumenframe.llm import kit, quality, simhash, toxicity, wordbpe

SF = "/root/testdata/sf0.001"


def brute_near(rows):
    """The stage's rule on all pairs: a band is shared and at most SIMILAR_BITS of the lanes' bits of five-word shingles differ."""
    fps, bands = [], []
    for r in rows:
        h = simhash.shingle_hashes((r.text or "").encode(), 5)
        fps.append(sum(simhash.simhash(kit.mixed(h + np.uint64(k)) if k else h) << 64 * k for k in range(simhash.SIMILAR_LANES)))
        bands.append(set(simhash.band_keys(h).tolist()))
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if comp[i] != comp[j] and bands[i] & bands[j] and (fps[i] ^ fps[j]).bit_count() <= simhash.SIMILAR_BITS:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return [r for i, r in enumerate(rows) if comp[i] == i]


def brute_passages(rows, window=20):
    first, out = {}, {}
    words = {r.doc_id: (r.text or "").encode().split() for r in rows}
    for d in sorted(words):
        gone = set()
        for s in range(len(words[d]) - window + 1):
            if first.setdefault(tuple(words[d][s : s + window]), (d, s)) != (d, s):
                gone |= set(range(s, s + window))
        out[d] = b" ".join(w for k, w in enumerate(words[d]) if k not in gone).decode() if gone else None
    return out


def test_stages_against_brute_force(spark):
    docs = kit.documents(spark, SF)
    names = docs.columns
    q, t = quality.model(spark, SF), toxicity.model(spark, SF)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    scores = q.scores(pa.array([r.text for r in rows]))
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.7]
    one = kit.written(corpus_pipeline.STAGES[0][1](spark, docs, SF), "one")
    assert one.columns == names and sorted(r.doc_id for r in one.collect()) == [r.doc_id for r in rows]
    scores = t.scores(pa.array([r.text for r in rows]))
    rows = [r for r, s in zip(rows, scores, strict=True) if s < 0.7]
    two = kit.written(corpus_pipeline.STAGES[1][1](spark, one, SF), "two")
    assert two.columns == names and sorted(r.doc_id for r in two.collect()) == [r.doc_id for r in rows]
    rows = brute_near(rows)
    three = kit.written(corpus_pipeline.STAGES[2][1](spark, two, SF), "three")
    assert three.columns == names and sorted(r.doc_id for r in three.collect()) == [r.doc_id for r in rows]
    want = {d: next(r.text for r in rows if r.doc_id == d) if x is None else x for d, x in brute_passages(rows).items()}
    want = {d: x for d, x in want.items() if x}
    four = kit.written(corpus_pipeline.STAGES[3][1](spark, three, SF), "four")
    assert four.columns == names and {r.doc_id: r.text for r in four.collect()} == want
    five = corpus_pipeline.STAGES[4][1](spark, four, SF).collect()
    lib = Tokenizer.from_file(wordbpe.default_path())
    assert {r.doc_id: r.doc_tokens for r in five} == {d: len(lib.encode(x, add_special_tokens=False).ids) + 1 for d, x in want.items()}
    assert sum(r.length for r in five) == sum({r.doc_id: r.doc_tokens for r in five}.values())
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, five))
