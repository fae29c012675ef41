"""Phrases that occur more often than their parts explain, by position bitmaps.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and the pieces into words. A shard is a slice
of text: its words get positions, with an unused one after each piece. Each word of a language has a bitmap of its
positions, compressed to the 64-bit blocks that have a bit. A phrase's bitmap has the positions of its last word. It is
extended depth-first, a branch of first words at a time: shifted by one position and ANDed with the bitmaps of the words
that own its bits, so that no phrase crosses a piece; a popcount gives the phrase's count in the shard. Counts are
summed over shards.

A phrase of n words is frequent only if those of n - 1 words in it are. The first job sums counts of words and pairs by
a 64-bit hash; hashes whose sum reaches `least` (equal hashes only add up, so none is missed) become a Bloom filter of
FILTER_WORDS 64-bit words, a broadcast of 8 MB whatever the input. The second job leaves out words and pairs that the filter
does not have, extends the others to three words, and counts the phrases themselves; counts under `least` go. So hashes
decide nothing: they only spare work.

Defined results: null text is empty, a null lang is `und`. A language without a frequent phrase has no row. Rows that
repeat an id count each. Ties go by count, then by the phrase's bytes. An empty table gives an empty result. Extra
columns are ignored. A word of any length is a word. A score whose exact square needs more than 38 digits raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm import kit

LEAST, SHARE, TOP, SCALE = 10, 50, 2000, 1_000_000
#: Bytes of a shard, and parts in which a language's phrases are ranked first, so that one task takes TOP of each part.
SHARD_BYTES, PARTS = 4 << 20, 64
#: 64-bit words of the filter (three bits of one word for each phrase), and positions of the branches extended at a time.
FILTER_WORDS, BRANCH = 1 << 20, 1 << 18
_STEP = np.uint64(0xD6E8FEB86659FD93)
_CUT, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_CUT[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP[list(b" \t")] = True


class Bitmaps(NamedTuple):
    """Compressed bitmaps: for each phrase (ascending) its blocks of 64 positions that have a bit, and their bits."""

    phrase: np.ndarray
    block: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Bitmaps:
        """From entries ordered by (phrase, block), of which several may be of one block."""
        if not len(phrase):
            return cls(phrase, block, bits)
        head = np.flatnonzero(np.concatenate([[True], (phrase[1:] != phrase[:-1]) | (block[1:] != block[:-1])]))
        return cls(phrase[head], block[head], np.bitwise_or.reduceat(bits, head))

    def counts(self, n: int) -> np.ndarray:
        """Popcount of each of n phrases."""
        return np.bincount(self.phrase, np.bitwise_count(self.bits), n).astype(np.int64)

    def shifted(self) -> Bitmaps:
        """Each bitmap moved by one position."""
        over = np.flatnonzero(self.bits >> np.uint64(63))
        phrase, block = np.concatenate([self.phrase, self.phrase[over]]), np.concatenate([self.block, self.block[over] + 1])
        bits = np.concatenate([self.bits << np.uint64(1), np.ones(len(over), np.uint64)])
        order = np.argsort(phrase * (int(block.max()) + 1) + block) if len(over) else slice(None)
        moved = Bitmaps.of(phrase[order], block[order], bits[order])
        return Bitmaps(*(x[moved.bits != 0] for x in moved))

    def positions(self) -> tuple[np.ndarray, np.ndarray]:
        """The entry and the position of each bit: the entries' lowest bits, then the next ones of those that have more."""
        entry, bits, found = np.arange(len(self.bits)), self.bits, []
        while len(entry):
            low = bits & (~bits + np.uint64(1))
            found.append((entry, self.block[entry] * 64 + np.bitwise_count(low - np.uint64(1))))
            bits = bits ^ low
            more = bits != 0
            entry, bits = entry[more], bits[more]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (entry, entry)


class Shard:
    """Words of a slice: their strings, language, hash and bitmaps."""

    def __init__(self, part: pa.RecordBatch):
        data, off = kit.utf8(part.column("text"))
        data = kit.LOWER[data]
        cut = _CUT[data]
        inside = ~(cut | _GAP[data])
        starts, ends, first = kit.spans(inside, off)
        row, _ = kit.ragged(np.diff(first))
        lang = part.column("lang").fill_null("und").dictionary_encode()
        self.langs = lang.dictionary
        lang_of = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.per_lang = np.bincount(lang_of, np.diff(first), len(self.langs)).astype(np.int64)
        length = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(length), pa.py_buffer(data[inside])]).dictionary_encode()
        whole = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(self.langs)) + lang_of[row]
        # A piece ends at a cut or a row's end: an unused position follows.
        cuts = np.concatenate([[0], np.cumsum(cut)])
        gap = np.zeros(len(starts), np.int64)
        gap[1:] = (cuts[starts[1:]] > cuts[starts[:-1]]) | (row[1:] != row[:-1])
        position = np.arange(len(starts)) + np.cumsum(gap)
        order = np.argsort(whole * len(whole) + np.arange(len(whole)))
        kinds = whole[order]
        head = np.concatenate([[True], kinds[1:] != kinds[:-1]])[: len(kinds)]
        number, position = np.cumsum(head) - 1, position[order]
        self.size = int(position.max()) + 2 if len(position) else 0
        self.word, self.lang = kinds[head] // max(1, len(self.langs)), kinds[head] % max(1, len(self.langs))
        self.bitmaps = Bitmaps.of(number, position >> 6, np.uint64(1) << (position & 63).astype(np.uint64))
        strings, at = kit.utf8(words.dictionary)
        of_lang, lang_at = kit.utf8(self.langs)
        of_lang = kit.mixed(kit.range_hashes(of_lang, lang_at[:-1], lang_at[1:]) + np.uint64(1))
        self.hash = kit.mixed(kit.range_hashes(strings, at[:-1], at[1:])[self.word] ^ of_lang[self.lang])
        # The words' bytes, with a space as the last entry.
        self.bytes, self.at = np.concatenate([strings, np.array([32], np.uint8)]), np.concatenate([at, [at[-1] + 1]])

    def phrases(self, words: list[np.ndarray]) -> pa.Array:
        """Phrases of these words (numbers, an array for each place), joined by spaces."""
        space = np.full(len(words[0]), len(self.at) - 2)
        parts = [x for w in words for x in (space, self.word[w])][1:]
        data, off = kit.taken(self.bytes, self.at, np.stack(parts, 1).ravel())
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(space), [None, pa.py_buffer(off[:: len(parts)].copy()), pa.py_buffer(data)]).cast(pa.binary()).cast(pa.string())


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return kit.mixed(a * _STEP + b)


class Filter:
    """A Bloom filter: three bits of one 64-bit word for each hash."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def bits(h: Column) -> tuple[Column, Column]:
        """The word of a hash, and its bits."""
        places = [F.shiftrightunsigned(h, 20 + 6 * k).bitwiseAND(63).cast("int") for k in range(3)]
        bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("bigint"), p)
        return h.bitwiseAND(F.lit(FILTER_WORDS - 1)), bit(places[0]).bitwiseOR(bit(places[1])).bitwiseOR(bit(places[2]))

    def has(self, h: np.ndarray) -> np.ndarray:
        word = self.words[(h & np.uint64(len(self.words) - 1)).astype(np.int64)]
        found = np.ones(len(h), bool)
        for k in range(3):
            found &= (word >> ((h >> np.uint64(20 + 6 * k)) & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def extended(prefix: Bitmaps, words: Bitmaps, owner: np.ndarray) -> tuple[Bitmaps, np.ndarray, np.ndarray]:
    """Phrases one word longer: bitmaps (phrases numbered anew), and for each the prefix and the word it is made of.

    owner: the entry of `words` that has each position's bit, or -1.
    """
    moved = prefix.shifted()
    entry, place = moved.positions()
    partner = owner[place]
    entry, partner = entry[partner >= 0], partner[partner >= 0]
    left, right = moved.phrase[entry], words.phrase[partner]
    whole = left * (int(words.phrase[-1]) + 1 if len(words.phrase) else 1) + right
    order = np.argsort(whole * (len(owner) // 64 + 1) + moved.block[entry])
    entry, partner, whole = entry[order], partner[order], whole[order]
    head = np.concatenate([[True], whole[1:] != whole[:-1]])[: len(whole)]
    # Two bits of an entry may have one partner: equal entries, which are one block of the new bitmap.
    bits = moved.bits[entry] & words.bits[partner]
    return Bitmaps.of(np.cumsum(head) - 1, moved.block[entry], bits), moved.phrase[entry[head]], words.phrase[partner[head]]


def _chosen(b: Bitmaps, keep: np.ndarray) -> Bitmaps:
    """The bitmaps of the phrases marked in keep, under the same numbers."""
    inside = keep[b.phrase]
    return Bitmaps(*(x[inside] for x in b))


def _branches(b: Bitmaps, counts: np.ndarray, size: int) -> Iterator[Bitmaps]:
    """The phrases in runs of about `size` positions."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        lo, hi = np.searchsorted(b.phrase, [at, to])
        yield Bitmaps(b.phrase[lo:hi], b.block[lo:hi], b.bits[lo:hi])
        at = to


def _owners(b: Bitmaps, size: int) -> np.ndarray:
    entry, place = b.positions()
    owner = np.full(size + 64, -1)
    owner[place] = entry
    return owner


def _hashed(slice_bytes: int, size: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words and pairs of each shard: hash, count."""
        for part in kit.slices(batches, most=slice_bytes):
            s = Shard(part)
            counts = s.bitmaps.counts(len(s.word))
            yield kit.batch(h=s.hash.view(np.int64), n=counts)
            owner = _owners(s.bitmaps, s.size)
            for branch in _branches(s.bitmaps, counts, size):
                pairs, a, b = extended(branch, s.bitmaps, owner)
                yield kit.batch(h=pair_hash(s.hash[a], s.hash[b]).view(np.int64), n=pairs.counts(len(a)))

    return hashed


def _counted(sieve, slice_bytes: int, size: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words, pairs and triples that may be frequent in each shard: lang, words, phrase, count; and each language's number of words (0 words)."""
        for part in kit.slices(batches, most=slice_bytes):
            s, known = Shard(part), Filter(sieve.value)

            def sent(words: list[np.ndarray], n: np.ndarray, s=s) -> pa.RecordBatch:
                lang = s.langs.take(pa.array(s.lang[words[0]]))
                return kit.batch(lang=lang, words=np.full(len(n), len(words), np.int32), phrase=s.phrases(words), n=n)

            m = len(s.langs)
            yield kit.batch(lang=s.langs, words=np.zeros(m, np.int32), phrase=pa.array([""] * m, pa.string()), n=s.per_lang)
            keep = known.has(s.hash)
            words = _chosen(s.bitmaps, keep)
            counts = words.counts(len(s.word))
            own = np.flatnonzero(keep)
            yield sent([own], counts[own])
            owner = _owners(words, s.size)
            for branch in _branches(words, counts, size):
                pairs, a, b = extended(branch, words, owner)
                ok = known.has(pair_hash(s.hash[a], s.hash[b]))
                yield sent([a[ok], b[ok]], pairs.counts(len(a))[ok])
                triples, p, c = extended(_chosen(pairs, ok), words, owner)
                ok = known.has(pair_hash(s.hash[b[p]], s.hash[c]))
                yield sent([a[p][ok], b[p][ok], c[ok]], triples.counts(len(p))[ok])

    return counted


def frequent(docs: DataFrame, least: int = LEAST, slice_bytes: int = SHARD_BYTES, branch: int = BRANCH) -> DataFrame:
    """lang, words (1 to 3), phrase, n: words and phrases that occur at least `least` times; words = 0: the language's number of words."""
    spark = docs.sparkSession
    docs = docs.select("text", F.col("lang").cast("string").alias("lang"))
    hashes = docs.mapInArrow(_hashed(slice_bytes, branch), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    word, bits = Filter.bits(F.col("h"))
    packed = kit.written(hashes.groupBy(word.alias("word")).agg(F.bit_or(bits).alias("bits")), "phrase-filter")
    table = packed.toArrow()  # at most FILTER_WORDS rows
    sieve = np.zeros(FILTER_WORDS, np.uint64)
    sieve[np.asarray(table["word"])] = np.asarray(table["bits"]).view(np.uint64)
    kit.removed(packed)
    rows = docs.mapInArrow(_counted(spark.sparkContext.broadcast(sieve), slice_bytes, branch), "lang string, words int, phrase string, n bigint")
    rows = rows.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return kit.written(rows.where((F.col("n") >= least) | (F.col("words") == 0)), "frequent-phrases")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, slice_bytes: int = SHARD_BYTES, branch: int = BRANCH) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each language."""
    grams = frequent(docs, least, slice_bytes, branch)
    total = grams.where("words = 0").select("lang", F.col("n").alias("total"))
    known = grams.where("words > 0").select("lang", "phrase", "n")
    pairs, triples = grams.where("words = 2"), grams.where("words = 3")
    inner = F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase")
    covering = triples.select("lang", inner, "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    pairs = pairs.join(covering, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {int(share)} * n").drop("longer")
    cuts = F.explode(F.expr("transform(sequence(1, words - 1), k -> struct(k, substring_index(phrase, ' ', k) as front, substring_index(phrase, ' ', k - words) as rest))")).alias("cut")
    cut = pairs.unionByName(triples).select("lang", "phrase", F.col("n").alias("a"), cuts).select("lang", "phrase", "a", "cut.*")
    front, rest = (known.select("lang", F.col("phrase").alias(name), F.col("n").alias(n)) for name, n in (("front", "l"), ("rest", "r")))
    cut = cut.join(front, ["lang", "front"]).join(rest, ["lang", "rest"])
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    cut = cut.withColumn("score", F.expr(f"({wide('a')} * {wide('a')} * {SCALE}) div ({wide('l')} * {wide('r')})"))
    least_cut = F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")
    scored = cut.groupBy("lang", "phrase").agg(least_cut).select("lang", "phrase", "cut.*")
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    ranked = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for keys in (["lang", "part"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(kit.documents(spark, sf_dir))


#: op13 in DuckDB's SQL.
ORACLE_SQL = r"""
with t as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
p as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from t),
g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase from p, range(1, 4) r(k) where len(ws) >= k),
f as (select lang, k, phrase, count(*) as c from g group by lang, k, phrase),
total as (select lang, sum(c) as n from f where k = 1 group by lang),
cand as (select * from f where k > 1 and c >= 10),
sub as (select lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) as phrase, c from cand where k = 3),
longer as (select lang, phrase, max(c) as m from sub group by lang, phrase),
left_over as (select cand.* from cand left join longer using (lang, phrase) where m is null or 100 * m < 50 * c),
cut as (select lang, phrase, k, c, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') as front, array_to_string(string_split(phrase, ' ')[j + 1:k], ' ') as rest from left_over, range(1, 3) s(j) where j < k),
scored as (select cut.lang, cut.phrase, cut.c as a, x.c as l, y.c as r, j, (1000000::hugeint * cut.c * cut.c) // (x.c::hugeint * y.c) as score from cut join f x on x.lang = cut.lang and x.phrase = front join f y on y.lang = cut.lang and y.phrase = rest),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked join total using (lang) where rank <= 2000
"""
